"""Training-data operators: token counts, secrets, top-k search, mixing, near-duplicates, PII, token files, LM, BPE, quality."""
