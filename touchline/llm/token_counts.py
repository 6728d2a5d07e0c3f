"""Operator 1, token counts: a two-tier lookup on the map side, without any shuffle of pre-tokens.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, broadcast: the vocabulary's own words, and those found in
a small part of the corpus. Its size is bounded (``FREQUENT``), and it is a cache alone: results don't depend on what it holds. Tier two is a
cache in each worker, filled by the library for what tier one misses.

Null text counts as empty (0 tokens, 0 bytes); repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import caches, documents, prepare, scan

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the broadcast table at most, and rows that are looked at for frequent pre-tokens.
FREQUENT, LOOKED_AT = 120_000, 1_000
LIMIT = 1024

_table: dict = {}


def _forget() -> None:
    _table.clear()
    bpe.forget()


caches(__name__, _forget)


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> tuple[str, bytes]:
    """The broadcast table: pre-tokens joined by spaces, and a byte with the length of each."""
    t = bpe.library(path)
    words = {d[1:] for i in range(t.get_vocab_size(with_added_tokens=False)) if (d := t.decode([i], skip_special_tokens=False))[:1] == " " and len(d) > 1 and not any(c.isspace() for c in d[1:]) and "�" not in d}

    def count(texts):
        found: Counter = Counter()
        for x in texts:
            spaces, parts = bpe.split(x or "")
            if spaces:
                found.update(k for k in parts[1:] if k.isprintable() and len(k) <= bpe.LONG)
        top = [k for k, n in found.most_common(FREQUENT // 2) if n > 1]
        return {"word": top}

    few = docs.select(F.col(f"`{text}`").alias("text")).filter("length(text) < 100000").limit(LOOKED_AT).coalesce(1)
    words |= {r[0] for r in scan(few, ["text"], "word string", count).distinct().limit(FREQUENT // 2).collect()}
    listed = sorted(w for w in words if not any(s in " " + w for s in bpe.special_strings(path)))[:FREQUENT]
    lengths = [len(e.ids) for e in t.encode_batch([" " + w for w in listed], add_special_tokens=False)]
    kept = [(w, n) for w, n in zip(listed, lengths, strict=True) if n < 256]
    return " ".join(w for w, _ in kept), bytes(n for _, n in kept)


class _Count:
    def __init__(self, path: str, sent: Broadcast, limit: int):
        self.path, self.sent, self.limit, self.name = path, sent, limit, uuid.uuid4().hex

    def __call__(self, ids: list, texts: list) -> dict:
        if self.name not in _table:
            words, lengths = self.sent.value
            _table.clear()
            _table[self.name] = dict(zip(words.split(" "), lengths, strict=True)) if words else {}, _Misses(self.path, " "), _Misses(self.path, "")
        table, misses, plain = _table[self.name]
        special, library = bpe.special_strings(self.path), bpe.library(self.path)
        sizes, counts = [], []
        get = table.get
        for x in texts:
            x = x or ""
            sizes.append(len(x.encode("utf-8", "surrogatepass")))
            if any(s in x for s in special):  # the library makes them special tokens, wherever they stand
                counts.append(len(library.encode(x, add_special_tokens=False).ids))
                continue
            spaces, parts = bpe.split(x)
            if not spaces:
                counts.append(sum(map(plain.__getitem__, parts)))
                continue
            n = plain[parts.pop(0)]
            known = list(map(get, parts))
            n += sum(filter(None, known))
            if None in known:
                n += sum(map(misses.__getitem__, [c for c, k in zip(parts, known, strict=True) if k is None]))
            counts.append(n)
        return {"doc_id": ids, "n_bytes": sizes, "n_tokens": counts, "over_limit": [n > self.limit for n in counts]}


class _Misses(dict):
    """Tier two: tokens of a chunk before which stands ``before``."""

    def __init__(self, path: str, before: str):
        super().__init__()
        self.encode, self.before = bpe.library(path).encode, before

    def __missing__(self, key: str) -> int:
        n = len(self.encode(self.before + key, add_special_tokens=False).ids)
        if len(key) <= bpe.LONG:
            if len(self) >= bpe.CACHE:
                self.clear()
            self[key] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row, as the tokenizers library counts."""
    prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col))
    return scan(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", _Count(path, sent, limit))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
