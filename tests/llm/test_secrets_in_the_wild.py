"""Secrets and look-alikes that don't come from the labels' generator: tokens as libraries sign them, encoded files, key blocks, the documents themselves, very long texts."""

import base64
import json
import random
import time

import pyarrow.parquet as pq
import pytest

from touchline.llm import secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found():
    return secrets.automata()


def url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def signed(r, scopes: int, signature: int) -> str:
    head = {"alg": "RS256", "typ": "JWT", "kid": r.randbytes(r.choice([0, 4, 16])).hex()}
    body = {"iss": "https://accounts.example.com", "sub": str(r.randrange(10**20)), "exp": 1_700_000_000 + r.randrange(10**7), "scope": " ".join(r.choice(["read", "write", "admin", "email"]) for _ in range(scopes))}
    return ".".join([url(json.dumps(head).encode()), url(json.dumps(body).encode()), url(r.randbytes(signature))])


@pytest.mark.parametrize("signature", [32, 48, 64, 256, 384, 512])
def test_whole_signed_tokens_of_all_lengths(found, signature):
    r = random.Random(signature)
    hits = 0
    for _ in range(60):
        word = signed(r, r.randrange(1, 150), signature)
        text = f"Authorization: Bearer {word}\n"
        hits += [(text[a:b], k) for a, k, b in secrets.more_spans(text, found)] == [(word, "jwt")]
    assert hits >= 54


def test_no_length_is_cut_off(found):
    r = random.Random(8)
    for n in (500, 2_000, 20_000, 200_000):
        text = "see sk-proj-" + secrets._of(r, secrets._URL, 160) + " and " + signed(r, n // 6, 256)
        got = [k for _, k, _ in secrets.more_spans(text, found)]
        assert got == ["openai", "jwt"]


def test_encoded_files_and_key_blocks_are_no_credentials(found):
    r = random.Random(9)
    for _ in range(50):
        blob = base64.b64encode(r.randbytes(3000)).decode()
        for text in (
            f"data:image/png;base64,{blob}", url(r.randbytes(3000)), r.randbytes(64).hex(), r.randbytes(48).hex().upper(), "sha512-" + base64.b64encode(r.randbytes(64)).decode(),
            "-----BEGIN PRIVATE KEY-----\n" + "\n".join(blob[k : k + 64] for k in range(0, r.randrange(500, 3000), 64)) + "\n-----END PRIVATE KEY-----", "\r\n".join(blob[k : k + 76] for k in range(0, r.randrange(500, 3000), 76)),
        ):
            assert not secrets.more_spans(text, found)


def test_tokens_in_paths_assignments_and_lists_are_found(found):
    r = random.Random(10)
    of = lambda kind: secrets.example(secrets.FORMATS[kind], r)
    for _ in range(30):
        for text, word in ((f"https://api.example.com/v1/{(w := of('github'))}/repos", w), (f"aws_secret_access_key={(w := of('aws'))}", w), (f'"{(w := of("slack"))}"', w), (f"x,{(w := of('huggingface'))},y", w)):
            assert word in {text[a:b] for a, _, b in secrets.more_spans(text, found)}


def test_documents_without_base_matches_hold_few_added_spans(found):
    """Ordinary prose of the corpus itself: where the base patterns find nothing, the automata add nothing to 99 of 100 documents."""
    texts = [t for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() if not secrets.base_spans(t or "")]
    assert len(texts) > 500 and sum(bool(secrets.more_spans(t or "", found)) for t in texts) <= len(texts) // 100


def test_many_keys_in_one_text_take_time_in_proportion(found):
    r = random.Random(11)
    keys = [secrets.example(secrets.FORMATS["github"], r) for _ in range(40_000)]
    took = {}
    for n in (10_000, 40_000):
        began = time.time()
        assert len(secrets.more_spans("\n".join(keys[:n]), found)) == n
        took[n] = time.time() - began
    assert took[40_000] < 8 * took[10_000]


def test_apart_keeps_the_best_of_what_overlaps():
    r = random.Random(12)
    for _ in range(300):
        spans = [(float(r.randrange(20)), r.choice("xy"), a := r.randrange(60), a + r.randint(1, 15)) for _ in range(r.randint(0, 12))]
        want = []
        for _, kind, a, b in sorted(spans, key=lambda x: (-x[0], *x[2:])):
            if all(b <= x or y <= a for x, _, y in want):
                want.append((a, kind, b))
        assert secrets.apart(spans) == sorted(want)
