"""Operator 10, quality rules: base rules, and a hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Features are hashes of words and of word pairs in ``BUCKETS`` buckets. Two multinomials are fitted: the raw one over all documents, the target one over trusted
documents (label quality = 1), however many there are. A document's score is the mean over its features
of log(target / raw). Of the trusted documents, one half (by a hash of the id) fits the target, the other sets the threshold: its ``QUANTILE`` score among documents that pass the base rules,
less ``MARGIN``. So a document is judged against the worst trusted text, and every document gets the same verdict wherever it stands.

Null and empty texts have no words: they fail the base rules. Without labels no document fails by score. Ties, repeats: each row is judged alone (of a held-out trusted id's rows, the worst one
counts for the threshold). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Task, documents, mix, ngram_hashes, prepare, scan, small, word_hashes

BUCKETS = 1 << 16
QUANTILE, MARGIN = 0.002, 0.03
WINDOW = 8
_SHIFT = np.uint64(48)


def features(h: np.ndarray) -> np.ndarray:
    """Buckets of all words and word pairs."""
    return np.concatenate([mix(h), ngram_hashes(h, 2)]) >> _SHIFT


def repeat_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in windows found twice or more."""
    g = ngram_hashes(h, window)
    s = np.sort(g)
    twice = s[1:] == s[:-1]
    if not twice.any():
        return 0
    at = np.flatnonzero(np.isin(g, s[1:][twice]))
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base(text: str, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(h), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeat_words(h)


def failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket and task: features in all texts and in trusted ones."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        every, trusted = [], []
        for text, ok in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = features(word_hashes(text.encode().split())) if text else np.empty(0, np.uint64)
            every.append(f)
            if ok:
                trusted.append(f)
        for out, fs in ((raw, every), (target, trusted)):
            if fs:
                out += np.bincount(np.concatenate(fs).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


class _Score:
    def __init__(self, sent):
        self.sent = sent

    def __call__(self, ids: list, texts: list, keys: list) -> dict:
        weights = self.sent.value
        out = []
        for t in texts:
            t = t or ""
            h = word_hashes(t.encode().split())
            f = features(h).astype(np.int64)
            out.append((*base(t, h), float(weights[f].mean()) if len(f) else 0.0))
        cols = list(zip(*out, strict=True))
        return dict(zip(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"], cols, strict=True)) | {"doc_id": ids, "text_key": keys, "base_failed": [failed(x[0], x[4]) for x in out]}


def weights(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket. trusted: doc_id and half; half 0 fits."""
    marked = docs.join(small(trusted.filter("half = 0").select("doc_id", F.lit(True).alias("ok"))), "doc_id", "left").select("text", "ok")
    rows = marked.mapInArrow(Task(_counts, __name__), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    p = (raw + 1) / (raw.sum() + BUCKETS)
    q = (target + BUCKETS * p) / (target.sum() + BUCKETS)
    return np.log(q / p)


def trusted_sample(labels: DataFrame) -> DataFrame:
    """doc_id, half of all trusted documents; half tells, by a hash, those that fit the target from those that are held out for the threshold."""
    found = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return found.select("doc_id", F.pmod(F.shiftright(F.xxhash64("doc_id"), 3), F.lit(2)).cast("int").alias("half"))


def quantile(scores: DataFrame, q: float) -> float | None:
    """The exact quantile of a column of numbers, interpolated: tasks send their least ones, a share q of all, and the driver gets the two beside the place."""
    n = scores.count()
    if not n:
        return None
    at = q * (n - 1)
    beside = [r[0] for r in scores.orderBy(scores.columns[0]).offset(int(at)).limit(2).collect()]
    return float(np.quantile(beside, at - int(at)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr of each row; keyed: also text_key, the text's xxhash64, since ids may be null or stand for several texts."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`")
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    chosen = trusted_sample(labels).checkpoint()
    sent = spark.sparkContext.broadcast(weights(two, chosen))
    scored = scan(two, ["doc_id", "text", "text_key"], "doc_id long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double", _Score(sent)).checkpoint()
    held = scored.filter("NOT base_failed").join(small(chosen.filter("half = 1").select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("llr").alias("llr")).select("llr").checkpoint()  # a row an id
    worst = quantile(held, QUANTILE)
    threshold = float("-inf") if worst is None else worst - MARGIN
    return scored.select("doc_id", *["text_key"] * keyed, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))).alias("kept"), "llr")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
