"""Operator 11, SimHash near-dedup: a byte-position inverted index with count filtering.

A text's 3-word shingles, repeats included, are hashed (XXH64, seed 42); a fingerprint's bit is set where it is set in over half the hashes. Fingerprints link at ``BITS`` (2) or fewer differing bits.

The index. A fingerprint is eight bytes at eight positions. Two differing bits lie in two bytes at most, so the guaranteed minimum of a linked pair's tally of shared positional bytes is six. A posting
of one byte would hold 1/256 of all fingerprints, and tallying its pairs one by one would take the square of that; so a posting's key is a whole tally that suffices: six positions and
their bytes, 28 keys a fingerprint. Who meets in a posting shares six positional bytes or more, and everyone who does meets in one. Within a posting, fingerprints differ in the two other positions alone:
it has 65,536 members at most, whatever the input, since equal fingerprints are one entry.

Verification compares whole fingerprints. Small postings compare their members by distance in order; in larger ones each member looks the 136 patterns up that differ from it in one or two of the
two free bytes' bits, among the posting's sorted members. A posting gives the smallest linked fingerprint of each member's local component: a forest, never all pairs. Components follow from all postings' forests.

Null and empty texts, and texts without words, have the fingerprint zero, which links like any other. Fewer than three words are one sequence. Null ids stay, as rows; a component's id is its
smallest id that isn't null. Repeated rows are rows each. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Task, column, documents, lower_words, prepare, release, scan, small
from .jaccard_join import components

N, SEED, BITS = 3, 42, 2
#: A posting's key: the positions left free, by the key's number.
FREE = tuple(itertools.combinations(range(8), BITS))
#: Members up to which a posting compares all of them; hashes whose bits are counted at once; entries of a task, as planned.
FEW, _AT_ONCE, ENTRIES = 64, 1 << 16, 2_000_000
_U = np.uint64


def fingerprint(text: str | None, n: int = N) -> int:
    """Unsigned 64 bits."""
    w = lower_words(text)
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else iter([b" ".join(w)])
    total = max(1, len(w) - n + 1)
    hashes, ones = map(xxhash.xxh64_intdigest, grams, itertools.repeat(SEED)), np.zeros(64, np.int64)
    for k in range(0, total, _AT_ONCE):
        h = np.fromiter(itertools.islice(hashes, _AT_ONCE), "<u8", min(_AT_ONCE, total - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _prints(ids: list, texts: list) -> dict:
    return {"doc_id": ids, "fp": [f - (1 << 64) if f >> 63 else f for f in map(fingerprint, texts)]}


def _mask(free: tuple[int, ...]) -> int:
    """The bits of the positions that aren't free, as a long."""
    return sum(-(1 << 56) if p == 7 else 0xFF << (8 * p) for p in range(8) if p not in free)


def _patterns(free: tuple[int, ...]) -> np.ndarray:
    """All ways in which one or two bits of the free positions differ."""
    bits = [1 << (8 * p + b) for p in free for b in range(8)]
    return np.array([*bits, *(a | b for a, b in itertools.combinations(bits, 2))], _U)


_PATTERNS = [_patterns(f) for f in FREE]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members reaches by the edges (a, b), both ways."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(number: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): members of postings, in their order, and the smallest one of their local component, where that is another."""
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (number[1:] != number[:-1])])
    size = np.diff(np.r_[first, len(fp)])
    place = np.repeat(first, size)
    a, b = [], []
    # small postings: each member against the next, the one after it, and so on
    live = np.flatnonzero((np.repeat(size, size) <= FEW) & (np.repeat(size, size) > 1))
    for d in range(1, FEW):
        live = live[live + d < len(fp)]
        live = live[place[live] == place[live + d]]
        if not len(live):
            break
        near = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= BITS]
        a.append(near)
        b.append(near + d)
    # large ones: what a member may be linked with, among the sorted members
    for s, m in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        members = fp[s : s + m]
        order = np.argsort(members)
        ranked = members[order]
        for p in _PATTERNS[number[s]]:
            want = ranked ^ p
            at = np.minimum(np.searchsorted(ranked, want), m - 1)
            hit = np.flatnonzero((ranked[at] == want) & (ranked < want))
            a.append(s + order[hit])
            b.append(s + order[at[hit]])
    a, b = np.concatenate([np.empty(0, int), *a]), np.concatenate([np.empty(0, int), *b])
    u, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _forest(len(u), back[: len(a)], back[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(u)))
    return u[moved], u[label[moved]]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries (number, key, fp) to links. The last posting of a batch waits for its other members: 65,536 in all at most."""

    def linked(cols: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _links(*cols)
        fp = cols[2].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    held = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        cols[2] = cols[2].view(_U)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield linked([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield linked(held)


def links(prints: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) that join all that are within BITS, directly or by others."""
    spark = prints.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() * len(FREE) // ENTRIES))
    keys = F.array(*[F.struct(F.lit(i).alias("number"), F.col("fp").bitwiseAND(F.lit(_mask(f))).alias("key")) for i, f in enumerate(FREE)])
    entries = prints.select("fp", F.explode(keys).alias("k")).select("k.number", "k.key", "fp")
    dealt = entries.repartition(tasks, "number", "key").sortWithinPartitions("number", "key")
    return dealt.mapInArrow(Task(_postings, __name__), "a long, b long").distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each row."""
    named = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return scan(named, ["doc_id", "text"], "doc_id long, fp long", _prints)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    spark = docs.sparkSession
    prepare(spark)
    rows = fingerprints(docs, id_col, text_col).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).checkpoint()
    edges = links(distinct.select("fp")).checkpoint()
    release(spark)
    if edges.isEmpty():
        grouped = distinct.withColumn("comp", F.col("fp"))
    else:
        grouped = distinct.join(small(components(edges)), F.col("fp") == F.col("cls"), "left").select("fp", "least", "n", F.coalesce("comp", "fp").alias("comp"))
    grouped = grouped.checkpoint()
    # most rows are alone in their component: only the others look theirs up
    several = grouped.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows")).filter("rows > 1").select("comp", "component_id")
    found = small(grouped.select("fp", "comp").join(several, "comp").select(F.col("fp").alias("of"), "component_id").checkpoint())
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(found, F.col("fp") == F.col("of"), "left").select("doc_id", shown.alias("fingerprint"), F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
