"""Operator 9, byte-level BPE encoding and decoding: corpus-level merge replay.

1. Texts are gathered into *chunks* of some megabytes. A chunk is one row: its distinct pre-tokens, by falling frequency, and its documents as the pre-tokens' numbers. Rows are dealt out by the
   chunk's number; both steps below read that one shuffle.
2. A chunk's distinct pre-tokens go to buckets by hash, packed. So however frequent one is, it goes there once a chunk; a bucket holds each distinct pre-token of the corpus once.
3. A bucket replays the merges over its pre-tokens (``bpe.Ranks``): an inverted index leads from each token pair to its positions in all of them, merges are applied in rank
   order, and only the neighbours of what was merged are looked up anew. It answers each chunk with the ids of what the chunk sent.
4. A chunk's answers meet its row again (a join by the chunk's number, of which each is one row), and numbers become ids. Decoding joins the bytes of the ids.

A lost executor's chunks are gathered again: from a table that gives the same rows. Answers carry a checksum of what they answer, so a source whose rows come in another order fails instead of mixing chunks up.

Null text counts as empty: no ids, and the digests of nothing. Null ids stay; repeated rows give a row each; an empty table gives an empty result. A text longer than a chunk makes its own.
Lone surrogates, which UTF-8 texts can't hold, don't occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import Task, by_group, caches, documents, prepare, scan

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Text of a chunk, in characters, from which it is closed; bytes of text for which a bucket is planned, and buckets at least.
CHUNK, BUCKET_TEXT, BUCKETS = 6 << 20, 20 << 20, 16
_FEW, _FAR = 192, 1 << 22

caches(__name__, bpe.forget)


def pack(numbers: list[int] | np.ndarray) -> bytes:
    """Whole numbers, compressed: those under _FEW in one byte, others in three planes of bytes; four bytes each where one is _FAR or more."""
    x = np.asarray(numbers, np.uint32)
    if len(x) and int(x.max()) >= _FAR:
        planes = [x.astype("<u4")]
    else:
        far = x[x >= _FEW]
        planes = [np.where(x < _FEW, x, _FEW + (x >> 16)).astype(np.uint8), (far >> 8).astype(np.uint8), far.astype(np.uint8)]
    parts = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in planes]
    return np.array([len(x), len(planes), *(v for p, c in zip(planes, parts, strict=True) for v in (p.nbytes, len(c)))], "<u8").tobytes() + b"".join(parts)


def unpack(data: bytes) -> np.ndarray:
    n, k = np.frombuffer(data, "<u8", 2).tolist()
    sizes, at, planes = np.frombuffer(data, "<u8", 2 * k, 16).tolist(), 16 + 16 * k, []
    for size, packed in zip(sizes[::2], sizes[1::2], strict=True):
        planes.append(np.frombuffer(pa.decompress(data[at : at + packed], size, codec="zstd", asbytes=True), np.uint8))
        at += packed
    if k == 1:
        return planes[0].view("<u4")
    out = planes[0].astype(np.uint32)
    far = np.flatnonzero(out >= _FEW)
    out[far] = (out[far] - _FEW << 16) | planes[1].astype(np.uint32) << 8 | planes[2]
    return out


def _joined(pieces: list[bytes]) -> tuple[bytes, bytes]:
    blob = b"".join(pieces)
    return pack(list(map(len, pieces))), np.array([len(blob)], "<u8").tobytes() + pa.compress(blob, codec="zstd", asbytes=True)


def _cut(sizes: bytes, blob: bytes) -> list[bytes]:
    text = pa.decompress(blob[8:], int(np.frombuffer(blob, "<u8", 1)[0]), codec="zstd", asbytes=True)
    ends = np.cumsum(unpack(sizes)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of [start, start + count), range after range."""
    counts = counts.astype(np.int64)
    return np.repeat(starts.astype(np.int64) - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class _Chunk:
    """Documents on their way into a chunk's row."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.words: list[np.ndarray] = []
        self.spaced: dict[str, int] = {}  # words after a space, and other stretches as they stand, by their numbers
        self.plain: dict[str, int] = {}
        self.length = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        spaces, parts = bpe.split(text or "")
        first, rest = (parts[:1], parts[1:]) if spaces else (parts, [])
        spaced, plain, n = self.spaced, self.plain, len(self.spaced) + len(self.plain)
        for known, new in ((spaced, rest), (plain, first)):
            for w in dict.fromkeys(new):
                if w not in known:
                    known[w] = n
                    n += 1
        self.words.append(np.fromiter(chain(map(plain.__getitem__, first), map(spaced.__getitem__, rest)), np.uint32, len(parts)))
        self.ids.append(doc_id)
        self.sizes.append(len(parts))
        self.length += len(text or "")

    def row(self, number: int, buckets: int) -> pa.RecordBatch:
        find = bpe.pieces_pattern().findall
        pieces: dict[str, int] = {}
        counts, parts = np.ones(len(self.spaced) + len(self.plain), np.int64), []
        # words' numbers rise in each of the two dictionaries; parts follow one another as the words do in them
        order = np.fromiter(chain(self.spaced.values(), self.plain.values()), np.int64, len(counts))
        for space, words in ((" ", self.spaced), ("", self.plain)):
            for w, k in words.items():
                if w.isalpha() and w.isascii():
                    parts.append(pieces.setdefault(space + w, len(pieces)))
                else:
                    found = find(space + w)
                    counts[k] = len(found)
                    parts += [pieces.setdefault(p, len(pieces)) for p in found]
        starts = np.empty(len(counts), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        words = np.concatenate(self.words)
        self.words.clear()
        in_words = counts[words]
        used = np.array(parts, np.int64)[places(starts[words], in_words)]
        ends = np.r_[0, np.cumsum(in_words)][np.cumsum(self.sizes)]
        # the most frequent pre-tokens get the smallest numbers
        by_rank = np.argsort(-np.bincount(used, minlength=len(pieces)), kind="stable")
        rank = np.empty(len(pieces), np.uint32)
        rank[by_rank] = np.arange(len(pieces), dtype=np.uint32)
        raw = list(pieces)
        raw = [raw[k].encode() for k in by_rank.tolist()]
        to = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % np.uint32(buckets)
        sizes, blob = _joined(raw)
        binary = {
            "ids": np.array([i or 0 for i in self.ids], "<i8").tobytes(), "nulls": np.array([i is None for i in self.ids], bool).tobytes(), "sizes": pack(np.diff(np.r_[0, ends])),
            "used": pack(rank[used]), "buckets": pack(to), "piece_sizes": sizes, "pieces": blob,
        }
        return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "checksum": pa.array([zlib.crc32(blob)], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in binary.items()}})


_CHUNKS = "chunk long, checksum long, ids binary, nulls binary, sizes binary, used binary, buckets binary, piece_sizes binary, pieces binary"


class _Gather:
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                chunk.add(doc_id.as_py(), text.as_py())
                if chunk.length >= CHUNK:
                    yield chunk.row(number, self.buckets)
                    number, chunk = number + 1, _Chunk()
        if chunk.ids:
            yield chunk.row(number, self.buckets)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {n: b.column(n)[k].as_py() for n in b.schema.names}


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        pieces, to = _cut(row["piece_sizes"], row["pieces"]), unpack(row["buckets"])
        order = np.argsort(to, kind="stable")
        at, first = np.unique(to[order], return_index=True)
        parts = [_joined([pieces[k] for k in p.tolist()]) for p in np.split(order, first[1:])] if len(order) else []
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array([row["chunk"]] * n, pa.int64()), pa.array([row["checksum"]] * n, pa.int64()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())],
            names=["bucket", "chunk", "checksum", "sizes", "pieces"],
        )


class _Bucket:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, key: tuple, table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        asked = []
        for sizes, blob in zip(table.column("sizes"), table.column("pieces"), strict=True):
            asked.append(np.array([known.setdefault(p, len(known)) for p in _cut(sizes.as_py(), blob.as_py())], np.uint32))
        words = list(known)
        del known
        counts, ids = bpe.ranks(self.path).encode(words)
        starts = np.cumsum(counts) - counts
        found = [(pack(counts[x]), pack(ids[places(starts[x], counts[x])])) for x in asked]
        return pa.table({"chunk": table.column("chunk"), "answered": table.column("checksum"), "bucket": table.column("bucket"), "counts": pa.array([f[0] for f in found], pa.binary()), "found": pa.array([f[1] for f in found], pa.binary())})


class _Joined:
    """A chunk with its answers: ids of each pre-token as (starts, counts, all ids)."""

    def __init__(self, row: dict):
        self.ids = [None if null else i for i, null in zip(np.frombuffer(row["ids"], "<i8").tolist(), np.frombuffer(row["nulls"], bool).tolist(), strict=True)]
        self.sizes, self.used, to = unpack(row["sizes"]), unpack(row["used"]), unpack(row["buckets"])
        self.counts, self.starts, found, n = np.zeros(len(to), np.int64), np.zeros(len(to), np.int64), [np.empty(0, np.uint32)], 0
        for a in row["answers"] or ():
            if a["answered"] != row["checksum"]:
                raise ValueError("the source gave its rows in another order when it was read again; checkpoint it first")
            at, c = np.flatnonzero(to == a["bucket"]), unpack(a["counts"]).astype(np.int64)
            self.counts[at], self.starts[at] = c, n + np.cumsum(c) - c
            found.append(unpack(a["found"]))
            n += len(found[-1])
        self.flat = np.concatenate(found).astype(np.int32)

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each document's pre-tokens (their numbers) and token ids."""
        at = 0
        for n in self.sizes.tolist():
            used = self.used[at : at + n]
            at += n
            yield used, self.flat[places(self.starts[used], self.counts[used])]


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        joined = _Joined(row)
        held, size, first = [], 0, 0
        for k, (_, ids) in enumerate(joined.documents()):
            held.append(ids)
            size += len(ids)
            if size >= 1 << 20 or k == len(joined.ids) - 1:
                offsets = np.cumsum([0, *map(len, held)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(joined.ids[first : k + 1], pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(held))], names=["doc_id", "ids"])
                held, size, first = [], 0, k + 1


class _Digests:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = bpe.ranks(self.path).token
        for row in _rows(batches):
            joined = _Joined(row)
            flat = list(map(str, joined.flat.tolist()))
            decimal = [",".join(flat[a : a + n]) for a, n in zip(joined.starts.tolist(), joined.counts.tolist(), strict=True)]
            del flat
            out: dict[str, list] = {"doc_id": joined.ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for used, ids in joined.documents():
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, used.tolist())).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join(map(token.__getitem__, ids.tolist()))).hexdigest())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items()})


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, emit: Callable, schema: str) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = two.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, parts = max(BUCKETS, -(-size // BUCKET_TEXT)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // CHUNK))
    # all columns on both ways, so that both read the same shuffle
    chunks = two.mapInArrow(Task(_Gather(buckets), __name__), _CHUNKS).repartition(parts, "chunk")
    sent = chunks.mapInArrow(Task(_send, __name__), "bucket long, chunk long, checksum long, sizes binary, pieces binary")
    answers = sent.repartition(min(buckets, parts), "bucket").groupBy("bucket").applyInArrow(by_group(_Bucket(path), True, __name__), "chunk long, answered long, bucket long, counts binary, found binary")
    answers = answers.withColumnRenamed("chunk", "of").repartition(parts, "of").groupBy("of").agg(F.collect_list(F.struct("answered", "bucket", "counts", "found")).alias("answers"))
    return chunks.join(answers, F.col("chunk") == F.col("of"), "left").mapInArrow(Task(emit, __name__), schema)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: each text's token ids."""
    return _run(docs, vocabulary or public_tokenizers.path(VOCABULARY), id_col, text_col, _arrays, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text of ids as encode() gives them; bytes that aren't UTF-8 become U+FFFD. Null ids count as none."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def texts(doc_ids, ids):
        token = bpe.ranks(path).token
        return {"doc_id": doc_ids, "text": [b"".join(map(token.__getitem__, x or ())).decode("utf-8", "replace") for x in ids]}

    return scan(encoded, ["doc_id", "ids"], "doc_id long, text string", texts)


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the bytes decoded from them)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return _run(docs, path, id_col, text_col, _Digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
