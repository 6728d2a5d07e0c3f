"""Operator 7, token-ID / binary output: ids of all documents in ascending id order, in files of coded blocks.

Documents are ranged and sorted by id (rows of one id by a hash of their text, so no id is bound to one task); each task encodes its range with the tokenizers library (through a cache of words, new ones in texts of many), appends the end id to each document, and writes *segments*
of whole documents. A segment is one binary value of a Parquet file (any store that Spark writes will do):

    "TLR4", documents (u32), ids (u64), ids a block (u32), blocks (u32), bytes of the table of ids (u32)
    for each document: id (i64), whether it is null (u8), its number of ids (u64)
    for each block: bytes (u32), CRC-32 of its ids (u32)
    the table of ids (see rangecoder)
    CRC-32 of all above (u32), then the coded blocks

Blocks start anew, so each can be read alone, with the head; reading checks every CRC. Null text counts as empty (the end id alone); null ids come first; repeated rows give a row each; an empty table gives an empty result. Ids may have up to 32 bits.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, rangecoder
from .common import Task, caches, documents, prepare, scratch
from .rangecoder import spread

VOCABULARY, END = "byte_bpe_50k.json", 2
#: Ids of a segment, from which it is closed after the document that reached it.
SEGMENT = 6 << 20
#: Text of a part, in bytes, as planned; parts at least.
PART_BYTES, PARTS = 16 << 20, 12
#: Bytes of texts that are encoded together (a longer single text is taken alone).
TEXT_BYTES = 16 << 20
#: Words that a worker's cache holds at most; it starts anew when full.
KNOWN = 1_500_000
_HEAD = struct.Struct("<4sIQIII")
_DOCUMENT = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
_BLOCK = np.dtype([("size", "<u4"), ("crc", "<u4")])

_caches: dict[str, _Known] = {}


def _forget() -> None:
    _caches.clear()
    _spaced.cache_clear()
    bpe.forget()


caches(__name__, _forget)


#: Texts that can't be split at spaces alone: white space beside a space, or a space at an end.
_LOOSE = f"^ | $| [{bpe.SPACE}]|[{bpe.SPACE}] "
#: Words that a call of the library's gets as one text.
_TOGETHER = 200


#: Words whose pre-tokens _PIECE finds: no apostrophe, and of ASCII and letters of the next blocks only.
_PLAIN = re.compile("[\n!-&(-~\xc0-\xd6\xd8-\xf6\xf8-\u017f]*")
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_PIECE = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: Most words of several pieces: letters, signs, and maybe a line's end, letters, signs.
_SHAPE = f"^(?P<a>[{_LETTER}]+)(?P<b>[!-&(-/:-@\\[-`{{-~]+)(?:(?P<c>\n)(?P<d>[{_LETTER}]+)(?P<e>[!-&(-/:-@\\[-`{{-~]*))?$"


def _pieces(word: str) -> list[str]:
    """A word cut where its pre-tokens end, or at least where its chunks do."""
    return _PIECE.findall(word) if _PLAIN.fullmatch(word, 1 if word[:1] == " " else 0) else bpe.CHUNK.findall(word)


@lru_cache(4)
def _spaced(path: str) -> np.ndarray:
    """Whether each id's token begins with a space."""
    library = bpe.library(path)
    size = max(library.get_vocab().values(), default=-1) + 1
    return np.fromiter(((library.id_to_token(i) or "").startswith("\u0120") for i in range(size)), bool, size)


class _Known:
    """Ids of strings that were seen: string k's are ``flat[start[k] : start[k] + size[k]]``. Words that stand after a space are held in an Arrow array, without it; all others in a dict."""

    def __init__(self, path: str):
        self.path, self.place = path, {}
        self.words, self.word_place = pa.array([], pa.large_string()), np.empty(0, np.int64)
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Add strings by their numbers of ids and all ids; their places."""
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
        return np.arange(len(self.size) - len(size), len(self.size))

    def _encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(each string's number of ids, all ids)."""
        arrays = [e.ids for e in bpe.library(self.path).encode_batch_fast(strings, add_special_tokens=False)]
        return np.fromiter(map(len, arrays), np.int64, len(arrays)), np.fromiter(chain.from_iterable(arrays), np.uint32)

    def places(self, wanted: list[str]) -> np.ndarray:
        """The place of each string as it stands."""
        place = self.place
        new = [k for k in dict.fromkeys(wanted) if k not in place]
        if new:
            place.update(zip(new, self._add(*self._encode(new)).tolist(), strict=True))
        return np.fromiter(map(place.__getitem__, wanted), np.int64, len(wanted))

    def word_places(self, wanted: pa.Array) -> np.ndarray:
        """The place of each word after a space."""
        coded = wanted.dictionary_encode()
        number = pc.index_in(coded.dictionary, self.words)
        absent = pc.is_null(number).to_numpy(zero_copy_only=False)
        found = np.empty(len(absent), np.int64)
        found[~absent] = self.word_place.take(pc.drop_null(number).to_numpy())
        if absent.any():
            found[absent] = self._new_words(coded.dictionary.filter(pa.array(absent)))
        return found.take(coded.indices.to_numpy())

    def _new_words(self, new: pa.Array) -> np.ndarray:
        """The places of distinct new words. A word of several pieces is put together from their ids; its first piece counts as a word, too."""
        simple = pc.match_substring_regex(new, f"^[{_LETTER}]+$").to_numpy(zero_copy_only=False)
        odd, odd_at = new.filter(pa.array(~simple)), np.flatnonzero(~simple)
        shaped = pc.extract_regex(odd, _SHAPE)
        fits = shaped.is_valid().to_numpy(zero_copy_only=False)
        shaped, shaped_at = shaped.filter(pa.array(fits)), odd_at[fits]
        cut = [_pieces(f" {w}") for w in odd.filter(pa.array(~fits)).to_pylist()]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        simple[odd_at[~fits][count == 1]] = True
        cut, cut_at, count = [c for c in cut if len(c) > 1], odd_at[~fits][count > 1], count[count > 1]
        n, m = int(simple.sum()), int(simple.sum()) + len(shaped)
        # all distinct first pieces, those of one piece before the others
        coded = pa.concat_arrays([new.filter(pa.array(simple)), shaped.field("a"), pa.array([c[0][1:] for c in cut], pa.large_string())]).dictionary_encode()
        place = np.full(len(coded.dictionary), -1)
        number = pc.index_in(self.words, coded.dictionary)
        place[pc.drop_null(number).to_numpy()] = self.word_place[pc.is_valid(number).to_numpy(zero_copy_only=False)]
        absent = place < 0
        place[absent] = self._add(*self._apart(coded.dictionary.filter(pa.array(absent)).to_pylist()))
        first = place.take(coded.indices.to_numpy())
        out = np.empty(len(new), np.int64)
        out[simple] = first[:n]
        if len(shaped):
            pieces = np.stack([first[n:m], *(self._column(shaped.field(k)) for k in "bcde")], 1)
            out[shaped_at] = self._joined(pieces.reshape(-1), np.full(len(shaped), 5))
        if cut:
            ends = np.cumsum(count)
            later, pieces = np.ones(ends[-1], bool), np.empty(ends[-1], np.int64)
            later[ends - count] = False
            pieces[~later], pieces[later] = first[m:], self.places([p for c in cut for p in c[1:]])
            out[cut_at] = self._joined(pieces, count)
        self.words = pa.concat_arrays([self.words, new, coded.dictionary[n:].filter(pa.array(absent[n:]))])
        self.word_place = np.concatenate([self.word_place, out, place[n:][absent[n:]]])
        return out

    def _column(self, strings: pa.Array) -> np.ndarray:
        """The place of each string as it stands, of few distinct ones."""
        coded = pc.fill_null(strings, "").dictionary_encode()
        return self.places(coded.dictionary.to_pylist()).take(coded.indices.to_numpy())

    def _joined(self, pieces: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Add strings that consist of so many of the strings at these places; their own places."""
        at, ends = spread(self.start.take(pieces), self.size.take(pieces))
        return self._add(np.diff(ends[np.cumsum(count) - 1], prepend=0), self.flat.take(at))

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words after a space, many in one text: each begins where a token begins with a space, as none has a space inside."""
        together = 1 if any(" " in s for s in bpe.special_strings(self.path)) else _TOGETHER
        texts = [" " + " ".join(words[k : k + together]) for k in range(0, len(words), together)]
        sizes, ids = self._encode(texts) if texts else (np.empty(0, np.int64), np.empty(0, np.uint32))
        spaced = _spaced(self.path).take(ids)
        want = np.diff(np.r_[np.arange(0, len(words), together), len(words)])
        ends = np.cumsum(sizes)
        if (np.diff(np.r_[0, np.cumsum(spaced)][np.r_[0, ends]]) != want).any() or not spaced[(ends - sizes)].all():
            return self._encode([f" {w}" for w in words])  # a vocabulary that doesn't mark spaces so
        first = np.flatnonzero(spaced)
        return np.diff(np.r_[first, len(ids)]), ids


def encode_texts(texts: list[str | None] | pa.Array, path: str) -> list[np.ndarray]:
    """Each text's ids as the library gives them. Texts are split and their distinct words looked up together."""
    library, special = bpe.library(path), bpe.special_strings(path)
    known = _caches.get(path)
    if known is None or len(known.size) > KNOWN or len(known.flat) > 8 * KNOWN or len(known.place) > bpe.CACHE or known.words.nbytes > 16 * KNOWN:
        known = _caches[path] = _Known(path)
    column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(column)
    whole, empty = np.zeros(len(column), bool), pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for s in special:
        whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
    loose = pc.match_substring_regex(column, _LOOSE).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(whole).tolist():
        out[i] = np.array(library.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
    for i in np.flatnonzero(loose & ~whole & ~empty).tolist():
        places = known.places(bpe.CHUNK.findall(column[i].as_py()))
        out[i] = known.flat[spread(known.start[places], known.size[places])[0]]
    plain = np.flatnonzero(~(whole | loose | empty))
    if len(plain):
        lists = pc.split_pattern(column.take(pa.array(plain)), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        firsts = np.r_[0, ends[:-1]]
        flat = lists.flatten()
        later = np.ones(len(flat), bool)
        later[firsts] = False
        places = np.empty(len(flat), np.int64)
        places[firsts] = known.places(flat.take(pa.array(firsts)).to_pylist())  # no space is before them
        places[later] = known.word_places(flat.filter(pa.array(later)))
        at, word_ends = spread(known.start.take(places), known.size.take(places))
        for i, ids in zip(plain.tolist(), np.split(known.flat.take(at), word_ends[ends - 1][:-1]), strict=True):
            out[i] = ids
    return out


def pack(doc_ids: list, arrays: list[np.ndarray]) -> bytes:
    """A segment's bytes."""
    ids = np.concatenate([np.empty(0, np.uint32), *arrays])
    block = rangecoder.BLOCK
    blocks, known = rangecoder.encode(ids, block)
    docs = np.zeros(len(doc_ids), _DOCUMENT)
    docs["id"], docs["null"], docs["n"] = [d or 0 for d in doc_ids], [d is None for d in doc_ids], list(map(len, arrays))
    table = np.zeros(len(blocks), _BLOCK)
    table["size"] = list(map(len, blocks))
    table["crc"] = [zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) for i in range(len(blocks))]
    head = _HEAD.pack(b"TLR4", len(docs), len(ids), block, len(blocks), len(known)) + docs.tobytes() + table.tobytes() + known
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def unpack(data: bytes) -> tuple[list, list[np.ndarray]]:
    """(document ids, each document's token ids) of a segment; ValueError if any checksum fails."""
    magic, n_docs, n_ids, block, n_blocks, known = _HEAD.unpack_from(data)
    a = _HEAD.size
    b = a + n_docs * _DOCUMENT.itemsize
    d = b + n_blocks * _BLOCK.itemsize
    c = d + known
    if magic != b"TLR4" or struct.unpack_from("<I", data, c)[0] != zlib.crc32(data[:c]):
        raise ValueError("the segment's head is damaged")
    docs, table = np.frombuffer(data[a:b], _DOCUMENT), np.frombuffer(data[b:d], _BLOCK)
    ends = c + 4 + np.cumsum(table["size"].astype(np.int64))
    ids = rangecoder.decode([data[e - n : e] for e, n in zip(ends.tolist(), table["size"].tolist(), strict=True)], n_ids, data[d:c], block)
    for i, crc in enumerate(table["crc"].tolist()):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return [None if n else d for d, n in zip(docs["id"].tolist(), docs["null"].tolist(), strict=True)], np.split(ids, np.cumsum(docs["n"].astype(np.int64))[:-1])


class _Write:
    def __init__(self, path: str, end: int):
        self.path, self.end = path, np.array([end], np.uint32)

    def encoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and the ids of its text; texts of TEXT_BYTES are gathered from the batches."""
        held, size = [], 0
        for b in chain(batches, [None]):
            if held and (b is None or size + b.nbytes > TEXT_BYTES):
                texts = pa.concat_arrays([h.column(1).cast(pa.large_string()) for h in held])
                doc_ids, held, size = [i for h in held for i in h.column(0).to_pylist()], [], 0
                yield from zip(doc_ids, encode_texts(texts, self.path), strict=True)
            if b is not None and b.num_rows:
                held.append(b)
                size += b.nbytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        ids, arrays, n = [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_ids": pa.array([n], pa.int64()), "payload": pa.array([pack(ids, arrays)], pa.binary())})

        for i, found in self.encoded(batches):
            ids.append(i)
            arrays.append(np.concatenate([found, self.end]))
            n += len(arrays[-1])
            if n >= SEGMENT:
                yield closed()
                segment, ids, arrays, n = segment + 1, [], [], 0
        if ids:
            yield closed()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, segment, payload in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            ids, arrays = unpack(payload)
            n = np.array(list(map(len, arrays)), np.int64)
            k = len(ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * k, pa.int32()), "segment": pa.array([segment] * k, pa.int32()), "doc_id": pa.array(ids, pa.int64()),
                    "at": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in arrays], pa.int64()),
                }
            )


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files. Parts follow one another by number, segments within a part too."""
    spark = docs.sparkSession
    prepare(spark)
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = max(PARTS, -(-(two.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    # equal rows may change places; the last key only lets them fall into different parts
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("row").asc()]
    ranged = two.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(Task(_Write(vocabulary or public_tokenizers.path(VOCABULARY), end), __name__), "part int, segment int, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 of each document in the files, all blocks decoded and checked."""
    prepare(spark)
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as the write had tasks
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    places = files.select("part", "segment", "n_ids").join(before, "part").select("part", "segment", (F.col("base") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("base"))
    found = files.select("part", "segment", "payload").mapInArrow(Task(_read, __name__), "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(places, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write(documents(spark, sf_dir), path)
    return read(spark, path)
