"""Operator 8, LM scoring: an interpolated modified Kneser-Ney n-gram model.

Counting. Each task counts its distinct n-grams of the highest order and sends them, packed in binary values sorted by context, to buckets by range of the context's hash. A bucket adds them up,
appends its part of the model to its range's files, and sends what the next lower order needs of them: its n-grams' occurrences and distinct words to the left; and so on down to single words.
Nothing but packed counts is shuffled, and buckets' sizes are fixed by the input's size, not by any key: a frequent n-gram or word comes once from each task. A task goes through its range's buckets one after the other.

Store. For each order and range of contexts, sorted arrays of hashes beside arrays of counts: n-grams (64 bits of hash; one byte of count, larger ones aside), contexts (56 bits; count, continuations of
1, 2, 3 or more), words (56 bits; count, distinct contexts). The files lie in the shared folder, where workers map them into memory, OPEN at a time; where the folder isn't a POSIX path, workers read them through Arrow's file systems.

Model. P(w | h) = (max(c(hw) - D(c), 0) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) P(w | h')) / c(h), where h' lacks h's first word; c counts occurrences at the highest order, and distinct words to the left below
it. An unseen h leaves it to h'. Single words have the same form above 1 / (V + 1), where V + 1 holds an unknown word. D1, D2, D3 come from each order's counts of counts. Words are A-Z lower-cased; each
text ends with an end token, and order - 1 begin marks come before it.

Hashes stand for words and n-grams: n_known, V and counts are exact while none of them collide (56 bits a word, 64 an n-gram).

Null text counts as empty (its end token alone); a null id's text is held out; repeated rows count each; without training texts V = 0, and every word is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Task, documents, lower_words, mix, prepare, remove, scan, scratch, word_hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_H56 = np.uint64((1 << 56) - 1)
BEGIN, END = np.uint64(0x5B), np.uint64(0x5D)
#: The model's order; tokens that a task counts before it sends them off; text for which a bucket, and a range of buckets with files of its own, is planned; files that a worker maps at once.
ORDER, HELD, BUCKET_BYTES, FILE_BYTES, OPEN = 2, 1_500_000, 12 << 20, 24 << 20, 48
#: Ranges from which on they grow with the text instead of in number, up to this size.
MANY, MOST_BYTES = 1000, 1 << 30


def gram_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of context and word, whose 24 top bits are the context's: n-grams' order is their contexts' order, as far as ranges go."""
    return (h >> np.uint64(32)) << np.uint64(40) | mix(h * _ODD + w) >> np.uint64(24)


def longer(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The 56-bit hash of a context with one more word before it."""
    return mix(first * _ODD + h + np.uint64(1)) & _H56


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The range of a 56-bit hash's 24 top bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def tokens(text: str | None) -> np.ndarray:
    """56-bit hashes of the words, then the end."""
    return np.append(word_hashes(lower_words(text)) & _H56, END)


def contexts(w: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of each token's context, from order - 1 words down to one."""
    p = np.concatenate([np.full(order - 1, BEGIN), w])
    out = [p[order - 2 : order - 2 + len(w)]]
    for k in range(2, order):
        out.append(longer(p[order - 1 - k : order - 1 - k + len(w)], out[-1]))
    return out[::-1]


# --- Packed arrays -----------------------------------------------------------------------------------------------------


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, in the fewest bytes that hold the largest."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        parts.append(struct.pack("<QB", len(a), width) + a.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    return b"".join(parts)


def _load(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width = struct.unpack_from("<QB", data, at)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 9).reshape(n, width)
        out.append(wide.view("<u8").reshape(-1))
        at += 9 + n * width
    return out


def add_up(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys (of one or two arrays) in order, and sums of the values."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of equal neighbours."""
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return new, np.diff(np.r_[new, len(h)])


class Plan:
    """How hashes fall into buckets, and buckets into ranges with files of their own."""

    def __init__(self, size: int):
        self.buckets = max(8, -(-size // BUCKET_BYTES))
        self.files = min(self.buckets, max(8, min(MANY, -(-size // FILE_BYTES)), -(-size // MOST_BYTES)))

    def file_of(self, bucket: np.ndarray) -> np.ndarray:
        return bucket * self.files // self.buckets

    def rows(self, by: np.ndarray, pack) -> Iterator[tuple[int, int, bytes]]:
        """(file, bucket, data) for sorted hashes; pack gives the data of places a to b."""
        bucket = bucket_of(by, self.buckets)
        starts, lengths = _runs(bucket) if len(bucket) else ((), ())
        for a, n in zip(starts, lengths, strict=True):
            yield int(self.file_of(bucket[a])), int(bucket[a]), pack(a, a + n)


_ROWS = "file long, bucket long, data binary, numbers array<long>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], names=["file", "bucket", "data", "numbers"])


def _packed(plan: Plan, hs: list[np.ndarray], w: np.ndarray, value: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
    """Rows of n-grams, sorted by context (hs: longest first; none for single words) and word. Contexts are written once each."""
    if not hs:
        yield from ((*r, None) for r in plan.rows(w, lambda a, b: _dump(w[a:b], value[a:b], count[a:b])))
        return

    def pack(a: int, b: int) -> bytes:
        starts, lengths = _runs(hs[0][a:b])
        return _dump(*[h[a:b][starts] for h in hs], lengths, w[a:b], value[a:b], count[a:b])

    yield from ((*r, None) for r in plan.rows(hs[0], pack))


class _Count:
    """Each task's n-grams of the highest order: (contexts, word, occurrences, occurrences)."""

    def __init__(self, plan: Plan, order: int):
        self.plan, self.order = plan, order

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                w = tokens(t)
                held.append((*contexts(w, self.order), w))
                n += len(w)
                if n >= HELD:
                    yield self.send(held)
                    held, n = [], 0
        if n:
            yield self.send(held)

    def send(self, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        *hs, w = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((w, hs[0]))
        hs, w = [h[order] for h in hs], w[order]
        at = np.flatnonzero(np.r_[True, (hs[0][1:] != hs[0][:-1]) | (w[1:] != w[:-1])])
        c = np.diff(np.r_[at, len(w)])
        return _batch(list(_packed(self.plan, [h[at] for h in hs], w[at], c, c)))


# --- Files -------------------------------------------------------------------------------------------------------------


class Folder:
    """A folder by its URI: POSIX paths go by the operating system, others by Arrow's file systems."""

    def __init__(self, uri: str):
        where = urlparse(uri)
        self.uri, self.posix = uri, where.path if where.scheme in ("", "file") else None

    def _arrow(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def make(self) -> None:
        if self.posix:
            os.makedirs(self.posix, exist_ok=True)
        else:
            system, path = self._arrow()
            system.create_dir(path, recursive=True)

    def writer(self, name: str):
        """A stream to a file of its own; done() gives it its name, all at once, so that a task that runs twice does no harm."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        if self.posix:
            stream = open(f"{self.posix}/{part}", "wb")  # noqa: SIM115
            done = lambda: os.replace(f"{self.posix}/{part}", f"{self.posix}/{name}")
        else:
            system, path = self._arrow()
            stream = system.open_output_stream(f"{path}/{part}")
            done = lambda: system.move(f"{path}/{part}", f"{path}/{name}")
        return stream, done

    def read(self, name: str) -> np.ndarray | None:
        """The file's bytes, mapped where that can be; None if there is none."""
        if self.posix:
            path = f"{self.posix}/{name}"
            if not os.path.exists(path):
                return None
            return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
        system, path = self._arrow()
        if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            return None
        with system.open_input_file(f"{path}/{name}") as f:
            return np.frombuffer(f.read(), np.uint8)


#: Arrays of the store: bytes a row. What has ``-far`` holds (row, value) of the counts that don't fit.
_GRAMS, _CONTEXTS, _WORDS = {"gram": 1}, {"total": 4, "one": 4, "two": 4, "more": 4}, {"count": 4, "kinds": 4}


class _Files:
    """The files of one order and range, as buckets are appended."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.open, self.rows = Folder(folder), name, {}, {}
        self.folder.make()

    def _put(self, kind: str, data: bytes) -> None:
        if kind not in self.open:
            self.open[kind] = self.folder.writer(f"{self.name}-{kind}")
        self.open[kind][0].write(data)

    def add(self, kind: str, keys: np.ndarray, columns: dict[str, np.ndarray], widths: dict[str, int]) -> None:
        self._put(kind, keys.astype("<u8").tobytes())
        for c, x in columns.items():
            most = (1 << 8 * widths[c]) - 1
            far = np.flatnonzero(x >= most)
            self._put(f"{kind}-{c}", np.minimum(x, most).astype(f"<u{widths[c]}").tobytes())
            self._put(f"{kind}-{c}-far", np.stack([far + self.rows.get(kind, 0), x[far]], 1).astype("<u8").tobytes())
        self.rows[kind] = self.rows.get(kind, 0) + len(keys)

    def close(self) -> None:
        for stream, _ in self.open.values():
            stream.close()
        for _, done in self.open.values():
            done()


def _counts_of(values: np.ndarray) -> list[int]:
    return [int((values == k).sum()) for k in (1, 2, 3, 4)]


class _Add:
    """Goes through ranges' buckets in order: adds up n-grams of an order, appends them to the files, and emits what the next lower order needs, and a row of numbers a bucket (file -1)."""

    def __init__(self, plan: Plan, folder: str, order: int):
        self.plan, self.folder, self.order = plan, folder, order

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, files = (-1, -1), [], None
        for b in batches:
            for file, bucket, data in zip(b.column("file").to_pylist(), b.column("bucket").to_pylist(), b.column("data"), strict=True):
                if (file, bucket) != now:
                    if held:
                        yield self.bucket(held, files)
                        held = []
                    if file != now[0]:
                        if files:
                            files.close()
                        files = _Files(self.folder, f"{self.order}-{file:08d}")
                    now = file, bucket
                held.append(data.as_py())
        if held:
            yield self.bucket(held, files)
            files.close()

    def bucket(self, held: list[bytes], files: _Files) -> pa.RecordBatch:
        parts = [_load(d) for d in held]
        held.clear()
        n = self.order - 1  # contexts of a gram
        if not n:
            (w,), (kinds, count) = add_up([np.concatenate([p[0] for p in parts])], [np.concatenate([p[k] for p in parts]) for k in (1, 2)])
            files.add("word", w, {"count": count, "kinds": kinds}, _WORDS)
            return _batch([(-1, 0, None, [len(w), int(count.sum()), int(kinds.sum()), *_counts_of(kinds)])])
        hs = [np.concatenate([np.repeat(p[k], p[n].astype(np.int64)) for p in parts]) for k in range(n)]
        w, value, count = (np.concatenate([p[n + k] for p in parts]) for k in (1, 2, 3))
        del parts
        order = np.lexsort((w, hs[0]))
        hs, w = [h[order] for h in hs], w[order]
        at = np.flatnonzero(np.r_[True, (hs[0][1:] != hs[0][:-1]) | (w[1:] != w[:-1])])
        value, count = np.add.reduceat(value[order], at), np.add.reduceat(count[order], at)
        hs, w = [h[at] for h in hs], w[at]
        keys = gram_key(hs[0], w)
        order = np.argsort(keys, kind="stable")
        files.add("gram", keys[order], {"gram": value[order]}, _GRAMS)
        starts, _ = _runs(hs[0])
        per = lambda x: np.add.reduceat(x.astype(np.uint64), starts)
        files.add("context", hs[0][starts], {"total": per(value), "one": per(value == 1), "two": per(value == 2), "more": per(value > 2)}, _CONTEXTS)
        numbers = _counts_of(value)
        # each gram is one word to the left of the gram without its first word
        shorter = hs[1:]
        by = [*shorter[:1], w]
        order = np.lexsort(by[::-1])
        shorter, w, count = [h[order] for h in shorter], w[order], count[order]
        changed = w[1:] != w[:-1]
        if shorter:
            changed = changed | (shorter[0][1:] != shorter[0][:-1])
        at = np.flatnonzero(np.r_[True, changed])
        rows = list(_packed(self.plan, [h[at] for h in shorter], w[at], np.diff(np.r_[at, len(w)]), np.add.reduceat(count, at)))
        return _batch([*rows, (-1, 0, None, numbers)])


class Store:
    """Sorted keys of one order and kind with their columns, in files by range, of which a worker maps a bounded number."""

    def __init__(self, folder: str, plan: Plan, order: int, kind: str, widths: dict[str, int], mapped: OrderedDict):
        self.folder, self.plan, self.order, self.kind, self.widths, self.mapped = Folder(folder), plan, order, kind, widths, mapped

    def _read(self, name: str) -> np.ndarray | None:
        key = f"{self.folder.uri}/{name}"
        if key not in self.mapped:
            while len(self.mapped) >= OPEN:
                self.mapped.popitem(last=False)
            self.mapped[key] = self.folder.read(name)
        self.mapped.move_to_end(key)
        return self.mapped[key]

    def look(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A row of columns for each of the keys (sorted, as their hashes' ranges are); zeros for those that aren't there."""
        out = np.zeros((len(keys), len(self.widths)), np.int64)
        file = self.plan.file_of(bucket_of(hashes, self.plan.buckets))
        starts, lengths = _runs(file) if len(file) else ((), ())
        for a, n in zip(starts, lengths, strict=True):
            name = f"{self.order}-{file[a]:08d}-{self.kind}"
            found = self._read(name)
            if found is None or not len(found):
                continue
            k, want = found.view("<u8"), keys[a : a + n]
            i = np.minimum(np.searchsorted(k, want), len(k) - 1)
            hit = np.flatnonzero(k[i] == want)
            i = i[hit]
            for c, (column, width) in enumerate(self.widths.items()):
                v = self._read(f"{name}-{column}").view(f"<u{width}")[i].astype(np.int64)
                far = np.flatnonzero(v == (1 << 8 * width) - 1)
                if len(far):
                    rows = self._read(f"{name}-{column}-far").view("<u8").reshape(-1, 2)
                    v[far] = rows[np.searchsorted(rows[:, 0], i[far].astype(np.uint64)), 1].astype(np.int64)
                out[a + hit, c] = v
        return out


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more, from how many have 1, 2, 3, 4. Where those are too few for the usual estimates: 0.75 of each count's room."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return np.array([0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([min(max(x, 0.05 * (k > 0)), k) for k, x in enumerate(d)])


class Model:
    """What a worker needs beside the files: numbers. grams: counts of counts from order 2 up."""

    def __init__(self, folder: str, plan: Plan, grams: list[list[int]], words: list[int]):
        self.folder, self.plan, self.order = folder, plan, len(grams) + 1
        self.d = [discounts(g) for g in grams]
        self.vocabulary, self.tokens, self.kinds = words[:3]
        self.d1 = discounts(words[3:])
        n1, n2 = words[3], words[4]
        self.rest = float(self.d1[1] * n1 + self.d1[2] * n2 + self.d1[3] * (self.vocabulary - n1 - n2)) / self.kinds if self.kinds else 1.0
        self.stores = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"stores": None}

    def score(self, hs: list[np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of w, log10 P(w | context)) of each token; hs: contexts, longest first."""
        if self.stores is None:
            mapped: OrderedDict[str, np.ndarray | None] = OrderedDict()
            store = lambda order, kind, widths: Store(self.folder, self.plan, order, kind, widths, mapped)
            self.stores = [(store(n, "gram", _GRAMS), store(n, "context", _CONTEXTS)) for n in range(2, self.order + 1)], store(1, "word", _WORDS)
        grams, words = self.stores

        def look(store: Store, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            u, first, back = np.unique(keys, return_index=True, return_inverse=True)
            return store.look(u, hashes[first])[back]

        word = look(words, w, w)
        k = word[:, 1]
        p = ((np.maximum(k - self.d1[np.minimum(k, 3)], 0) / self.kinds) if self.kinds else 0.0) + self.rest / (self.vocabulary + 1)
        p = np.broadcast_to(p, len(w))
        for (gram, context), d, h in zip(grams, self.d, hs[::-1], strict=True):
            known = look(context, h, h)
            c = look(gram, gram_key(h, w), h)[:, 0]
            p = np.where(known[:, 0] > 0, (np.maximum(c - d[np.minimum(c, 3)], 0) + (known[:, 1:] @ d[1:]) * p) / np.maximum(known[:, 0], 1), p)
        return word[:, 0], np.log10(p)


class _Score:
    def __init__(self, sent):
        self.sent = sent

    def __call__(self, ids: list, held: list, texts: list) -> dict:
        model: Model = self.sent.value
        out = {"doc_id": ids, "held_out": held, "n_tokens": [], "n_known": [], "train_tokens": [model.tokens] * len(ids), "base_score": [], "score": [], "perplexity": []}
        group, n = [], 0
        for i, t in enumerate(texts):
            w = tokens(t)
            group.append((*contexts(w, model.order), w))
            n += len(w)
            if n >= 500_000 or i == len(texts) - 1:
                sizes = np.array([len(g[-1]) for g in group])
                *hs, w = map(np.concatenate, zip(*group, strict=True))
                c, p = model.score(hs, w)
                at = np.cumsum(sizes) - sizes
                base = np.log10((c + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
                out["n_tokens"] += sizes.tolist()
                out["n_known"] += np.add.reduceat((c > 0).astype(np.int64), at).tolist()
                out["base_score"] += np.add.reduceat(base, at).tolist()
                score = np.add.reduceat(p, at)
                out["score"] += score.tolist()
                out["perplexity"] += (10 ** (-score / sizes)).tolist()
                group, n = [], 0
        return out


def train(docs: DataFrame, folder: str, text_col: str = "text", order: int = ORDER) -> Model:
    """Count docs and write the files of a model of this order (2 at least) below folder, a path in the shared folder."""
    if order < 2:
        raise ValueError("the order must be 2 at least")
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`")
    plan = Plan(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    rows = docs.select(text.alias("text")).mapInArrow(Task(_Count(plan, order), __name__), _ROWS)
    numbers = []
    for n in range(order, 0, -1):
        dealt = rows.select("file", "bucket", "data").repartition(plan.files, "file").sortWithinPartitions("file", "bucket")
        # once, since it writes files; what it emits is kept for the next order
        dealt.mapInArrow(Task(_Add(plan, folder, n), __name__), _ROWS).write.option("compression", "zstd").parquet(f"{folder}/rows-{n}")
        kept = spark.read.schema(_ROWS).parquet(f"{folder}/rows-{n}")
        found = kept.filter("file = -1").agg(*[F.sum(F.col("numbers")[i]) for i in range(4 if n > 1 else 7)]).first()
        numbers.append([int(x or 0) for x in found])
        rows = kept.filter("file >= 0")
        if n < order:
            remove(spark, f"{folder}/rows-{n + 1}")
    remove(spark, f"{folder}/rows-1")
    return Model(folder, plan, numbers[-2::-1], numbers[-1])


def score(docs: DataFrame, model: Model, held_out: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text), perplexity (a token's, from the score) of each row."""
    three = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{held_out}`").alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return scan(three, ["doc_id", "held_out", "text"], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", _Score(docs.sparkSession.sparkContext.broadcast(model)))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0).alias("held_out"))
    folder = scratch(spark, "lm")
    model = train(docs.filter("NOT held_out"), folder)
    scored = score(docs, model).checkpoint()  # narrow rows; the model's files go
    remove(spark, folder)
    return scored
