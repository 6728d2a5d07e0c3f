"""Operator 5, n-gram Jaccard join: a parity-sketch join.

A document's set holds its distinct 5-word shingles; two documents link when 100 * |A and B| >= 80 * |A or B|, that is when their symmetric difference is at most (|A| + |B|) / 9.

Sketches. Within a size band [L, 2L), shingles fall by hash into about 4L / 3 segments, and a segment's sketch is the XOR of its shingles' hashes. A shingle that one set has and the
other lacks toggles one segment only, so the number of differing segments is a lower bound of the symmetric difference: linked sets differ in d = (|A| + |B|) // 9 segments at most.
By the pigeonhole principle, of a set's e segments that aren't empty, e - d or more are equal in the other set; so among any agreed order's first d + 1 segments of either set,
one is in both. Those segments are the join keys. The order puts segments of frequent shingles last (a table of bounded size, counted over all documents), so shared
passages seldom are keys. Sets that may reach into the next band emit keys there too; a pair meets in its larger set's band.

Candidates. Sets that are equal are one class. Keys are packed by task and bucket, and each bucket (of a size fixed beforehand) finds keys that several classes share. A class also has a parity
sketch of about 2 to 4 bits a shingle: each shingle toggles one bit, so the Hamming distance of two sketches (the longer one folded) is a lower bound of the symmetric difference too, and pairs beyond
d are dropped by it. Instead of all pairs within a key, each class is first held against one class of each of its keys, and verified against one that passes; verified links make
components. Where a key still has several components, sketches are compared within the key (in blocks of bounded size), between components only: first as many pairs as would join them are
verified, then, for what is left, all that pass. So no link is lost, and a group of copies costs about its size, not its square.

Verification compares whole sets of 64-bit shingle hashes. Classes are known by 64 bits too.

Null and empty texts, and texts without words, have no set and link with nothing. Null ids stay, as their own rows; a component's id is its smallest id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Task, by_group, documents, lower_words, mix, ngram_hashes, prepare, release, scan, scratch, small, word_hashes

N = 5
#: Entries of the table of frequent shingles; those that a task names at most.
FREQUENT, NAMED = 1 << 16, 20_000
#: Keys of a bucket, as planned; keys that a task holds before it sends them off.
BUCKET_KEYS, HELD = 500_000, 1_200_000
#: Classes of a key, and bytes of their sketches, that are compared at once; larger groups are dealt out in pairs of blocks. Rows and bytes of a bucket, as planned.
GROUP, GROUP_BYTES, BUCKET_ROWS, BUCKET_BYTES = 4096, 16 << 20, 20_000, 32 << 20
#: Parts that sketches are dealt out in, one after the other, so that only one part's shuffle lies on disk.
WAVES = 3
_U = np.uint64


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The set's hashes, sorted: of all n-word shingles, or of the whole sequence if it is shorter."""
    w = word_hashes(lower_words(text))
    if 0 < len(w) < n:
        return mix(ngram_hashes(w, len(w)) + _U(len(w)))
    s = np.sort(ngram_hashes(w, n))
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def class_of(s: np.ndarray) -> int:
    """64 bits that equal sets share; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def sketch_of(s: np.ndarray) -> bytes:
    """The parity sketch: a power of two of bits, twice the set's size at least."""
    bits = 1 << max(6, (2 * len(s)).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, at the shorter one's length."""
    x, y = (np.frombuffer(v, np.uint64) for v in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _segments(low: int) -> int:
    """Segments of the band from low on. Small bands have far more than shingles, so that few share one."""
    return -(-4 * low // 3) if low >= 64 else 1 << 20


class Frequent:
    """The table of frequent shingles: sorted hashes and counts, and a bitmap that most other shingles fail."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> _U(44)] = True

    def count(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.uint64)
        at = np.flatnonzero(self.maybe[s >> _U(44)])
        if len(at):
            i = np.minimum(np.searchsorted(self.hashes, s[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[i] == s[at], self.counts[i], 0)
        return out


def keys_of(s: np.ndarray, frequent: Frequent) -> np.ndarray:
    """The set's join keys: in each band that it takes part in, the first d + 1 segments, by their rarest shingle's count, then by hash."""
    n = len(s)
    low = 1 << (n.bit_length() - 1)
    bands = [(low, (n + min(5 * n // 4, 2 * low - 1)) // 9)]
    if 5 * n // 4 >= 2 * low:
        bands.append((2 * low, (n + 5 * n // 4) // 9))
    often = np.minimum(frequent.count(s), _U(0xFFFF))
    out = []
    for band, d in bands:
        seg = (s >> _U(32)) * _U(_segments(band)) >> _U(32)  # in order, as s is
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        key = mix(np.bitwise_xor.reduceat(s, first) + (seg[first] << _U(20)) + _U(band.bit_length()))
        if d + 1 < len(key):
            key = key[np.argpartition(np.minimum.reduceat(often, first) << _U(48) | key >> _U(16), d)[: d + 1]]
        out.append(key)
    return np.concatenate(out)


_STATS = "doc_id long, n long, cls long, text_key long, sketch binary, shingle long, times long"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document; and rows (shingle, times) of those that many of the task's classes have."""

    def rows(**cols: np.ndarray | list) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        kinds = {x.split()[0]: pa.binary() if x.endswith("binary") else pa.int64() for x in _STATS.split(", ")}
        return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

    def named() -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        often = np.flatnonzero(c >= max(3, len(held) // 200))
        often = often[np.argsort(-c[often], kind="stable")[:NAMED]]
        return rows(shingle=u[often].view(np.int64), times=c[often])

    held, seen, size = [], set(), 0
    for b in batches:
        ids, texts, keys = [b.column(i).to_pylist() for i in range(3)]
        ns, classes, sketches = [], [], []
        for t in texts:
            s = shingles(t)
            c = class_of(s)
            ns.append(len(s))
            classes.append(c)
            sketches.append(sketch_of(s))
            if c not in seen and len(s):
                seen.add(c)
                held.append(s)
                size += len(s)
            if size >= HELD:
                yield named()
                held, size, seen = [], 0, set()
        yield rows(doc_id=ids, n=ns, cls=classes, text_key=keys, sketch=sketches)
    if held:
        yield named()


def sketch_bytes(n: int) -> int:
    """The length of sketch_of a set of n."""
    return 1 << max(3, (2 * n).bit_length() - 3)


class _Keys:
    """Packed keys. To the bucket of its key goes one class for each key and task, so a frequent key comes there once a task; all classes of a key that the task has two or more of stay together in a
    row of their own, of a bucket below 0 that no other task has. Entries of such keys in the common bucket are marked by the owner's top bit."""

    def __init__(self, sent, buckets: int):
        self.sent, self.buckets = sent, buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = self.sent.value
        held, owners, size, seen = [], [], 0, set()
        own = -1 - (TaskContext.get().partitionId() << 24)
        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    held.append(keys_of(s, frequent))
                    owners.append((c, sketch_bytes(len(s))))
                    size += len(held[-1])
                if size >= HELD:
                    yield self.send(held, owners, own)
                    held, owners, size, seen, own = [], [], 0, set(), own - 1
        if held:
            yield self.send(held, owners, own)

    def send(self, held: list[np.ndarray], owners: list[tuple[int, int]], own_bucket: int) -> pa.RecordBatch:
        """A row a bucket: its keys, sorted, and their owners' numbers in a table."""
        table, width = (np.array(x, np.int64) for x in zip(*owners, strict=True))
        by_class = np.argsort(table)
        table, width = table[by_class], width[by_class]
        key = np.concatenate([held[k] for k in by_class.tolist()])
        own = np.repeat(np.arange(len(held), dtype=np.uint32), [len(held[k]) for k in by_class.tolist()])
        order = np.argsort(key, kind="stable")  # owners of a key rise: the first one is its smallest class
        key, own = key[order], own[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        key, own = key[fresh], own[fresh]
        first = np.r_[True, key[1:] != key[:-1]]
        local = ~(first & np.r_[first[1:], True])
        # a key has the same name in both kinds of rows: the bucket's number stands for its 16 top bits
        named = key & _U((1 << 48) - 1) | ((key >> _U(40)) * _U(self.buckets) >> _U(24) & _U(0xFFFF)) << _U(48)
        out = [self.packed(own_bucket, named[local], own[local], np.zeros(int(local.sum()), bool), table, width, 8)] if local.any() else []
        key, own, local = key[first], own[first], local[first]
        bucket = (key >> _U(40)) * _U(self.buckets) >> _U(24)
        ends = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64))
        out += [self.packed(k, key[a:b], own[a:b], local[a:b], table, width, 6) for k in np.flatnonzero(np.diff(ends)).tolist() for a, b in [ends[k : k + 2]]]
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "keys", "owner", "classes", "widths"])

    @staticmethod
    def packed(bucket: int, key: np.ndarray, own: np.ndarray, marked: np.ndarray, table: np.ndarray, width: np.ndarray, size: int) -> tuple:
        u, small = np.unique(own, return_inverse=True)
        owner = small.astype(np.uint32) | marked.astype(np.uint32) << np.uint32(31)
        return bucket, np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes(), owner.tobytes(), table[u].tobytes(), width[u].tobytes()


def _shared_keys(table: pa.Table) -> pa.Table:
    """Keys of a bucket that two classes or more have: a row for each of them, with the smallest of them (lead); extra: the class has a row of this key in its task's own bucket too."""
    keys, classes, widths, marks = [], [], [], []
    for b, k, o, c, w in zip(*[table.column(n).to_pylist() for n in ("bucket", "keys", "owner", "classes", "widths")], strict=True):
        o = np.frombuffer(o, np.uint32)
        marks.append(o >> np.uint32(31) == 1)
        o = o & np.uint32((1 << 31) - 1)
        if b < 0:
            keys.append(np.frombuffer(k, np.uint64))
        else:
            # 48 bits of the key travel; the bucket tells the rest. Should two keys fall together, their classes are compared in vain
            low = np.frombuffer(k, np.uint8).reshape(-1, 6)
            wide = np.zeros((len(low), 8), np.uint8)
            wide[:, :6] = low
            keys.append(wide.view(np.uint64).reshape(-1) | _U(b & 0xFFFF) << _U(48))
        classes.append(np.frombuffer(c, np.int64)[o])
        widths.append(np.frombuffer(w, np.int64)[o])
    key, cls, width, extra = map(np.concatenate, (keys, classes, widths, marks))
    order = np.lexsort((~extra, cls, key))
    key, cls, width, extra = key[order], cls[order], width[order], extra[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
    key, cls, width, extra = key[new], cls[new], width[new], extra[new]
    first = np.r_[True, key[1:] != key[:-1]]
    lead = cls[np.maximum.accumulate(np.where(first, np.arange(len(cls)), 0))]
    alone = first & np.r_[first[1:], True]
    return pa.table({"key": pa.array(key[~alone].view(np.int64)), "cls": pa.array(cls[~alone]), "lead": pa.array(lead[~alone]), "width": pa.array(width[~alone]), "extra": pa.array(extra[~alone])})


def _sets(texts: list) -> dict:
    found = [shingles(t) for t in texts]
    return {"cls": [class_of(s) for s in found], "shingles": [s.tobytes() for s in found]}


def _near(a: list, b: list, n: list, m: list, x: list, y: list) -> dict:
    return {"a": a, "b": b, "near": [9 * distance(p, q) <= k + l for k, l, p, q in zip(n, m, x, y, strict=True)]}


def _linked(a: list, b: list, x: list, y: list) -> dict:
    out = []
    for p, q in zip(x, y, strict=True):
        p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        both = np.sort(np.concatenate([p, q]))
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= 80 * (len(both) - common))
    return {"a": a, "b": b, "linked": out}


class _Compare:
    """Pairs (a, b) of different components in groups (key, lo, hi) whose sizes and sketches allow a link. forest: only as many as join the group's components, and key where more would pass."""

    def __init__(self, forest: bool):
        self.forest = forest

    def __call__(self, table: pa.Table) -> pa.Table:
        cols = {k: table.column(k).to_numpy() for k in ("key", "lo", "hi", "block", "cls", "comp", "n")}
        sketches = table.column("sketch").to_pylist()
        order = np.lexsort((cols["cls"], cols["hi"], cols["lo"], cols["key"]))
        key, lo, hi = (cols[k][order] for k in ("key", "lo", "hi"))
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        a, b, left = [], [], []
        for i, j in zip(first, [*first[1:], len(order)], strict=True):
            x, y, more = self.group(order[i:j], cols, sketches, lo[i] == hi[i])
            a.append(x)
            b.append(y)
            if more:
                left.append(key[i])
        none = np.empty(0, np.int64)
        a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        left, gap = np.unique(np.array(left, np.int64)), pa.nulls
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(pairs[:, 0]), gap(len(left), pa.int64())]),
                "b": pa.concat_arrays([pa.array(pairs[:, 1]), gap(len(left), pa.int64())]),
                "key": pa.concat_arrays([gap(len(pairs), pa.int64()), pa.array(left)]),
            }
        )

    def group(self, rows: np.ndarray, cols: dict, sketches: list, within: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        comp, block, cls, n = (cols[k][rows] for k in ("comp", "block", "cls", "n"))
        u, back, size = np.unique(comp, return_inverse=True, return_counts=True)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # rows of all components but the largest, against all
        few = np.flatnonzero(back != np.argmax(size))
        lengths = np.array([len(sketches[r]) for r in rows])
        for p in np.unique(lengths[few]) if len(few) else []:
            left = few[lengths[few] == p]
            for q in np.unique(lengths):
                right = np.flatnonzero(lengths == q)
                w = min(p, q)
                x, y = self.folded(sketches, rows[left], w), self.folded(sketches, rows[right], w)
                step = max(1, (1 << 22) // (len(right) * x.shape[1]))
                for k in range(0, len(left), step):
                    l = left[k : k + step]
                    d = np.bitwise_count(x[k : k + step, None] ^ y[None]).sum(2, dtype=np.int64)
                    m, r = n[l][:, None], n[right][None]
                    fine = (comp[l][:, None] != comp[right][None]) & (9 * d <= m + r) & (5 * m >= 4 * r) & (5 * r >= 4 * m)
                    if not within:
                        fine &= block[l][:, None] != block[right][None]
                    i, j = np.nonzero(fine)
                    found.append((l[i], right[j]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), False
        i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        passed = len(i)
        if self.forest and passed:
            parent = list(range(len(u)))

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            kept = []
            for k, (c, e) in enumerate(zip(back[i].tolist(), back[j].tolist(), strict=True)):
                c, e = root(c), root(e)
                if c != e:
                    parent[c] = e
                    kept.append(k)
            i, j = i[kept], j[kept]
        return cls[i], cls[j], len(i) < passed

    @staticmethod
    def folded(sketches: list, rows: np.ndarray, width: int) -> np.ndarray:
        """The rows' sketches (of one length), folded to width bytes, as words."""
        x = np.frombuffer(b"".join([sketches[r] for r in rows]), np.uint64).reshape(len(rows), -1)
        while x.shape[1] * 8 > width:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """cls, comp: the smallest class that each class of the edges reaches. Labels go along edges and along labels until none changes; each step is cut off by a checkpoint."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct().checkpoint()
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("comp")).withColumnRenamed("x", "cls").checkpoint()
    while True:
        heard = both.join(labels, F.col("y") == F.col("cls")).groupBy("x").agg(F.min("comp").alias("heard"))
        near = labels.join(heard, F.col("cls") == F.col("x")).select("cls", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        far = labels.select(F.col("cls").alias("at"), F.col("comp").alias("further"))
        new = near.join(small(far), F.col("comp") == F.col("at")).select("cls", "old", F.least("comp", "further").alias("comp")).checkpoint()
        labels = new.select("cls", "comp")
        if new.filter("comp <> old").isEmpty():
            return labels


class Join:
    """One run's tables: rows (doc_id, n, cls, text_key) of all documents, and the shared keys (key, cls, lead, width, extra)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        prepare(self.spark)
        text = F.col(f"`{text_col}`")
        self.docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        stats = self.docs.select("doc_id", "text", "text_key").mapInArrow(Task(_stats, __name__), _STATS).checkpoint()
        self.rows = stats.filter("n IS NOT NULL").select("doc_id", "n", "cls", "text_key", "sketch")
        often = stats.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.col("times").desc(), "shingle").limit(FREQUENT).toPandas()
        sent = self.spark.sparkContext.broadcast(Frequent(often["shingle"].to_numpy(np.int64).view(np.uint64), often["times"].to_numpy(np.int64).view(np.uint64)))
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        buckets = max(16, -(-total // 3 // BUCKET_KEYS))
        packed = self.docs.select("text").mapInArrow(Task(_Keys(sent, buckets), __name__), "bucket long, keys binary, owner binary, classes binary, widths binary")
        self.shared = packed.groupBy("bucket").applyInArrow(by_group(_shared_keys), "key long, cls long, lead long, width long, extra boolean")
        self.shared = self.kept(self.shared)
        #: cls, n, sketch, and the row (doc_id, text_key) that stands for the class
        self.classes = self.rows.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n", "sketch")).alias("r")).select("cls", "r.doc_id", "r.text_key", "r.n", "r.sketch").join(self.shared.select("cls").distinct(), "cls", "left_semi").checkpoint()
        del packed
        release(self.spark)

    def kept(self, df: DataFrame) -> DataFrame:
        """df as a table in the shared folder: for long tables, whose columns compress, smaller than a checkpoint."""
        df.write.parquet(path := scratch(self.spark, "keys"))
        return self.spark.read.schema(df.schema).parquet(path)

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches allow a link."""
        sides = [self.classes.select(F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b").filter("5 * n_a >= 4 * n_b AND 5 * n_b >= 4 * n_a")
        return scan(both, ["a", "b", "n_a", "n_b", "s_a", "s_b"], "a long, b long, near boolean", _near).filter("near").select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b; kept in a checkpoint) with whether they link."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        need = small(self.classes.join(wanted, "cls", "left_semi").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).checkpoint())
        texts = self.docs.join(need, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_semi")
        # kept, so that the join below deals both its sides out by itself and can split a class that many others are held against
        sets = self.kept(scan(texts, ["text"], "cls long, shingles binary", _sets).groupBy("cls").agg(F.first("shingles").alias("shingles")))
        found = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
        return scan(found, ["a", "b", "x", "y"], "a long, b long, linked boolean", _linked).checkpoint()

    def compared(self, mixed: DataFrame, forest: bool) -> DataFrame:
        """As _Compare has it. mixed: key, cls, comp, width, blocks (of the key's group)."""
        rows, size = mixed.agg(F.sum("blocks"), F.sum(F.col("blocks") * F.col("width"))).first()
        buckets = max(16, -(-rows // BUCKET_ROWS), -(-size // BUCKET_BYTES))
        dealt = mixed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        dealt = dealt.join(self.classes.select("cls", "n", "sketch"), "cls").select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "comp", "n", "sketch")
        dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(buckets)))
        found = None
        for wave in range(WAVES):
            part = dealt.filter(F.col("bucket") % WAVES == wave).groupBy("bucket").applyInArrow(by_group(_Compare(forest)), "a long, b long, key long").checkpoint()
            found = part if found is None else found.unionByName(part)
            release(self.spark)
        return found

    def labels(self) -> DataFrame:
        """cls, comp of the classes that link with another."""
        links, tried, labels, shared = None, None, None, self.shared
        for turn in ("star", "forest", "all"):
            if turn == "star":
                # one class of each key (of a task, and of all tasks) against the others; of those that pass, one for each class
                pairs = self.near(shared.filter("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b")).distinct()).groupBy("a").agg(F.min("b").alias("b"))
            else:
                # keys that have several components still; after the forest, those of them where more pairs pass than it took
                known = shared.withColumn("comp", F.col("cls")) if labels is None else shared.join(small(labels), "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"), "width")
                known = known.select("key", "cls", "comp", "width")
                blocks = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("width") / GROUP_BYTES)).cast("long").alias("blocks")
                mixed = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), blocks).filter("x < y").select("key", "blocks").checkpoint()
                known = self.kept(known.join(small(mixed), "key"))
                release(self.spark)
                if known.isEmpty():
                    break
                pairs = self.compared(known, turn == "forest")
                shared = known.select("key", "cls", "width").join(small(pairs.filter("key IS NOT NULL").select("key").distinct()), "key", "left_semi")
                shared = self.kept(shared)
                pairs = pairs.filter("a IS NOT NULL")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = pairs.checkpoint()
            if not pairs.isEmpty():
                done = self.verified(pairs)
                tried = done.select("a", "b") if tried is None else tried.unionByName(done.select("a", "b"))
                new = done.filter("linked").select("a", "b")
                links = new if links is None else links.unionByName(new)
                labels = components(links)
            release(self.spark)
            if turn == "star":
                shared = shared.filter("NOT extra").drop("lead", "extra")
            if turn == "forest" and shared.isEmpty():
                break
        return labels if labels is not None else self.spark.createDataFrame([], "cls long, comp long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n, comp (the group's smallest class) of each row."""
    j = Join(docs, id_col, text_col)
    return j.rows.join(small(j.labels()), "cls", "left").select("doc_id", "text_key", "n", F.coalesce("comp", "cls").alias("comp")).checkpoint()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    known = grouped(docs, id_col, text_col)
    full = known.filter("n > 0")
    # most rows are alone in their component: only the others look theirs up
    least = small(full.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows").checkpoint())
    return full.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(known.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, repeated: of each group, the smallest id (null ids last) and text_key, and whether several rows have both. Texts without words are no one's duplicates: all are listed, as not repeated."""
    known = grouped(docs, id_col, text_col)
    rows = known.filter("n > 0").groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "rows")).alias("r"))
    return first.select("r.doc_id", "r.text_key", (F.col("r.rows") > 1).alias("repeated")).unionByName(known.filter("n = 0").select("doc_id", "text_key", F.lit(False).alias("repeated")).distinct())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
