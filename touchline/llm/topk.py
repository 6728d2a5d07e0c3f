"""Operator 3, exact top-k search: a bit-sliced index.

Candidates lie in blocks of ``BLOCK`` rows. A block holds each quantised attribute as bit slices: bitmaps over the block's rows, one a binary digit. For a query, the slices of all
attributes are added, shifted by the digits of the query's own value and inverted where that is negative: full adders take three bitmaps of one weight to a sum and a carry, until each weight
has one bitmap left. Those are the slices of all rows' scores. Top rows are then selected from the most significant slice downward: rows with the digit set go in as long as they fit. Rows
that tie at the boundary are resolved exactly, by id, and the chosen rows' scores are computed exactly.

Every block of queries meets every block of candidates in a group of its own, so groups have a fixed size whatever the input's. Both blocks are large, so a row travels once for some ten thousands of
rows of the other kind. No row leaves its block but a block's best k of a query.

Rows without an id, and vectors that are null or hold null or non-finite components, take no part. Shorter vectors count as filled up with zeros. Repeated rows are candidates each; rows
of the query's own id are none; repeated queries give their rows each, ranked together. An empty table gives an empty result. Rows with a component of 2**52 or more (quantised) go by whole numbers
of any size, by themselves; scores beyond a long, which its column can't hold, are cut to its range, and tie there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_group, prepare

BLOCK, QUERIES = 32_768, 16_384
#: Groups at least, as far as there are queries for them.
GROUPS = 64
SCALE, K, EVERY = 64, 20, 20
_LARGE, _LONG = 1 << 52, (1 << 63) - 1


class SlicedBlock:
    """The bit-sliced index of one block. values: int64, a row each, sorted by id."""

    def __init__(self, values: np.ndarray):
        n, self.width = values.shape
        self.n, self.low = n, int(values.min(initial=0))
        raised = values - self.low
        self.bits = max(1, int(raised.max(initial=0)).bit_length())
        words = -(-n // 64)
        self.slices = np.zeros((self.width, self.bits, words), np.uint64)
        for i in range(self.bits):
            packed = np.packbits(((raised >> i) & 1).astype(np.uint8), axis=0).T
            self.slices.view(np.uint8)[:, i, : packed.shape[1]] = packed
        self.all = np.zeros(words, np.uint64)
        self.all.view(np.uint8)[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8))

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of every row's score, less a constant that is the query's alone."""
        size, negative = np.abs(q), q < 0
        flip = np.where(negative, ~np.uint64(0), np.uint64(0))
        weights: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            d = np.flatnonzero((size >> j) & 1)
            if len(d):
                part = self.slices[d] ^ flip[d, None, None]
                for i in range(self.bits):
                    weights.setdefault(i + j, []).append(part[:, i])
        out, w = [], 0
        while weights:
            rows = weights.pop(w, [])
            x = np.concatenate(rows) if rows else np.zeros((1, len(self.all)), np.uint64)
            carries = []
            while len(x) > 2:
                k = len(x) // 3
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                half = a ^ b
                carries.append((a & b) | (half & c))
                x = np.concatenate([half ^ c, x[3 * k :]])
            if len(x) == 2:
                carries.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
            out.append(x[0])
            if carries:
                weights.setdefault(w + 1, []).extend(carries)
            w += 1
        return out

    def top(self, q: np.ndarray, k: int, allowed: np.ndarray) -> np.ndarray:
        """Places of the k best allowed rows (a bitmap), ties to the first places; not in order."""
        sure, maybe = np.zeros_like(self.all), allowed
        need = k
        if int(np.bitwise_count(maybe).sum()) > k:
            for s in reversed(self.scores(q)):
                ones = maybe & s
                n = int(np.bitwise_count(ones).sum())
                if n > need:
                    maybe = ones
                else:
                    sure, maybe, need = sure | ones, maybe & ~s, need - n
                    if need == 0:
                        break
        return np.concatenate([self._places(sure), self._places(maybe)[:need]])

    def _places(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8))[: self.n])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None] < sizes[:, None]] = values
    return out


class _Group:
    def __init__(self, k: int, scale: int):
        self.k, self.scale = k, scale

    def __call__(self, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        asks = table.column("ask").to_numpy(zero_copy_only=False)
        v = np.floor(_matrix(table.column("v")) * self.scale)
        large = (np.abs(v) >= _LARGE).any(1)
        cand = np.flatnonzero(~asks)
        cand = cand[np.argsort(ids[cand], kind="stable")]
        plain, huge = cand[~large[cand]], cand[large[cand]]
        whole = np.where(large[:, None], 0, v).astype(np.int64)
        block, own = SlicedBlock(whole[plain]), ids[plain]
        safe = int(np.abs(whole).max(initial=0)) ** 2 * v.shape[1] <= _LONG
        out_q, out_v, out_s = [], [], []

        def exact(i: int, rows: np.ndarray) -> list[int]:
            q = [int(x) for x in v[i]]
            return [min(max(sum(int(a) * b for a, b in zip(v[c], q, strict=True)), -_LONG - 1), _LONG) for c in rows]

        for i in np.flatnonzero(asks):
            if large[i]:
                at = plain[own != ids[i]]
                found = list(zip(exact(i, at), ids[at].tolist(), strict=True))
            elif len(plain):
                allowed = block.all
                a, b = np.searchsorted(own, ids[i]), np.searchsorted(own, ids[i], side="right")
                if a < b:
                    hole = np.ones(len(allowed) * 64, np.uint8)
                    hole[a:b] = 0
                    allowed = allowed & np.packbits(hole).view(np.uint64)
                at = plain[block.top(whole[i], self.k, allowed)]
                found = list(zip((whole[at] @ whole[i]).tolist() if safe else exact(i, at), ids[at].tolist(), strict=True))
            else:
                found = []
            if len(huge):
                at = huge[ids[huge] != ids[i]]
                found += zip(exact(i, at), ids[at].tolist(), strict=True)
            if len(found) > self.k or large[i] or len(huge):
                found = sorted(found, key=lambda x: (-x[0], x[1]))[: self.k]
            out_q += [int(ids[i])] * len(found)
            out_v += [x for _, x in found]
            out_s += [s for s, _ in found]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of vectors with the largest inner products with each row of queries, quantised as floor(scale * x)."""
    spark = vectors.sparkSession
    prepare(spark)

    def usable(df: DataFrame) -> DataFrame:
        fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine)).withColumn("h", F.xxhash64("vec_id"))

    cand, ask = usable(vectors), usable(queries)
    n_cand, asked = max(1, -(-vectors.count() // BLOCK)), queries.count()
    n_ask = max(1, -(-asked // QUERIES), min(-(-GROUPS // n_cand), -(-asked // 256)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = cand.select(F.pmod("h", F.lit(n_cand)).cast("int").alias("c"), numbers(n_ask).alias("q"), "vec_id", "v", F.lit(False).alias("ask")).unionByName(
        ask.select(numbers(n_cand).alias("c"), F.pmod("h", F.lit(n_ask)).cast("int").alias("q"), "vec_id", "v", F.lit(True).alias("ask"))
    )
    best = both.repartition(max(n_cand * n_ask, 2), "c", "q").groupBy("c", "q").applyInArrow(by_group(_Group(k, scale)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


#: DuckDB, for op3_top_k.
SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
