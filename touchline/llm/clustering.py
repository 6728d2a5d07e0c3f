"""Operator 13, centroid clustering: plain Lloyd.

Each round broadcasts the centroids; a task computes, in NumPy, the integer squared differences of its vectors to each centroid, takes the nearest (argmin: ties to the lowest number), and adds its
vectors up by centroid: whole numbers, a few rows a task. A groupBy merges them, and the driver, which gets a row for each centroid and limb, divides. Sums and distances are exact whole numbers, so the
result doesn't depend on how rows are dealt out, and a lost task is computed again to the same sums.

Vectors with exactly ``dims`` components, none null or non-finite, are kept, whatever their size: components of ``_PLAIN`` or more (quantised) are told apart and added up as whole numbers of any size,
in limbs of 24 bits. Only the distances of such vectors can lie beyond a long: those are written as the largest long, and so are sums beyond it.

Centroids start as the kept vectors of the smallest sha256 of ``seed:id``, in ascending order; rows of a repeated id go by their components, and rows without an id come last, so. Repeated rows are
vectors each. With fewer kept vectors than centroids, there are as many centroids as vectors; equal centroids share nothing, as the lowest number takes all. A centroid without vectors stays. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, prepare

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Quantised components below this in size have distances that fit a long, at up to 256 components.
_PLAIN = 1 << 26
_LIMB, _LONG = 24, (1 << 63) - 1
#: Rows whose distances are computed at once.
_ROWS = 4096


def quantised(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix: int64, or whole numbers of any size where a component is large. scale: a power of two, so that the product is exact."""
    with np.errstate(over="ignore"):
        q = np.floor(v * scale)
    if (np.abs(q) < _PLAIN).all():
        return q.astype(np.int64)
    whole = [[int(x) * scale if abs(x) >= 2.0**53 else int(y) for x, y in zip(a, b, strict=True)] for a, b in zip(v.tolist(), q.tolist(), strict=True)]
    return np.array(whole, object)


def nearest(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, and its squared distance."""
    big = q.dtype == object or any(abs(x) >= _PLAIN for c in centroids for x in c)
    c = np.array(centroids, object if big else np.int64)
    q = q.astype(object) if big else q
    d = np.stack([((q - x) ** 2).sum(1) for x in c], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(q)), at]


def _matrices(frames: Iterator[pd.DataFrame], scale: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows with their quantised vectors; rows with large components by themselves, so that the others keep to machine numbers."""
    for df in frames:
        for k in range(0, len(df), _ROWS):
            part = df.iloc[k : k + _ROWS]
            v = np.stack(part["v"].to_numpy()).astype(float)
            large = (np.abs(v) >= _PLAIN / scale - 1).any(1)
            for rows in (~large, large):
                if rows.any():
                    yield part[rows], quantised(v[rows], scale)


def _limbs(total: list[int]) -> list[list[int]]:
    """Whole numbers as lists of limbs, of the number's sign, least significant first."""
    out = []
    size, sign = [abs(x) for x in total], [-1 if x < 0 else 1 for x in total]
    while any(size) or not out:
        out.append([s * (x & ((1 << _LIMB) - 1)) for s, x in zip(sign, size, strict=True)])
        size = [x >> _LIMB for x in size]
    return out


class Lloyd:
    """One run over kept vectors (vec_id, v array<double>)."""

    def __init__(self, kept: DataFrame, dims: int, scale: int):
        self.kept, self.dims, self.scale, self.spark = kept, dims, scale, kept.sparkSession

    def first(self, k: int, seed: str) -> list[list[int]]:
        """The starting centroids."""
        order = (F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v"))
        rows = self.kept.orderBy(*order).limit(k).collect()
        return [[int(x) for x in quantised(np.array([r.v], float), self.scale)[0]] for r in rows]

    def sums(self, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
        """The number of each centroid's vectors and their sum, of those that have any."""
        sent, scale, names = self.spark.sparkContext.broadcast(centroids), self.scale, [f"s{i}" for i in range(self.dims)]

        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k = len(sent.value)
            number, total = np.zeros(k, np.int64), [[0] * len(names) for _ in range(k)]
            for _, q in _matrices(frames, scale):
                at, _ = nearest(q, sent.value)
                number += np.bincount(at, minlength=k)
                for c in np.unique(at).tolist():
                    # at most _ROWS rows below _PLAIN, or whole numbers of any size
                    total[c] = [a + int(b) for a, b in zip(total[c], q[at == c].sum(0), strict=True)]
            rows = [(c, limb, int(number[c]) if limb == 0 else 0, *part) for c in range(k) if number[c] for limb, part in enumerate(_limbs(total[c]))]
            yield pd.DataFrame(rows, columns=["cluster", "limb", "n", *names])

        parts = self.kept.select("v").mapInPandas(add, "cluster int, limb int, n long, " + ", ".join(f"{c} long" for c in names))
        merged = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
        sent.unpersist()
        out: dict[int, tuple[int, list[int]]] = {}
        for r in merged:
            n, total = out.get(r.cluster, (0, [0] * len(names)))
            out[r.cluster] = n + r.n, [t + (r[c] << (_LIMB * r.limb)) for t, c in zip(total, names, strict=True)]
        return out

    def assigned(self, centroids: list[list[int]]) -> DataFrame:
        """vec_id, cluster, distance of each vector."""
        sent, scale = self.spark.sparkContext.broadcast(centroids), self.scale

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, q in _matrices(frames, scale):
                at, d = nearest(q, sent.value)
                yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": at.astype(np.int32), "distance": np.minimum(d, _LONG).astype(np.int64)})

        # ids travel as strings, since pandas would turn longs beside nulls into doubles
        found = self.kept.withColumn("vec_id", F.col("vec_id").cast("string")).mapInPandas(ask, "vec_id string, cluster int, distance long")
        return found.withColumn("vec_id", F.col("vec_id").cast("long"))


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of each kept vector, kept in a checkpoint; the final centroids)."""
    prepare(vectors.sparkSession)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == dims) & F.forall("v", fine))
    run = Lloyd(kept, dims, scale)
    centroids = run.first(k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        for c, (n, total) in run.sums(centroids).items():
            centroids[c] = [x // n for x in total]
    return run.assigned(centroids).checkpoint(), centroids


def described(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows with cluster_inertia, inertia and centroid_sha256: the sums of a few centroids, broadcast."""
    cut = lambda s: F.least(s, F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    part = {r.cluster: r for r in rows.groupBy("cluster").agg(cut(F.sum(F.col("distance").cast("decimal(19,0)"))).alias("d")).collect()}
    total = min(sum(r.d for r in part.values()), _LONG)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = [(c, r.d, total, digests[c]) for c, r in part.items()]
    about = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    """DuckDB, for op13_centroid_clustering: the rounds one after the other, each a materialised relation of centroid components."""
    parts = [
        f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) ASC NULLS LAST, embedding) - 1 AS INTEGER) AS cluster, v AS c FROM vectors QUALIFY cluster < {CENTROIDS})"""
    ]
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for k in range(ROUNDS):
        parts.append(f"""
a{k} AS MATERIALIZED (SELECT row_id, arg_min(cluster, ({far}, cluster)) AS cluster FROM vectors, c{k} GROUP BY row_id),
m{k} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m
  FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{k} JOIN vectors USING (row_id), range(1, {DIMS + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    parts.append(f"""
last AS MATERIALIZED (SELECT row_id, min((CAST({far} AS BIGINT), cluster)) AS best FROM vectors, c{ROUNDS} GROUP BY row_id),
found AS (SELECT vec_id, best[2] AS cluster, best[1] AS distance FROM last JOIN vectors USING (row_id))""")
    return ",".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM found JOIN c{ROUNDS} USING (cluster)
"""


SQL = _sql()
