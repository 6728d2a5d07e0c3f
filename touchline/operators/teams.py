"""Embeddings to teams: projection, assignment, one Lloyd step, inertia, silhouette."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import dot, grid, squared_distance
from ..sources.package import ship
from .sequences import training_sample

#: Rows that a team model is fitted on at most, and the mean silhouette that it needs.
TRAIN_ROWS, LEAST_SILHOUETTE = 120, 0.15


def normalise(emb: DataFrame) -> DataFrame:
    norm = F.sqrt(dot(F.col("e"), F.col("e")))
    return emb.withColumn("norm", norm).select("vec_id", F.when(F.col("norm") > 1e-6, F.transform("e", lambda x: x / F.col("norm"))).otherwise(F.col("e")).alias("e"))


#: All-pairs measures deal rows out to blocks; pairs of blocks are the unit of work. A table (label) has BLOCKS blocks, fewer if they would be shorter than SHORT rows and more if they would be longer than BLOCK, so that
#: copies of rows grow with the table, and a unit is bounded.
BLOCK, BLOCKS, SHORT = 32768, 16, 1024
#: The same of a label in cosine_pairs: there are several labels, and where vectors are dealt out eight times their shuffle is small beside the pairs.
LABEL_BLOCKS, LABEL_SHORT = 8, 512
#: Labels up to which their numbers of blocks are broadcast.
FEW_LABELS = 1_000_000
#: Pairs that are computed at once; where each component is a pass over them, as many as stay in a core's cache.
AT_ONCE, TILE = 1 << 17, 1 << 15
#: Rows of a label go to blocks by buckets of a hash of their vectors.
BUCKETS = 4096


def _blocks(n: Column, most: int = BLOCKS, short: int = SHORT) -> Column:
    """The number of blocks for n rows."""
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(most), F.ceil(n / short)), F.lit(1)).cast("int")


def _block_pairs(dealt: DataFrame) -> DataFrame:
    """The rows (block, blocks and others) of each pair i <= j of blocks. Each row goes to every pair of its block once; left: whether it stands in block i."""
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "left": F.col("block") <= F.col("other")}).drop("block", "blocks", "other")


def _matrix(e: pa.Array, size: int) -> np.ndarray:
    """Lists of this size as rows of a matrix."""
    return e.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)


def _kinds(table: pa.Table) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Of each row its vector's number, -1 where it has no length; and by size the first number, the vectors as columns and their lengths. Numbers follow sizes, then ids; where most vectors are copies, equal ones share a number."""
    sizes, ids = (table.column(c).to_numpy() for c in ("size", "vec_id"))
    f, e = (table.column(c).combine_chunks() for c in "fe")
    narrow = f.is_valid().to_numpy(zero_copy_only=False)
    kinds, groups, first = np.full(len(ids), -1), [], 0
    for k in sorted(set(sizes.tolist()) - {0}):
        at = np.flatnonzero(sizes == k)
        at = at[np.argsort(ids[at], kind="stable")]
        v = np.empty((len(at), k))
        for column, some in ((f, narrow[at]), (e, ~narrow[at])):
            if some.any():
                v[some] = _matrix(column.take(pa.array(at[some])), k)
        one, of = np.unique(v.view(f"V{8 * k}").ravel(), return_index=True, return_inverse=True)[1:]
        if len(one) > len(at) / 2:
            one = of = np.arange(len(at))
        v, total = np.ascontiguousarray(v[one].T), np.zeros(len(one))
        with np.errstate(all="ignore"):
            for x in v:
                total += x * x
        usable = ~(total <= 1e-12)
        kinds[at] = np.where(usable, np.cumsum(usable) - 1 + first, -1)[of]
        if usable.any():
            groups.append((first, v[:, usable], np.sqrt(total[usable])))
            first += int(usable.sum())
    return kinds, groups


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, distance of all pairs of a pair of blocks: products are added in the vectors' order, as cosine_distance() does, and parts leave as they are done.

    Copies of a vector are computed once and stand together, so equal distances do, and the result's files are shorter."""
    table = pa.Table.from_batches(batches)
    if not table.num_rows:
        return
    left, ids = (table.column(c).to_numpy() for c in ("left", "vec_id"))
    kinds, groups = _kinds(table)
    one_block, order = table.column("i")[0] == table.column("j")[0], np.lexsort((ids, kinds))
    a, b = (order, order) if one_block else (order[left[order]], order[~left[order]])
    repeats = len(np.unique(ids)) < len(ids)
    # b's vectors, those of each size side by side, and the place of each row's among them
    vectors, of = np.unique(kinds[b], return_inverse=True)
    sides = []
    for first, v, length in groups:
        c = slice(*np.searchsorted(vectors, (first, first + len(length))))
        sides.append((c, np.ascontiguousarray(v[:, vectors[c] - first]), length[vectors[c] - first]))
    # a group gives a part at least
    step = max(1, TILE // max(1, len(b)))
    for start in range(0, max(1, len(a)), step):
        p = a[start : start + step]
        q, since = (b[start:], of[start]) if one_block else (b, 0)  # a pair of one block once
        own, own_of = np.unique(kinds[p], return_inverse=True)
        d = np.ones((len(own), len(vectors) - since))
        for (first, v, length), (c, w, width) in zip(groups, sides, strict=True):
            r, skip = slice(*np.searchsorted(own, (first, first + len(length)))), max(0, since - c.start)
            if r.start == r.stop or c.start + skip >= c.stop:
                continue
            some = own[r] - first
            x, y = v[:, some, None], w[:, skip:]
            total = np.zeros((len(some), y.shape[1]))
            product = np.empty_like(total)
            with np.errstate(all="ignore"):
                for f, g in zip(x, y, strict=True):
                    np.multiply(f, g, out=product)
                    total += product
                total /= np.multiply(length[some, None], width[skip:], out=product)
                # fmin: not a number counts as the largest number
                np.maximum(np.fmin(total, 1.0, out=total), -1.0, out=total)
            np.subtract(1.0, total, out=d[r, c.start + skip - since : c.stop - since])
        if len(own) < len(p) or d.shape[1] < len(q):
            d = d[own_of[:, None], of[None, len(b) - len(q) :] - since]
        m, n = ids[p][:, None], ids[q][None]
        least, most = np.minimum(m, n), np.maximum(m, n)
        if one_block or repeats:
            some = least != most
            if one_block:
                some &= np.arange(len(p))[:, None] < np.arange(len(q))[None]
            least, most, d = least[some], most[some], d[some]
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (least, most, d)], names=["a", "b", "distance"])


def cosine_pairs(emb: DataFrame) -> DataFrame:
    """Distances within a label, of all its pairs: a pair of blocks of a label is a group of bounded size, computed in NumPy, whose pairs leave in parts.

    Copies of a vector go to one block, except where they would make it much longer than others."""
    ship(emb.sparkSession)
    rows = emb.filter("label IS NOT NULL AND vec_id IS NOT NULL").select("label", F.col("vec_id").cast("long").alias("vec_id"), F.col("e").cast("array<double>").alias("e"))
    whole = F.coalesce(~F.exists("e", lambda x: x.isNull()), F.lit(False))
    rows = rows.withColumn("e", F.when(whole, F.col("e")).otherwise(F.array().cast("array<double>"))).withColumns({"size": F.size("e"), "bucket": F.pmod(F.xxhash64("e"), F.lit(BUCKETS)).cast("int")})
    # buckets of more than a quarter of a block are spread by id
    counts = rows.groupBy("label", "bucket").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("all"), F.collect_list(F.struct("bucket", "n")).alias("each")).withColumn("blocks", _blocks(F.col("all"), LABEL_BLOCKS, LABEL_SHORT))
    labels = counts.select("label", "blocks", F.transform(F.filter("each", lambda x: x["n"] * F.col("blocks") * 4 > F.col("all")), lambda x: x["bucket"]).alias("long"))
    # else the join deals out a label's rows to one task
    labels = F.broadcast(labels) if emb.select("label").distinct().count() <= FEW_LABELS else labels
    block = F.when(F.array_contains("long", F.col("bucket")), F.xxhash64("vec_id")).otherwise(F.col("bucket").cast("long"))
    dealt = rows.join(labels, "label").withColumn("block", F.pmod(block, F.col("blocks")).cast("int"))
    # what is of single precision travels so
    single = F.col("e").cast("array<float>")
    narrow = dealt.withColumn("f", F.when(single.cast("array<double>") == F.col("e"), single)).withColumn("e", F.when(F.col("f").isNull(), F.col("e")))
    pairs = _block_pairs(narrow.select("label", "vec_id", "size", "f", "e", "block", "blocks"))
    # a number of parts of their own: few bytes make many pairs, so parts of few bytes must not be put together
    parts = int(emb.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "label", "i", "j").groupBy("label", "i", "j").applyInArrow(_cosines, "a long, b long, distance double")


def project(emb: DataFrame, mean: list[float], components: list[list[float]]) -> DataFrame:
    """(x - mean) times each component."""
    centred = F.zip_with("e", F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return emb.withColumn("c", centred).select("vec_id", *[dot(F.col("c"), F.array(*map(F.lit, v))).alias(f"p{i}") for i, v in enumerate(components)])


def assign(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """vec_id, team, d2: the nearest centroid, ties to the first."""
    d = [squared_distance(F.col("e"), F.array(*map(F.lit, c))) for c in centroids]
    best = F.least(*d)
    team = F.lit(len(d) - 1)
    for k in range(len(d) - 2, -1, -1):
        team = F.when(d[k] == best, k).otherwise(team)
    return points.select("vec_id", "e", team.cast("int").alias("team"), best.alias("d2"))


def centroid_step(assigned: DataFrame, teams: int, dims: int) -> DataFrame:
    """team, dim, mean of each team's vectors; an empty team's is 0."""
    ids = assigned.sparkSession.range(teams * dims).select((F.col("id") / dims).cast("int").alias("team"), (F.col("id") % dims).cast("int").alias("dim"))
    means = assigned.select("team", F.posexplode("e").alias("dim", "x")).groupBy("team", "dim").agg(F.avg("x").alias("m"))
    return ids.join(means, ["team", "dim"], "left").select("team", "dim", grid(F.coalesce("m", F.lit(0.0))).alias("mean"))


#: Squared distances below this share of the squared lengths are computed from differences; others lose no more than the sums' own rounding by the product.
NEAR = 1e-3


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to those of y."""
    with np.errstate(all="ignore"):
        lengths = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
        d = lengths - 2.0 * (x @ y.T)
        i, j = np.nonzero(~((d >= NEAR * lengths) & (d < np.inf)))
        for k in range(0, len(i), AT_ONCE // 8):
            some = slice(k, k + AT_ONCE // 8)
            d[i[some], j[some]] = ((x[i[some]] - y[j[some]]) ** 2).sum(1)
        return np.sqrt(d)


def _sums(table: pa.Table) -> pa.Table:
    """Sums and numbers of the distances of a pair of blocks, of each block's points to the other's, by own team and other."""
    left, ids, team = (table.column(c).to_numpy() for c in ("left", "vec_id", "team"))
    one_block = table.column("i")[0] == table.column("j")[0]
    x = _matrix(table.column("e").combine_chunks(), len(table.column("e")[0]))
    of = np.unique(team, return_inverse=True)[1]
    teams = np.eye(of.max() + 1)[of]
    a, b = (np.arange(len(ids)),) * 2 if one_block else (np.flatnonzero(left), np.flatnonzero(~left))
    # by point and team
    sums, numbers = np.zeros((len(ids), teams.shape[1])), np.zeros((len(ids), teams.shape[1]))
    side = 1 << 9
    for m in range(0, len(a), side):
        p = a[m : m + side]
        for n in range(0, len(b), side):
            q = b[n : n + side]
            d = _distances(x[p], x[q])
            numbers[p] += teams[q].sum(0)
            if one_block:  # equal ids share a block
                same = ids[p][:, None] == ids[q][None]
                d[same] = 0.0
                numbers[p] -= same @ teams[q]
            sums[p] += d @ teams[q]
            if not one_block:
                sums[q] += d.T @ teams[p]
                numbers[q] += teams[p].sum(0)
    own = teams > 0
    total = lambda v, where: np.where(where, v, 0.0).sum(1)
    return pa.table({"vec_id": pa.array(ids), "own": total(sums, own), "n_own": total(numbers, own), "other": total(sums, ~own), "n_other": total(numbers, ~own)})


def silhouette(points: DataFrame) -> DataFrame:
    """vec_id, s for points (vec_id, team, e) of two groups: own-team mean distance against all others'; rows that lack either go, and rows without an id, a team or a whole vector don't count.

    All pairs are the definition: each pair of blocks of points is a group of bounded size, in which a pair of points is computed once, and only sums leave it."""
    ship(points.sparkSession)
    whole = points.filter("vec_id IS NOT NULL AND team IS NOT NULL AND e IS NOT NULL").filter(~F.exists("e", lambda x: x.isNull())).select(F.col("vec_id").cast("long").alias("vec_id"), "team", "e")
    dealt = whole.withColumn("blocks", _blocks(F.lit(whole.count()))).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    sums = _block_pairs(dealt).groupBy("i", "j").applyInArrow(lambda t: _sums(t), "vec_id long, own double, n_own double, other double, n_other double")
    means = sums.groupBy("vec_id").agg(*[F.sum(c).alias(c) for c in ("own", "n_own", "other", "n_other")]).filter("n_own > 0 AND n_other > 0").select("vec_id", (F.col("own") / F.col("n_own")).alias("a"), (F.col("other") / F.col("n_other")).alias("b"))
    return means.filter("greatest(a, b) > 0").select("vec_id", grid((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def mean_pool(emb: DataFrame, channels: int) -> DataFrame:
    """The mean of each channel's cells; vectors hold channels one after the other."""
    cells = (F.size("e") / channels).cast("int")
    part = lambda c: F.slice(F.col("e"), (c * cells + 1).cast("int"), cells)
    return emb.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.aggregate(part(c), F.lit(0.0), lambda s, x: s + x) / cells).alias("pooled"))


def best_restart(points: DataFrame, runs: list[list[list[float]]]) -> DataFrame:
    """run, inertia of the centroid set of the least inertia, the first on ties: one pass over the points for all runs."""
    sums = [F.sum(F.least(*[squared_distance(F.col("e"), F.array(*map(F.lit, c))) for c in run])).alias(f"i{k}") for k, run in enumerate(runs)]
    each = points.agg(*sums).select(F.explode(F.array(*[F.struct(grid(F.col(f"i{k}")).alias("inertia"), F.lit(k).alias("run")) for k in range(len(runs))])).alias("s"))
    return each.agg(F.min("s").alias("s")).select("s.run", "s.inertia")


def separated(score: Column) -> Column:
    """Whether a mean silhouette is good enough to tell two teams apart; NaN, which compares as the largest number, and null are not."""
    return F.coalesce(~F.isnan(score) & (score >= LEAST_SILHOUETTE), F.lit(False))


def training_rows(emb: DataFrame, most: int = TRAIN_ROWS, by: tuple[str, ...] = (), ident: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The rows that a model is fitted on: those of the smallest hashes of ident, ``most`` at most; with ``by``, of each of its groups.

    The ranks' limit is pushed below the shuffle, so a task sends ``most`` rows of a group at most."""
    found = emb.filter("e IS NOT NULL")
    if not by:
        return found.select("vec_id", "e").orderBy(F.xxhash64(*ident), *ident).limit(most)
    order = Window.partitionBy(*by).orderBy(F.xxhash64(*by, *ident), *ident)
    return found.select(*by, *ident, "e", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= most).drop("rank")


def cached_labels(tracks: DataFrame, cache: DataFrame) -> DataFrame:
    """Tracks (track_id, label) with the cache's label where it has one."""
    return tracks.join(cache.select("track_id", F.col("label").alias("fresh")), "track_id", "left").select("track_id", F.coalesce("fresh", "label").alias("label"))


@dataclass
class TeamModel:
    """Two teams from embeddings: PCA, k-means of several restarts, and a gate on the mean silhouette; where it fails, all are team 0.

    Fitted on a bounded sample (TRAIN_ROWS rows by a hash of their id), so the fit is the same size for any input."""

    components: int = 3
    teams: int = 2
    mean: np.ndarray | None = None
    axes: np.ndarray | None = None
    variance: np.ndarray | None = None
    centroids: np.ndarray | None = None
    score: float = -1.0

    @property
    def valid(self) -> bool:
        return self.centroids is not None and not np.isnan(self.score) and self.score >= LEAST_SILHOUETTE

    def fit_pca(self, x: np.ndarray) -> None:
        self.mean = x.mean(0)
        _, s, v = np.linalg.svd(x - self.mean, full_matrices=False)
        k = min(self.components, len(s))
        self.axes, self.variance = np.zeros((self.components, x.shape[1])), np.zeros(self.components)
        self.axes[:k], self.variance[:k] = v[:k], s[:k] ** 2 / max(len(x), 1)

    def fit_kmeans(self, x: np.ndarray, steps: int = 50, restarts: int = 3) -> np.ndarray:
        """Labels of the restart of the least inertia, the first on ties; an empty team's centroid is 0."""
        least, out = np.inf, np.zeros(len(x), int)
        for run in range(restarts):
            rng = np.random.default_rng(42 + 17 * run)
            c = x[[rng.integers(len(x))]]
            while len(c) < self.teams:
                d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
                c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else 0]])
            label = np.zeros(len(x), int)
            for _ in range(steps):
                new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                same = (new == label).all()
                label = new
                c = np.array([x[label == k].mean(0) if (label == k).any() else np.zeros(x.shape[1]) for k in range(self.teams)])
                if same:
                    break
            inertia = float(((x - c[label]) ** 2).sum())
            if inertia < least:
                least, self.centroids, out = inertia, c, label
        return out

    def fit(self, emb: DataFrame) -> TeamModel:
        """From (vec_id, e); vectors that are null or of another size than the first are passed over."""
        return self.learn([r.e for r in training_rows(emb).collect()])

    def learn(self, rows: list) -> TeamModel:
        """From the sample itself."""
        x = [e for e in rows if len(e) == len(rows[0])]
        if len(x) < self.teams or not len(x[0]):
            return self
        x = np.array(x, float)
        self.fit_pca(x)
        p = (x - self.mean) @ self.axes.T
        label = self.fit_kmeans(p)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        own = label[:, None] == label[None]
        n_own, n_other = own.sum(1) - 1, (~own).sum(1)
        some = (n_own > 0) & (n_other > 0)
        if some.any():
            a, b = (d * own).sum(1)[some] / n_own[some], (d * ~own).sum(1)[some] / n_other[some]
            top = np.maximum(a, b)
            self.score = float(np.mean(np.where(top > 0, (b - a) / np.where(top > 0, top, 1), np.nan)))
        return self

    def predict(self, emb: DataFrame) -> DataFrame:
        """vec_id, team of every row, by column expressions; all 0 for a model that isn't valid."""
        if not self.valid:
            return emb.select("vec_id", F.lit(0).alias("team"))
        centred = F.zip_with("e", F.array(*map(F.lit, self.mean.tolist())), lambda x, m: x - m)
        e = F.array(*[dot(F.col("c"), F.array(*map(F.lit, v))) for v in self.axes.tolist()])
        return assign(emb.select("vec_id", centred.alias("c")).select("vec_id", e.alias("e")), self.centroids.tolist()).select("vec_id", "team")


_MODEL = "mean array<double>, axes array<array<double>>, variance array<double>, centroids array<array<double>>, score double, rows int"


def fit_by_clip(players: DataFrame, frames: int = 0, components: int = 3) -> DataFrame:
    """A team model a clip, as a relation: clip_id, mean, axes, variance, centroids, score, rows (how many it was fitted on). players: clip_id, frame_idx, det_idx, feature (null: none).

    Each clip is sampled as training_sample() says, and of those rows the TRAIN_ROWS of the smallest hashes are fitted, a small group a clip; nothing goes to the driver. The first of a clip's sampled rows fixes the
    vectors' size: others are passed over. A clip whose sample has fewer rows than teams has a row without mean and centroids, of score -1; one that isn't looked at in its sampled frames has none."""
    seen = players.filter(F.col("feature").isNotNull() & (F.size("feature") > 0)).select("clip_id", "frame_idx", "det_idx", F.col("feature").cast("array<double>").alias("e"))
    taken = training_sample(seen.groupBy("clip_id", "frame_idx").agg(F.count("*").alias("n")), frames).select("clip_id", "frame_idx")
    sample = training_rows(seen.join(taken, ["clip_id", "frame_idx"], "left_semi"), by=("clip_id",), ident=("frame_idx", "det_idx"))

    def clip(df: pd.DataFrame) -> pd.DataFrame:
        m = TeamModel(components).learn(df.sort_values(["frame_idx", "det_idx"], kind="stable")["e"].tolist())
        lists = [None if v is None else v.tolist() for v in (m.mean, m.axes, m.variance, m.centroids)]
        return pd.DataFrame([(df["clip_id"].iloc[0], *lists, m.score if np.isfinite(m.score) else None, len(df))], columns=["clip_id", "mean", "axes", "variance", "centroids", "score", "rows"])

    ship(players.sparkSession)
    return sample.groupBy("clip_id").applyInPandas(clip, f"clip_id long, {_MODEL}")


def predict_by_clip(players: DataFrame, models: DataFrame) -> DataFrame:
    """clip_id, frame_idx, det_idx, predicted of players (clip_id, frame_idx, det_idx, feature) that have a feature, by their own clip's model: a join and column expressions.

    0 where the model isn't good enough, or the feature isn't of its size; null where the clip has no model."""
    of = models.withColumn("valid", separated(F.col("score")) & F.col("centroids").isNotNull()).select(F.col("clip_id").alias("of_clip"), "mean", "axes", "centroids", "valid")
    both = players.filter("feature IS NOT NULL").select("clip_id", "frame_idx", "det_idx", F.col("feature").cast("array<double>").alias("e")).join(of, F.col("clip_id") == F.col("of_clip"), "left")
    both = both.withColumn("c", F.zip_with("e", "mean", lambda x, m: x - m)).withColumn("p", F.transform("axes", lambda a: dot(F.col("c"), a)))
    # the first centroid that no other is nearer than
    near = both.withColumn("d", F.transform("centroids", lambda c: squared_distance(F.col("p"), c))).withColumn("near", (F.array_position("d", F.array_min("d")) - 1).cast("int"))
    fits = F.col("valid") & (F.size("e") == F.size("mean")) & (F.col("near") >= 0)
    return near.select("clip_id", "frame_idx", "det_idx", F.when(F.col("of_clip").isNotNull(), F.when(F.coalesce(fits, F.lit(False)), F.col("near")).otherwise(0)).alias("predicted"))
