"""From corners to homographies: subsets, permutations of pitch points, exact fits, the best of them, and smoothing over a clip.

A frame's corners are few (a few dozen), so a frame is a row with an array of corners, and fits of many frames go to a worker in one Arrow batch.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship
from .detections import frame
from .pitch import PITCH, transform

#: Subsets of four that a frame tries, and the best corners that they come from.
SUBSETS, POOL = 32, 27
SURE, FLAT, NEAR = 0.25, 1e-4, 0.1


def cross(p: Column, q: Column, r: Column) -> Column:
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def collinear(p: Column, q: Column, r: Column) -> Column:
    return F.abs(cross(p, q, r)) < FLAT


def corner_subsets(corners: DataFrame, most: int = SUBSETS) -> DataFrame:
    """frame_idx, subset, a, b, c, d: fours of a frame's confident corners (frame_idx, corner_idx, class_id, x, y, conf) as ranks by confidence, no three in a line.

    Fours of better corners come first (by their worst corner), up to ``most`` a frame, from the frame's POOL best corners."""
    point = F.struct((-F.col("conf")).alias("by"), "corner_idx", "x", "y")
    keys = frame(corners)
    best_first = F.slice(F.array_sort(F.collect_list(point)), 1, POOL)
    packed = corners.filter(F.col("conf") >= SURE).groupBy(*keys).agg(best_first.alias("p")).filter(F.size("p") >= 4)
    at = lambda i: F.element_at("p", i)
    # all fours of a frame's own array, in the order of their worst corner; they never leave its row until they are chosen
    fours = F.flatten(F.transform(F.sequence(F.lit(4), F.size("p")), lambda d: F.flatten(F.transform(F.sequence(F.lit(3), d - 1), lambda c: F.flatten(F.transform(F.sequence(F.lit(2), c - 1), lambda b: F.transform(F.sequence(F.lit(1), b - 1), lambda a: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")))))))))
    open_ = F.filter(fours, lambda q: ~(collinear(at(q["a"]), at(q["b"]), at(q["c"])) | collinear(at(q["a"]), at(q["b"]), at(q["d"])) | collinear(at(q["a"]), at(q["c"]), at(q["d"])) | collinear(at(q["b"]), at(q["c"]), at(q["d"]))))
    return packed.select(*keys, F.posexplode(F.slice(open_, 1, most)).alias("subset", "q")).select(*keys, "subset", "q.a", "q.b", "q.c", "q.d")


def permutations(fours: DataFrame) -> DataFrame:
    """id, ra, rb, rc, rd: the pitch points that four corners (id and classes ca, cb, cc, cd) may stand for, no two at one place. An unknown class has none."""
    spark = fours.sparkSession
    refs = spark.createDataFrame([(c, i, x, y) for c, ps in PITCH.items() for i, (x, y) in enumerate(ps)], "class_id int, ref int, x double, y double")
    out, names = fours, []
    for k in "abcd":
        r = F.broadcast(refs.select(F.col("class_id").alias(f"c{k}"), F.col("ref").alias(f"r{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")))
        out = out.join(r, f"c{k}")
        for o in names:
            out = out.filter(~((F.abs(F.col(f"x{k}") - F.col(f"x{o}")) < NEAR) & (F.abs(F.col(f"y{k}") - F.col(f"y{o}")) < NEAR)))
        names.append(k)
    return out.select("id", "ra", "rb", "rc", "rd")


def solve(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Exact homographies (n, 9), h33 = 1, of four points each: src and dst are (n, 4, 2). Rows without one are NaN."""
    n = len(src)
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    m = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], 1)
    good = np.abs(np.linalg.det(m)) > 1e-9
    out = np.full((n, 9), np.nan)
    if good.any():
        out[good, :8] = np.linalg.solve(m[good], np.concatenate([u, v], 1)[good][..., None])[..., 0]
        out[good, 8] = 1.0
    return out


def best(classes: np.ndarray, xy: np.ndarray, conf: np.ndarray) -> tuple[list[float] | None, float]:
    """(homography from frame to pitch, its summed squared distance) of one frame's corners; (None, nan) without one.

    Each four of confident corners is fitted to each choice of pitch points; the fit of the least sum of squared distances to the nearest pitch points wins, the first on ties."""
    at = [i for i in np.argsort(-conf, kind="stable") if conf[i] >= SURE and classes[i] in PITCH]
    c, p = classes[at], xy[at]
    fours = []
    for d in range(3, min(len(at), POOL)):
        for rest in sorted(combinations(range(d), 3), key=lambda t: t[::-1]):
            q = p[[*rest, d]]
            if all(abs((q[j][0] - q[i][0]) * (q[k][1] - q[i][1]) - (q[j][1] - q[i][1]) * (q[k][0] - q[i][0])) >= FLAT for i, j, k in combinations(range(4), 3)):
                fours.append([*rest, d])
            if len(fours) == SUBSETS:
                break
        if len(fours) == SUBSETS:
            break
    least, found = np.inf, None
    for four in fours:
        options = [np.array(PITCH[int(k)]) for k in c[four]]
        grid = np.stack(np.meshgrid(*[np.arange(len(o)) for o in options], indexing="ij"), -1).reshape(-1, 4)
        dst = np.stack([o[grid[:, i]] for i, o in enumerate(options)], 1)
        apart = np.ones(len(dst), bool)
        for i, j in combinations(range(4), 2):
            apart &= (np.abs(dst[:, i] - dst[:, j]) >= NEAR).any(1)
        dst = dst[apart]
        if not len(dst):
            continue
        h = solve(np.broadcast_to(p[four], dst.shape), dst)
        q = np.einsum("nij,kj->nki", h.reshape(-1, 3, 3), np.c_[p, np.ones(len(p))])
        with np.errstate(all="ignore"):
            q = q[..., :2] / q[..., 2:]
            total = np.zeros(len(h))
            for k in range(len(p)):
                total += ((q[:, k, None] - np.array(PITCH[int(c[k])])[None]) ** 2).sum(2).min(1)
        total = np.where(np.isfinite(total) & np.isfinite(h).all(1), total, np.inf)
        # the first within rounding of the least, since the pitch's symmetries give equal sums
        i = int(np.flatnonzero(total <= total.min() + 1e-9 * (1 + total.min()))[0])
        if np.isfinite(total[i]) and total[i] < least - 1e-9 * (1 + total[i]):
            least, found = float(total[i]), h[i]
    return (None, float("nan")) if found is None else (found.tolist(), least)


def fit(corners: DataFrame) -> DataFrame:
    """clip_id (if there is one), frame_idx, h array<double> (null: none), residual of each frame with corners (frame_idx, corner_idx, class_id, x, y, conf)."""
    keys = frame(corners)
    ship(corners.sparkSession)
    packed = corners.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("corner_idx", "class_id", "x", "y", "conf"))).alias("c"))

    @F.pandas_udf("h array<double>, residual double")
    def fitted(classes: pd.Series, x: pd.Series, y: pd.Series, conf: pd.Series) -> pd.DataFrame:
        rows = [best(np.asarray(c), np.c_[np.asarray(p, float), np.asarray(q, float)], np.asarray(k, float)) for c, p, q, k in zip(classes, x, y, conf, strict=True)]
        return pd.DataFrame(rows, columns=["h", "residual"])

    return packed.withColumn("f", fitted("c.class_id", "c.x", "c.y", "c.conf")).select(*keys, "f.h", "f.residual")


def inverse(h: np.ndarray) -> np.ndarray | None:
    """The way back from the pitch to the frame, as nine numbers, or None where there is none: a homography that can't be inverted, or not in finite numbers, isn't valid."""
    m = np.asarray(h, float).reshape(3, 3)
    if not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-12:
        return None
    back = np.linalg.inv(m)
    return back.ravel() if np.isfinite(back).all() else None


def inverses(h: list) -> list[np.ndarray | None]:
    """inverse() of each of many, those that have one at once; None stays None."""
    out = [None] * len(h)
    at = np.array([k for k, v in enumerate(h) if v is not None], int)
    if len(at):
        m = np.stack([np.asarray(h[k], float).reshape(3, 3) for k in at])
        fine = np.isfinite(m).all((1, 2))
        at, m = at[fine], m[fine]
        fine = ~(np.abs(np.linalg.det(m)) < 1e-12)
        back = np.linalg.inv(m[fine]).reshape(-1, 9)
        for k, v, whole in zip(at[fine].tolist(), back, np.isfinite(back).all(1), strict=True):
            out[k] = v if whole else None
    return out


def smooth_step(last: np.ndarray | None, missed: int, h, stale: int) -> tuple[np.ndarray | None, int, bool]:
    """(last, missed) after a frame, and whether last may be used in it."""
    if h is not None and np.isfinite(new := np.asarray(h, float)).all():
        if last is not None:
            a = 0.20 if float(np.sqrt(((new - last) ** 2).sum())) > 25 else 0.35
            new = (1 - a) * last + a * new
            new = new / new[8] if abs(new[8]) > 1e-12 else new
        if inverse(new) is not None:
            return new, 0, True
    return last, missed + 1, last is not None and missed + 1 <= stale


def smooth(fits: DataFrame, stale: int = 10) -> DataFrame:
    """clip_id, frame_idx, h, valid of fits (clip_id, frame_idx, h or null): each is blended with the one before, more weakly after a leap; a failed frame uses the last one, up to ``stale`` in a row.

    A fit that, blended, can't be inverted has failed. Goes through a clip in order, as each step depends on the one before; clips are the unit of parallel work."""

    def clip(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame_idx")
        last, missed, out, ok = None, 0, [], []
        for h in df["h"]:
            last, missed, good = smooth_step(last, missed, h, stale)
            out.append(last.tolist() if good else None)
            ok.append(good)
        return pd.DataFrame({"clip_id": df["clip_id"], "frame_idx": df["frame_idx"], "h": out, "valid": ok})

    ship(fits.sparkSession)
    return fits.groupBy("clip_id").applyInPandas(lambda df: clip(df), "clip_id long, frame_idx long, h array<double>, valid boolean")


def with_inverse(fits: DataFrame) -> DataFrame:
    """fits (h array<double>, null where there is none) with back: the inverse, of each frame's own homography (null where there is none)."""
    ship(fits.sparkSession)

    @F.pandas_udf("array<double>")
    def inverted(h: pd.Series) -> pd.Series:
        return pd.Series(inverses(h.tolist()), dtype=object)

    # called so, it isn't computed again for a filter of what it gives
    return fits.withColumn("back", inverted.asNondeterministic()("h"))


def to_frame(points: DataFrame, fits: DataFrame) -> DataFrame:
    """points (clip_id, if there are several, frame_idx, x, y on the pitch) with fx, fy: where they are in their own frame, by the inverse of its homography (fits: the same keys, h). Frames without one that can be inverted show none."""
    keys = frame(points)
    back = with_inverse(fits.select(*keys, "h")).filter("back IS NOT NULL")
    fx, fy = transform(F.col("back"), F.col("x"), F.col("y"))
    return points.join(back.drop("h"), keys).withColumn("fx", fx).withColumn("fy", fy).drop("back").filter("fx IS NOT NULL")
