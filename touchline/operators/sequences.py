"""Windows and folds over frames: interpolation, votes, smoothing, cadences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import HEIGHT, WIDTH, clamp, dot
from ..sources.package import ship
from . import scans

#: Frame numbers of a block: what is carried along a clip goes block by block, so that one long clip is many tasks' work.
BLOCK = 4096


def running_max(df: DataFrame, value: Column, name: str, strict: bool = False) -> DataFrame:
    """df (clip_id, if it has one, and frame_idx) with the largest value of the clip's rows so far; strict: of those before the row. Rows of one frame_idx must be one.

    A scan in two levels: each block's own maximum, the maxima of the blocks before it (a row a block), and then a window within the block. No window spans a clip's rows."""
    keys = [*(["clip_id"] if "clip_id" in df.columns else [])]
    block, before, own = (f"_{name}_{k}" for k in ("block", "before", "own"))
    df = df.withColumn(block, F.floor(F.col("frame_idx") / BLOCK)).withColumn(own, value)
    blocks = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, block).agg(F.max(own).alias(own)).select(*keys, block, F.max(own).over(blocks).alias(before))
    within = Window.partitionBy(*keys, block).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return df.join(tops, [*keys, block]).withColumn(name, F.greatest(before, F.max(own).over(within))).drop(block, before, own)


def last_look(spine: DataFrame, looks: DataFrame) -> DataFrame:
    """The spine's frames with from_frame: the clip's last frame so far that is among looks (both clip_id, frame_idx; null before the first): an as-of join of the two."""
    keys = [c for c in ("clip_id", "frame_idx") if c in spine.columns]
    frames = spine.select(*keys).distinct().withColumn("asked", F.lit(True))
    both = frames.join(looks.select(*keys).distinct().withColumn("look", F.col("frame_idx")), keys, "full")
    return running_max(both, F.col("look"), "from_frame").filter("asked").select(*keys, "from_frame")


def interpolate(obs: DataFrame, longest: int = 30) -> DataFrame:
    """Fill gaps of 2 to longest frames between a clip's observations (x, y), at constant acceleration.

    The gap's first velocity is that of the pair before, if it is no longer than longest; else the gap's mean."""
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    nxt = {k: F.lead(k).over(w) for k in ("frame_idx", "x", "y")}
    prv = {k: F.lag(k).over(w) for k in ("frame_idx", "x", "y")}
    g = obs.select("clip_id", F.col("frame_idx").alias("f1"), F.col("x").alias("x0"), F.col("y").alias("y0"), *[v.alias(f"n_{k}") for k, v in nxt.items()], *[v.alias(f"p_{k}") for k, v in prv.items()])
    gap, before = (F.col("n_frame_idx") - F.col("f1")).cast("double"), (F.col("f1") - F.col("p_frame_idx")).cast("double")
    g = g.withColumn("gap", gap).withColumn("before", before).filter(F.col("gap").between(2, longest))
    for k in ("x", "y"):
        g = g.withColumn(f"v{k}", F.when(F.col("before") <= longest, (F.col(f"{k}0") - F.col(f"p_{k}")) / F.col("before")).otherwise((F.col(f"n_{k}") - F.col(f"{k}0")) / F.col("gap")))
        g = g.withColumn(f"a{k}", 2.0 * (F.col(f"n_{k}") - F.col(f"{k}0") - F.col(f"v{k}") * F.col("gap")) / (F.col("gap") * F.col("gap")))
    t = (F.col("frame_idx") - F.col("f1")).cast("double")
    at = lambda k: F.col(f"{k}0") + F.col(f"v{k}") * t + 0.5 * F.col(f"a{k}") * t * t
    filled = g.withColumn("frame_idx", F.explode(F.sequence(F.col("f1") + 1, F.col("n_frame_idx") - 1)))
    return filled.select("clip_id", "frame_idx", at("x").alias("x"), at("y").alias("y"), F.lit(0.35).alias("conf"))


def interpolate_boxes(balls: DataFrame, longest: int = 30) -> DataFrame:
    """All frames' ball boxes (clip_id, frame_idx, class_id, conf, x1, y1, x2, y2): the observed ones that have an area, and those between them.

    Centres go as in interpolate(); width and height change evenly; boxes are clamped to the frame; class 1, confidence 0.35."""
    seen = balls.filter("x2 > x1 AND y2 > y1")
    obs = seen.select("clip_id", "frame_idx", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    size = seen.select("clip_id", F.col("frame_idx").alias("f1"), F.lead("frame_idx").over(w).alias("f2"), *[f(v).alias(f"{k}{i}") for k, v in (("w", F.col("x2") - F.col("x1")), ("h", F.col("y2") - F.col("y1"))) for i, f in ((0, lambda v: v), (1, lambda v: F.lead(v).over(w)))])
    size = size.filter(F.col("f2") - F.col("f1") > 1).filter(F.col("f2") - F.col("f1") <= longest).withColumn("frame_idx", F.explode(F.sequence(F.col("f1") + 1, F.col("f2") - 1)))
    t = (F.col("frame_idx") - F.col("f1")).cast("double") / (F.col("f2") - F.col("f1")).cast("double")
    half = {k: 0.5 * (F.col(f"{k}0") + t * (F.col(f"{k}1") - F.col(f"{k}0"))) for k in "wh"}
    filled = interpolate(obs, longest).join(size, ["clip_id", "frame_idx"])
    box = [clamp(F.col(c) + s * half[k], m).alias(n) for n, c, s, k, m in (("x1", "x", -1, "w", WIDTH), ("y1", "y", -1, "h", HEIGHT), ("x2", "x", 1, "w", WIDTH), ("y2", "y", 1, "h", HEIGHT))]
    return seen.select("clip_id", "frame_idx", "class_id", "conf", "x1", "y1", "x2", "y2").unionByName(filled.select("clip_id", "frame_idx", F.lit(1).alias("class_id"), "conf", *box))


def majority(votes: DataFrame, last: int = 15) -> DataFrame:
    """track_id, seq, vote to the label after each: the majority of the last votes, 0 on a tie. Votes other than 0 and 1 don't count and take up no place; before the first that counts the label is null."""
    keys = [*(["clip_id"] if "clip_id" in votes.columns else []), "track_id"]
    counts = F.col("vote").isin(0, 1) & F.col("vote").isNotNull()
    so_far = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = votes.withColumn("number", F.sum(F.coalesce(counts, F.lit(False)).cast("long")).over(so_far))
    w = Window.partitionBy(*keys).orderBy("number").rangeBetween(-(last - 1), 0)
    n = lambda v: F.sum(F.coalesce(F.col("vote") == v, F.lit(False)).cast("long")).over(w)
    # the vote before the first of the window may share its number with votes that don't count: those add nothing
    return numbered.select(*keys, "seq", F.when(F.col("number") > 0, F.when(n(0) >= n(1), 0).otherwise(1)).alias("label"))


def role(votes: DataFrame) -> DataFrame:
    """A referee is a track with more referee votes than player votes so far."""
    keys = [*(["clip_id"] if "clip_id" in votes.columns else []), "track_id"]
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return votes.select(*keys, "seq", (F.sum(F.when(F.col("vote") == 1, 1).otherwise(-1)).over(w) > 0).alias("is_referee"))


def _ordered(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("all"))


def ema(df: DataFrame, key: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """The last state of s <- keep * s + (1 - keep) * x, from the first value; nulls don't count."""
    return scans.last_state(df, key, order, [value], scans.ema(keep), ["ema"])


def cadence(df: DataFrame, key: str, order: str, every: int = 60) -> DataFrame:
    """How often a label is made anew, and when last: where it is unseen or every frames old."""
    return scans.cadence(df, key, order, every)


def stale_reuse(df: DataFrame, key: str, order: str, ok: str, most: int = 10) -> DataFrame:
    """Whether a failed frame may reuse the last good one: up to most times in a row."""
    w = Window.partitionBy(key).orderBy(order)
    island = df.withColumn("island", F.sum(F.col(ok).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.row_number().over(Window.partitionBy(key, "island").orderBy(order)) - 1
    return island.withColumn("age", F.when(F.col("island") > 0, rank)).select(key, order, (F.col("age") <= most).alias("usable"))


def kalman_axis(obs: DataFrame, value: str = "x", conf: str | None = None) -> DataFrame:
    """clip_id, p, v: one axis of the box filter, position and velocity: predict, then update, over a clip's observations. conf: the column of their confidence (0.9 throughout, if there is none)."""
    sure = F.least(F.greatest(F.col(conf), F.lit(0.05)), F.lit(1.0)) if conf else F.lit(0.9)
    noisy = obs.withColumn("noise", 10.0 * (1.0 - sure) + 1.0)
    return scans.last_state(noisy, "clip_id", "frame_idx", [value, "noise"], scans.kalman(), ["p", "v", "pp", "pv", "vp", "vv"]).select("clip_id", "p", "v")


def training_sample(counts: DataFrame, frames: int = 0) -> DataFrame:
    """Strided frames of each clip until enough crops are there: a frame is taken while what came before is less. counts: clip_id (if there are several), frame_idx, n; frames: the run's frame limit, if it has one (2880 otherwise). Short runs are looked at more closely."""
    stride, target = (2 if 0 < frames <= 30 else 12), (60 if 0 < frames <= 60 else 120)
    keys = [*(["clip_id"] if "clip_id" in counts.columns else [])]
    w = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    return counts.filter(F.col("frame_idx") % stride == 0).filter(F.col("frame_idx") < (frames if frames > 0 else 2880)).withColumn("prior", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("prior") < target).select(*keys, "frame_idx", "n")


def ema_appearance(df: DataFrame, key: str, order: str, vector: str, keep: float = 0.9) -> DataFrame:
    """The last appearance of each key: a running mean of vectors, brought to length 1 after each step; a vector of another size starts anew."""
    unit = lambda v: F.transform(F.array(v), lambda a: F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.when(n > 1e-6, F.transform(a, lambda x: x / n)).otherwise(a))[0])[0]
    step = lambda a, x: unit(F.when(F.size(a) == F.size(x[vector]), F.zip_with(a, x[vector], lambda p, q: F.lit(keep) * p + F.lit(1 - keep) * q)).otherwise(x[vector]))
    rest = F.slice(F.col("all"), F.lit(2), F.size("all"))
    return _ordered(df, key, order, vector).select(key, F.aggregate(rest, unit(F.element_at("all", 1)[vector]), step).alias(vector))


def cache_step(held: int | None, age: int, empty: bool, frame: int, corners: int, seen: int, interval: int, least: int) -> tuple[int | None, int, bool, bool]:
    """(held, age, empty) after a frame, and whether corners were detected in it. held: the frame whose corners are in use."""
    detect = empty or age >= interval
    if detect and (empty or seen >= least):
        return frame, 0, corners == 0, detect
    return held, age + 1, empty, detect


def corner_cache(frames: DataFrame, interval: int = 15, least: int = 4) -> DataFrame:
    """clip_id, frame_idx, from_frame, detected of frames (clip_id, frame_idx, n_corners, n_visible): which frame's corners are in use.

    Corners are detected where the cache is empty or ``interval`` frames old; a weak result keeps the cache, and the next frame tries again. Goes through a clip in order."""

    def clip(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame_idx")
        held, age, empty, at, ran = None, 0, True, [], []
        for f, n, seen in zip(df["frame_idx"], df["n_corners"], df["n_visible"], strict=True):
            held, age, empty, detect = cache_step(held, age, empty, f, n, seen, interval, least)
            at.append(held)
            ran.append(detect)
        return pd.DataFrame({"clip_id": df["clip_id"], "frame_idx": df["frame_idx"], "from_frame": at, "detected": ran})

    ship(frames.sparkSession)
    return frames.groupBy("clip_id").applyInPandas(lambda df: clip(df), "clip_id long, frame_idx long, from_frame long, detected boolean")


_LABELS = "clip_id long, frame_idx long, track_id int, team int, fresh boolean"


def vote_step(votes: list[int], team: int, looked: int | None, frame: int, class_id: int, predicted: int | None, every: int, last: int) -> tuple[list[int], int, int | None, bool]:
    """(votes, team, looked) after a box, and whether it was judged."""
    now = class_id != 2 and predicted is not None and (looked is None or frame - looked >= every)
    if now:
        looked = frame
        if predicted in (0, 1):
            votes = [*votes, int(predicted)][-last:]
            team = 0 if 2 * votes.count(0) >= len(votes) else 1
    return votes, team, looked, now


def team_labels(tracked: DataFrame, every: int = 60, last: int = 15) -> DataFrame:
    """clip_id, frame_idx, track_id, team, fresh of tracked boxes (clip_id, frame_idx, track_id, class_id, predicted: the team model's answer for the box).

    A track's team is voted on when it has none yet and then each ``every`` frames: the majority of its last votes, 0 on a tie; in between it keeps it. Referees (class 2) and boxes
    without a track have none. A prediction other than 0 or 1 is no vote; where it is null, the box wasn't looked at. Each track is a group, gone through in order."""

    def track(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("frame_idx", kind="stable")
        votes, team, looked, teams, fresh = [], -1, None, [], []
        for f, c, p in zip(df["frame_idx"], df["class_id"], df["predicted"], strict=True):
            votes, team, looked, now = vote_step(votes, team, looked, f, c, None if pd.isna(p) else p, every, last)
            teams.append(None if c == 2 else team)
            fresh.append(bool(now))
        return pd.DataFrame({"clip_id": df["clip_id"], "frame_idx": df["frame_idx"], "track_id": df["track_id"], "team": pd.array(teams, "Int32"), "fresh": fresh})

    ship(tracked.sparkSession)
    return tracked.filter("track_id >= 0").groupBy("clip_id", "track_id").applyInPandas(lambda df: track(df), _LABELS)


def flow_step(used: np.ndarray, last: np.ndarray | None, now: np.ndarray, moved: dict, least: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(corners in use, the detector's as last taken) after a frame. Corners: class_id, x, y, conf. moved: (x, y, error, status) by place, of those in use in the frame before."""
    changed = last is None or len(now) != len(last) or bool(((now[:, 0] != last[:, 0]) | (np.abs(now[:, 1:3] - last[:, 1:3]) > 0.5).any(1)).any())
    if changed or len(used) < least:
        return now, now
    if moved:
        kept = []
        for i, c in enumerate(used):
            x, y, error, status = moved.get(i, (0.0, 0.0, 0.0, False))
            if status and error <= 20 and 0 <= x < WIDTH and 0 <= y < HEIGHT:
                kept.append([c[0], x, y, c[3] * 0.995])
        if len(kept) >= least:
            return np.array(kept), last
    return used, last


def flow_corners(corners: DataFrame, flow: DataFrame, least: int = 4) -> DataFrame:
    """clip_id, frame_idx, corner_idx, class_id, x, y, conf: the corners in use in each frame.

    corners: each frame's corners as the detector (or its cache) has them; flow (clip_id, frame_idx, corner_idx, x, y, error, status): where the corners that were in use in the frame before, in their
    order, have moved. While the detector's corners stay the same, those in use move along; lost ones, ones of an error over 20 and ones outside the frame go, and confidence wears off. Where
    fewer than ``least`` are left, the ones in use stay as they were; where the detector's change, or fewer than ``least`` are in use, the detector's are taken. A clip is gone through in order."""

    def clip(key: tuple, seen: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        columns = ["class_id", "x", "y", "conf"]
        moved = moved.rename(columns=lambda c: c.removeprefix("flow_"))
        found = {f: g.sort_values("corner_idx")[columns].to_numpy(float) for f, g in seen.dropna(subset=["x"]).groupby("frame_idx")}
        flows = {f: dict(zip(g["corner_idx"], zip(g["x"], g["y"], g["error"], g["status"], strict=True), strict=True)) for f, g in moved.groupby("frame_idx")}
        none, rows, used, last = np.empty((0, 4)), [], np.empty((0, 4)), None
        for f in sorted(seen["frame_idx"].unique()):
            used, last = flow_step(used, last, found.get(f, none), flows.get(f, {}), least)
            rows += [(key[0], f, i, int(c[0]), *c[1:]) for i, c in enumerate(used)]
        return pd.DataFrame(rows, columns=["clip_id", "frame_idx", "corner_idx", *columns])

    ship(corners.sparkSession)
    # columns of its own, as both sides may come from one table
    own = flow.select(F.col("clip_id").alias("of_clip"), *[F.expr(f"{c}").alias(f"flow_{c}") for c in ("frame_idx", "corner_idx", "x", "y", "error", "status")])
    return corners.groupBy("clip_id").cogroup(own.groupBy("of_clip")).applyInPandas(lambda key, seen, moved: clip(key, seen, moved), "clip_id long, frame_idx long, corner_idx int, class_id int, x double, y double, conf double")


def visible(corners: DataFrame, least: float = 0.25) -> DataFrame:
    """clip_id, frame_idx, n_corners, n_visible (of enough confidence): what corner_cache() goes by."""
    return corners.groupBy("clip_id", "frame_idx").agg(F.count("x").alias("n_corners"), F.count_if(F.col("conf") >= least).alias("n_visible"))
