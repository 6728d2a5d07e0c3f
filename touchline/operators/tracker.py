"""The tracker: the one sequential operator. A clip's frames are taken in order; a clip falls into pieces where no track can live on, and each piece is a group.

Matching first holds confident detections against all tracks, then less confident ones against active tracks alone. A track that misses is lost at once, can be found again by
overlap or appearance, and is dropped after ``buffer`` misses. Assignment is the optimum over allowed pairs: as many as possible, then the least cost; pairs beyond the cost limit go afterwards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.package import ship
from ..sources.shared import kept
from .sequences import running_max

HIGH, LOW, LIMIT, REID = 0.25, 0.10, 0.75, 0.35
FORBIDDEN = np.inf


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    side = np.maximum(hi - lo, 0)
    inter = side[:, :, 0] * side[:, :, 1]
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def solve(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of an optimal assignment: as many as possible, then the least cost; forbidden cells are infinite. Successive shortest augmenting paths.

    Each row may also stay alone, at a cost beyond any saving elsewhere, so a later row can take an earlier one's place."""
    n, real = cost.shape
    if n == 1:  # the row takes its least cell
        row = cost[0].tolist()
        fine = [j for j, c in enumerate(row) if -np.inf < c < np.inf]
        return [(0, min(fine, key=row.__getitem__))] if fine else []
    finite = cost[np.isfinite(cost)]
    cost = np.hstack([cost, np.full((n, n), (1.0 + 2 * np.abs(finite).max(initial=0.0)) * (n + 1))])
    m = cost.shape[1]
    row_of = [-1] * m
    u, v = np.zeros(n), np.zeros(m)
    for start in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, end = start, 0.0, -1
        while True:
            reach = base + cost[row] - u[row] - v
            better = ~done & (reach < dist)
            dist[better], prev[better] = reach[better], row
            open_ = np.where(done, np.inf, dist)
            j = int(np.argmin(open_)) if m else -1
            if j < 0 or not np.isfinite(open_[j]):
                break
            done[j], base = True, dist[j]
            if row_of[j] < 0:
                end = j
                break
            row = row_of[j]
        if end < 0:
            continue
        for j in np.flatnonzero(done):
            if row_of[j] >= 0:
                u[row_of[j]] += base - dist[j]
            v[j] -= base - dist[j]
        u[start] += base
        j = end
        while True:
            r = int(prev[j])
            if r == start:
                row_of[j] = r
                break
            nxt = row_of.index(r)
            row_of[j], j = r, nxt
    return sorted((r, j) for j, r in enumerate(row_of) if r >= 0 and j < real)


@dataclass
class Track:
    id: int
    box: np.ndarray
    feature: np.ndarray | None
    mean: np.ndarray = field(init=False)
    var: np.ndarray = field(init=False)
    missed: int = 0

    def __post_init__(self):
        c = _centre(self.box)
        self.mean = np.concatenate([c, np.zeros(4)])
        # each axis by itself: position variance, covariance, velocity variance
        self.var = np.tile(np.array([[10.0], [0.0], [10.0]]), (1, 4))
        seen, self.feature = self.feature, None
        self.look(seen)

    def predict(self) -> None:
        self.mean[:4] += self.mean[4:]
        self.mean[2:4] = np.maximum(self.mean[2:4], 1)
        a, b, c = self.var
        self.var = np.array([a + 2 * b + c + 1.0, b + c, c + 0.25])
        x, y, w, h = self.mean[:4].tolist()
        self.box = np.array([x - w / 2, y - h / 2, x + w / 2, y + h / 2])

    def update(self, box: np.ndarray, conf: float, feature: np.ndarray | None) -> None:
        k = 1 - min(max(conf, 0.05), 1)
        noise = np.array([10 * k + 1, 10 * k + 1, 50 * k + 5, 50 * k + 5])
        a, b, c = self.var
        g0, g1 = a / (a + noise), b / (a + noise)
        e = _centre(box) - self.mean[:4]
        self.mean = np.concatenate([self.mean[:4] + g0 * e, self.mean[4:] + g1 * e])
        self.mean[2:4] = np.maximum(self.mean[2:4], 1)
        self.var = np.array([np.maximum((1 - g0) * a, 1e-6), (1 - g0) * b, np.maximum(c - g1 * b, 1e-6)])
        self.box, self.missed = box, 0
        self.look(feature)

    def look(self, feature: np.ndarray | None) -> None:
        """Blend what the object looks like into the track's own feature, of length 1."""
        if feature is not None:
            f = feature if self.feature is None or len(self.feature) != len(feature) else 0.9 * self.feature + 0.1 * feature
            n = float(np.linalg.norm(f))
            self.feature = f / n if n > 1e-6 else f


def _centre(b: np.ndarray) -> np.ndarray:
    b = b.tolist()
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]])


def appearance(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 1.0
    n = float(a @ a), float(b @ b)
    return 1.0 if min(n) <= 1e-12 else 1.0 - min(max(float(a @ b) / (n[0] * n[1]) ** 0.5, -1.0), 1.0)


def likeness(a: list[np.ndarray | None], b: list[np.ndarray | None]) -> np.ndarray:
    """appearance() of all pairs: vectors of one size at a time."""
    out = np.ones((len(a), len(b)))
    for size in {len(x) for x in a if x is not None and len(x)}:
        i, j = ([k for k, x in enumerate(side) if x is not None and len(x) == size] for side in (a, b))
        if j:
            p, q = np.array([a[k] for k in i]), np.array([b[k] for k in j])
            n, m = (p * p).sum(1), (q * q).sum(1)
            fine = (n > 1e-12)[:, None] & (m > 1e-12)[None]
            with np.errstate(all="ignore"):
                cosine = np.clip(p @ q.T / np.sqrt(n[:, None] * m[None]), -1.0, 1.0)
            out[np.ix_(i, j)] = np.where(fine, 1.0 - cosine, 1.0)
    return out


def costs(tracks: list[Track], boxes: np.ndarray, features: list, least: float) -> np.ndarray:
    if not tracks or not len(boxes):
        return np.full((len(tracks), len(boxes)), FORBIDDEN)
    over = iou_matrix(np.array([t.box for t in tracks]), boxes)
    looks = [t.feature for t in tracks]
    if all(f is None for f in looks) or all(f is None for f in features):  # overlap alone
        return np.where(over > least, 1 - over, FORBIDDEN)
    app = likeness(looks, features)
    both = np.array([f is not None for f in looks])[:, None] & np.array([f is not None for f in features])[None]
    lost = np.array([t.missed > 0 for t in tracks])[:, None]
    again = np.where(lost & (app <= REID), 0.45 + 0.45 * app + 0.10 * (1 - over), FORBIDDEN)
    return np.where(over > least, np.where(both, 0.75 * (1 - over) + 0.25 * app, 1 - over), again)


class Tracker:
    def __init__(self, match: float = 0.35, buffer: int = 120):
        self.match, self.buffer = match, buffer
        self.reset()

    def reset(self) -> None:
        self.active: list[Track] = []
        self.lost: list[Track] = []
        self.next_id = 1

    def update(self, boxes: np.ndarray, conf: np.ndarray, features: list, predicted: bool = False) -> list[tuple[int, int]]:
        """(track id, detection's place; -1: predicted) of the frame, in the order matched, found, new."""
        for t in (*self.active, *self.lost):
            t.predict()
        if predicted:
            for t in self.active:
                t.missed += 1
            return [(t.id, -1) for t in self.active]
        order = np.argsort(-conf, kind="stable")[:40]
        high, low = [i for i in order if conf[i] >= HIGH], [i for i in order if LOW <= conf[i] < HIGH]
        out, pool = [], [*self.active, *self.lost]
        matched: set[int] = set()

        def match(tracks: list[Track], at: list[int], least: float) -> list[int]:
            if not tracks or not at:
                return at
            cost = costs(tracks, boxes[at].reshape(-1, 4), [features[i] for i in at], least)
            left = set(range(len(at)))
            for r, j in sorted(solve(cost), key=lambda p: p[1]):
                if cost[r, j] <= LIMIT:
                    tracks[r].update(boxes[at[j]], conf[at[j]], features[at[j]])
                    matched.add(tracks[r].id)
                    out.append((tracks[r].id, int(at[j])))
                    left.discard(j)
            return [at[j] for j in sorted(left)]

        fresh = match(pool, high, self.match)
        match([t for t in self.active if t.id not in matched], low, 0.25)
        for t in pool:
            if t.id not in matched:
                t.missed += 1
        self.active = [t for t in pool if t.id in matched]
        self.lost = [t for t in pool if t.id not in matched and t.missed < self.buffer]
        for i in fresh:
            self.active.append(Track(self.next_id, boxes[i], features[i]))
            out.append((self.next_id, int(i)))
            self.next_id += 1
        return out


def features(g: pd.DataFrame, column: str | None) -> list[np.ndarray | None]:
    """Each row's feature; None where there is no column, or a null, empty or not finite vector."""
    return vectors(g[column], len(g)) if column else [None] * len(g)


def vectors(column, n: int) -> list[np.ndarray | None]:
    """The same of n values."""
    out = [None] * n
    for k, v in enumerate(column):
        if v is not None and len(f := np.asarray(v, float)) and np.isfinite(f).all():
            out[k] = f
    return out


#: Frames that a lost track is kept for.
BUFFER = 120


def pieces(detections: DataFrame, stride: int = 1, buffer: int = BUFFER) -> DataFrame:
    """clip_id, frame_idx, piece, until of the frames with detections: a clip's independent pieces, known by their first frame; until: the frame before the next piece's (null: the clip's last piece).

    After ``buffer`` looked-at frames without a box no track can live, so what follows doesn't depend on what was before: a new piece starts there. Found by scans in blocks of frames, not by going through a clip."""
    frames = kept(detections.select("clip_id", "frame_idx").distinct())
    look = F.when(F.col("frame_idx") % stride == 0, F.col("frame_idx"))
    seen = running_max(frames, look, "before", strict=True)
    # looked-at frames between the last one with a box and this one, which may itself be a predicted one
    empty = F.floor((F.col("frame_idx") - 1) / stride) - F.floor(F.col("before") / stride)
    starts = seen.withColumn("start", F.when(look.isNotNull() & (F.col("before").isNull() | (empty >= buffer)), F.col("frame_idx")))
    named = kept(running_max(starts, F.col("start"), "piece").select("clip_id", "frame_idx", F.coalesce("piece", "frame_idx").alias("piece")))
    following = named.select("clip_id", "piece").distinct().withColumn("until", F.lead("piece").over(Window.partitionBy("clip_id").orderBy("piece")) - 1)
    return named.join(following, ["clip_id", "piece"])


def run(detections: DataFrame, stride: int = 1, feature: str | None = None, boxes: bool = False, last: str | None = None, cut: bool = True) -> DataFrame:
    """clip_id, frame_idx, track_id, det_idx (null where predicted), with ``boxes`` also x1, y1, x2, y2, conf (null where predicted), from detections (clip_id, frame_idx, det_idx, x1, y1, x2, y2, conf).

    Frames without a row count as seen and empty, from the clip's first frame to its last; with stride s, other frames than each s-th are predicted. Where no track is left, empty frames are passed over at once.
    ``last`` names a column that holds the clip's last frame, where that may come after the last one with a box.
    ``feature`` names a column of appearance vectors (arrays), by which lost tracks are found again away from their predicted place; without it overlap alone counts.

    The unit of parallel work is a clip's piece between two stretches that no track outlives (pieces()): each is tracked by itself, from 1 on, and its ids are then raised by the number of tracks of the clip's pieces before
    it. cut=False tracks each clip as one piece, with the same result."""
    ship(detections.sparkSession)
    schema = "clip_id long, piece long, frame_idx long, track_id int, det_idx int" + ", x1 double, y1 double, x2 double, y2 double, conf double" * boxes
    names = [x.split()[0] for x in schema.split(", ")]

    columns = ["clip_id", "piece", "until", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "conf", *([last] if last else []), *([feature] if feature else [])]

    def piece(t: pa.Table) -> list[tuple]:
        """What is found in a piece's rows, which are in order."""
        at = t.column("frame_idx").to_numpy()
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        order = at[starts].tolist()
        frames = dict(zip(order, zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True), strict=True))
        ids, conf = t.column("det_idx").to_pylist(), t.column("conf").to_numpy()
        xy = np.stack([t.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], 1)
        looks = vectors(t.column(feature).to_numpy(), len(at)) if feature else [None] * len(at)
        until = t.column("until")[0].as_py()
        tracks, rows = Tracker(buffer=BUFFER), []
        f, end = order[0], max(order[-1], t.column(last)[0].as_py()) if last else order[-1]
        if until is not None:
            end = until
        head = t.column("clip_id")[0].as_py(), t.column("piece")[0].as_py()
        while f <= end:
            if f > order[-1] and not tracks.active:
                break  # lost tracks show nothing without a box
            if f not in frames and not tracks.active and not tracks.lost:
                f = order[bisect_right(order, f)]
            m, n = frames.get(f, (0, 0))
            found = tracks.update(xy[m:n], conf[m:n], looks[m:n], predicted=f % stride != 0)
            place = {x.id: x.box for x in tracks.active} if boxes else {}
            for i, k in found:
                rows.append((*head, f, i, ids[m + k] if k >= 0 else None, *((*place[i], conf[m + k] if k >= 0 else None) if boxes else ())))
            f += 1
        return rows

    def result(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.float64()] * 5 * boxes
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's pieces one after the other: its rows come in order, and only the piece that isn't whole yet is held."""
        held, key, rows = [], None, []
        for b in batches:
            if not b.num_rows:
                continue
            clip, of = (b.column(k).to_numpy() for k in range(2))
            starts = [0, *(np.flatnonzero((clip[1:] != clip[:-1]) | (of[1:] != of[:-1])) + 1).tolist(), b.num_rows]
            for m, n in zip(starts, starts[1:], strict=False):
                if held and key != (clip[m], of[m]):
                    rows += piece(pa.Table.from_batches(held))
                    held = []
                key = clip[m], of[m]
                held.append(b.slice(m, n - m))
            if len(rows) > 50_000:
                yield result(rows)
                rows = []
        if held:
            yield result(rows + piece(pa.Table.from_batches(held)))

    # dealt out by number: pieces are small and their work is long, so tasks aren't put together by their size
    tasks = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def track(rows: DataFrame) -> DataFrame:
        given = rows.select(*[F.col(c).cast({"clip_id": "long", "frame_idx": "long", "det_idx": "int", last: "long"}.get(c, "double")) if c not in ("piece", "until", feature) else F.col(c) for c in columns])
        return given.repartition(tasks, "clip_id", "piece").sortWithinPartitions("clip_id", "piece", "frame_idx", "det_idx").mapInArrow(lambda x: task(x), schema)

    if not cut:
        whole = detections.withColumn("piece", F.lit(0).cast("long")).withColumn("until", F.lit(None).cast("long"))
        return track(whole).drop("piece")
    at = pieces(detections, stride)
    tracked = track(detections.join(at, ["clip_id", "frame_idx"]))
    tracked = kept(tracked)
    births = tracked.groupBy("clip_id", "piece").agg(F.max("track_id").alias("births"))
    before = Window.partitionBy("clip_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    raised = births.select("clip_id", "piece", F.coalesce(F.sum("births").over(before), F.lit(0)).cast("int").alias("raise"))
    return tracked.join(raised, ["clip_id", "piece"]).withColumn("track_id", F.col("track_id") + F.col("raise")).select(*[n for n in names if n != "piece"])
