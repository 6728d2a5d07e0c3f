"""Raw model output to boxes and corners: a tensor a frame, in either layout.

Tensors are a relation: clip_id (if there are several), frame_idx, rows, cols, and values, the flat array in row order. A tensor has a detection a row, or, where it has more columns than rows and more than 100, one a
column. Each is reshaped in Arrow without copying, and all its detections are thresholded in NumPy at once; only those that pass become rows. Padding, clamping, areas and suppression are the column expressions of
operators.detections, in the same plan. Tensors without rows or columns, with fewer than four features, or whose array isn't of their size, give nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import HEIGHT, PAD, WIDTH
from ..sources.package import ship
from .detections import BALL, MIN_CONF, PLAYER, REFEREE, decode, frame, nms, radius_nms

CORNER_CLASSES, CORNER_CONF = 13, 0.25


def oriented(values: np.ndarray, rows: int, cols: int) -> np.ndarray | None:
    """Features by detections: a view of values."""
    if rows <= 0 or cols <= 0 or len(values) != rows * cols:
        return None
    table = values.reshape(rows, cols)
    table = table if cols > rows and cols > 100 else table.T
    return table if len(table) >= 4 else None


def _scores(table: np.ndarray, n: int) -> np.ndarray:
    """n score rows; missing ones are 0."""
    found = table[4 : 4 + n]
    return np.vstack([found, np.zeros((n - len(found), table.shape[1]))]) if len(found) < n else found


def _objects(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, classes and scores of the detections that pass: the first class that no other exceeds and that reaches its threshold."""
    s = _scores(table, 3)
    cls = np.full(s.shape[1], -1)
    for k in (REFEREE, BALL, PLAYER):  # a tie goes to the first class
        cls[(s[k] >= MIN_CONF[k]) & np.all([s[k] >= s[j] for j in range(3) if j != k], axis=0)] = k
    at = np.flatnonzero(cls >= 0)
    return at, cls[at], s[cls[at], at]


def _corners(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of corners: the first class of the largest score."""
    s = _scores(table, CORNER_CLASSES)
    s = np.where(np.isnan(s), 0, s)
    cls = s.argmax(0)
    top = s[cls, np.arange(s.shape[1])]
    at = np.flatnonzero(top >= CORNER_CONF)
    return at, cls[at], top[at]


_FOUND = "det_idx int, class_id int, conf double, cx double, cy double, w double, h double"


def _survivors(outputs: DataFrame, passing: Callable) -> DataFrame:
    """A row a detection that passes: the frame, its place, class, score and centre box in the model's own pixels."""
    keys = frame(outputs)
    names = [*keys, *(c.split()[0] for c in _FOUND.split(", "))]

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tensors = b.column(len(keys) + 2)
            ends = tensors.offsets.to_numpy()
            flat = tensors.values.to_numpy(zero_copy_only=False)
            parts, frames = [], []
            for k, (r, c, null) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), tensors.is_null().to_pylist(), strict=True)):
                table = None if null or r is None or c is None else oriented(flat[ends[k] : ends[k + 1]], r, c)
                if table is not None:
                    at, cls, conf = passing(table)
                    parts.append([at, cls, conf, *table[:4, at]])
                    frames.append(np.full(len(at), k))
            if parts:
                cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
                of = pa.array(np.concatenate(frames))
                kinds = [pa.int32()] * 2 + [pa.float64()] * 5
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in range(len(keys))), *(pa.array(x).cast(t) for x, t in zip(cols, kinds, strict=True))], names=names)

    ship(outputs.sparkSession)
    given = outputs.select(*[F.col(k).cast("long") for k in keys], F.col("rows").cast("int"), F.col("cols").cast("int"), F.col("values").cast("array<double>"))
    return given.mapInArrow(lambda x: batch(x), ", ".join(f"{k} long" for k in keys) + f", {_FOUND}")


def boxes(outputs: DataFrame, limit: float = 0.7) -> DataFrame:
    """The frame, det_idx, class_id, conf, x1, y1, x2, y2 of raw detector output: thresholds, corners without padding, clamped, with an area, suppressed."""
    return nms(decode(_survivors(outputs, _objects)), limit)


def corners(outputs: DataFrame, radius: float = 15.0) -> DataFrame:
    """The frame, det_idx, class_id, conf, x, y of raw corner output: thresholds, inside the frame, suppressed by radius."""
    return radius_nms(candidates(outputs), radius)


def candidates(outputs: DataFrame) -> DataFrame:
    """Corners before suppression."""
    found = _survivors(outputs, _corners).withColumn("x", F.col("cx")).withColumn("y", F.col("cy") - PAD)
    return found.filter(F.col("x").between(0, WIDTH) & F.col("y").between(0, HEIGHT)).select(*frame(found), "det_idx", "class_id", "conf", "x", "y")
