"""Column expressions over boxes and points; all compute in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, HEIGHT, PAD = 1280.0, 720.0, 8.0


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs (x1, y1, x2, y2); 0 where the union isn't positive."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = w * h
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def clamp(v: Column, top: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, F.lit(top)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """1 - cosine, clamped; 1 where a side is empty, has no length, or differs in size. na, nb: the sides' squared lengths, where they are known."""
    na, nb = dot(a, a) if na is None else na, dot(b, b) if nb is None else nb
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 1e-12) & (nb > 1e-12)
    return F.when(usable, 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.sqrt(na) * F.sqrt(nb))))).otherwise(F.lit(1.0))


def grid(v: Column, steps: float = 1e6) -> Column:
    """v on a grid, for sums whose order isn't fixed."""
    return F.floor(v * F.lit(steps) + F.lit(0.5)).cast("double") / F.lit(steps)
