"""Frame and pitch coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .detections import frame

#: Pitch points in metres by corner class.
PITCH = {
    0: [(-36.0, -20.15), (-36.0, 20.15), (36.0, -20.15), (36.0, 20.15)],
    1: [(0.0, -9.15), (0.0, 9.15)],
    2: [(-52.5, -3.66), (-52.5, 3.66), (52.5, -3.66), (52.5, 3.66)],
    3: [(-41.5, 0.0), (41.5, 0.0)],
    4: [(0.0, 0.0)],
    5: [(-36.0, -7.32), (-36.0, 7.32), (36.0, -7.32), (36.0, 7.32)],
    6: [(-47.0, -9.15), (-47.0, 9.15), (47.0, -9.15), (47.0, 9.15)],
    7: [(-52.5, -34.0), (-52.5, 34.0), (52.5, -34.0), (52.5, 34.0)],
    8: [(0.0, -34.0), (0.0, 34.0)],
    9: [(-52.5, -20.15), (-52.5, 20.15), (52.5, -20.15), (52.5, 20.15)],
    10: [(-9.15, 0.0), (9.15, 0.0)],
    11: [(-52.5, -9.15), (-52.5, 9.15), (52.5, -9.15), (52.5, 9.15)],
    12: [(-32.35, 0.0), (32.35, 0.0)],
}
#: What is drawn of the pitch, in metres: kind, x1, y1, x2, y2 (circles and spots: centre, and radius in x2).
LINES = [
    ("rectangle", -52.5, -34.0, 52.5, 34.0),
    ("line", 0.0, -34.0, 0.0, 34.0),
    ("ellipse", 0.0, 0.0, 9.15, 9.15),
    ("spot", 0.0, 0.0, 0.0, 0.0),
    ("rectangle", -52.5, -20.15, -36.0, 20.15),
    ("rectangle", -52.5, -9.15, -47.0, 9.15),
    ("spot", -41.5, 0.0, 0.0, 0.0),
    ("rectangle", 36.0, -20.15, 52.5, 20.15),
    ("rectangle", 47.0, -9.15, 52.5, 9.15),
    ("spot", 41.5, 0.0, 0.0, 0.0),
]


def pitch_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, x, y) for c, ps in PITCH.items() for i, (x, y) in enumerate(ps)], "class_id int, ref_idx int, x double, y double")


def transform(h: list[float] | Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography (nine values by rows, or an array column of them); null where it goes to infinity."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) > 1e-12, w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def nearest(points: DataFrame, refs: DataFrame) -> DataFrame:
    """For each point (id, class_id, x, y) the squared distance to its class's nearest pitch point. refs is a constant."""
    r = F.broadcast(refs.select("class_id", "ref_idx", F.col("x").alias("rx"), F.col("y").alias("ry")))
    d = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    order = Window.partitionBy("id").orderBy("d2", "ref_idx")
    return points.join(r, "class_id").select("id", "ref_idx", d.alias("d2")).withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def pixels(x: Column, y: Column, width: int | Column = 1050, height: int | Column = 680) -> tuple[Column, Column]:
    return ((x + 52.5) * width / 105.0).cast("int"), ((y + 34.0) * height / 68.0).cast("int")


def inverse(h: list[float]) -> list[float]:
    """The inverse of a homography by its adjugate, up to scale."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def pitch_lines(canvases: DataFrame) -> DataFrame:
    """The pitch as a draw list in whole pixels on each canvas (width, height, and what it is known by): z is the order of drawing; spots have a radius of 3. The lines are few and fixed: each canvas's row brings them forth."""
    lines = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(kind).alias("kind"), *[F.lit(v).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), at, strict=True)]) for z, (kind, *at) in enumerate(LINES)])
    rows = canvases.select("*", F.inline(lines))
    width, height = F.col("width"), F.col("height")
    (px, py), (qx, qy) = (pixels(F.col(f"x{i}"), F.col(f"y{i}"), width, height) for i in (1, 2))
    radius = (F.col("x2") * width / 105.0).cast("int"), (F.col("y2") * height / 68.0).cast("int")
    far = [F.when(F.col("kind") == "spot", 3).when(F.col("kind") == "ellipse", r).otherwise(q) for r, q in zip(radius, (qx, qy), strict=True)]
    return rows.select(*[c for c in canvases.columns if c not in ("width", "height")], "z", "kind", px.alias("x"), py.alias("y"), far[0].alias("to_x"), far[1].alias("to_y"))


#: Colours of roles on the pitch, as blue, green, red.
COLOURS = {0: (128, 0, 128), 1: (0, 0, 255), 2: (255, 255, 255), 3: (0, 0, 0)}


def _colour_of(role: Column) -> Column:
    out = F.lit(None).cast("array<int>")
    for k, c in COLOURS.items():
        out = F.when(role == k, F.array(*map(F.lit, c))).otherwise(out)
    return out


def positions(points: DataFrame, coloured: bool = False) -> DataFrame:
    """Draw list of pitch points (id, role, x, y): roles 0 and 1 are teams, 2 the ball, 3 referees. Points that aren't numbers go."""
    px, py = pixels(F.col("x"), F.col("y"))
    role = F.col("role")
    shown = points.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    return shown.select("id", F.when(role == 3, "square").otherwise("circle").alias("kind"), px.alias("px"), py.alias("py"), F.when(role < 2, 8).otherwise(6).alias("radius"), *([_colour_of(role).alias("colour")] if coloured else []))


def tactical(boxes: DataFrame, h: list[float] | DataFrame) -> DataFrame:
    """clip_id (if there is one), frame_idx, det_idx, class_id, x, y on the pitch: people by their feet, the ball by its centre; boxes at infinity go.

    h is one homography, or those of each frame (h array<double>, valid); frames without a valid one have no points."""
    keys = frame(boxes)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, F.when(F.col("class_id") == 1, (F.col("y1") + F.col("y2")) / 2).otherwise(F.col("y2"))
    feet = boxes.select(*keys, "det_idx", "class_id", cx.alias("fx"), cy.alias("fy"))
    if isinstance(h, DataFrame):
        feet = feet.join(h.filter("valid").select(*keys, "h"), keys)
    x, y = transform(F.col("h") if isinstance(h, DataFrame) else h, F.col("fx"), F.col("fy"))
    return feet.select(*keys, "det_idx", "class_id", x.alias("x"), y.alias("y")).filter("x IS NOT NULL")


def overlay(width: Column, height: Column, w: int = 500, h: int = 350, margin: int = 10) -> list[Column]:
    """start_x, start_y, end_x, end_y of the tactical view at a frame's right top, within the frame; an empty one means that nothing is drawn."""
    start_x = F.greatest(F.lit(0), width - w - margin)
    return [start_x.alias("start_x"), F.lit(margin).alias("start_y"), (width - margin).alias("end_x"), F.least(F.lit(margin + h), height).alias("end_y")]


def overlay_frame(width: Column, height: Column, w: int = 500, h: int = 350, margin: int = 10) -> list[Column]:
    """What goes around the tactical view, if it has room: its border (two pixels outside) and where its caption stands."""
    start_x, start_y, end_x, end_y = (c.cast("int") for c in overlay(width, height, w, h, margin))
    room = (end_x > start_x) & (end_y > start_y)
    border = F.struct((start_x - 2).alias("x1"), (start_y - 2).alias("y1"), (end_x + 2).alias("x2"), (end_y + 2).alias("y2"))
    caption = F.struct(F.lit("Tactical View").alias("text"), start_x.alias("x"), (start_y - 5).alias("y"))
    return [F.when(room, border).alias("border"), F.when(room, caption).alias("caption")]
