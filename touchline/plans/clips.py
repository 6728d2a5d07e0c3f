"""Queries over raw tensors, and over what is found a clip at a time: team models, sets carried forward, pieces of a clip."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detections as d
from ..operators import homography, pitch, raw, teams, tracker
from ..sources.adapters import ANCHORS_SQL, BOXES_SQL, EMBEDDINGS_SQL, OBSERVATIONS_SQL, anchors, embeddings, observations
from .catalogue import _BOX, _H, _NMS, ORACLES, QUERIES, _boxes, query

__all__ = ["ORACLES", "QUERIES"]

#: Detections of the tensors that have one a column: over 100, so that their layout shows.
_WIDE = 128


def _tensors(spark, sf, scores, features: int):
    """Each frame's anchors as model output: one a row in even frames; in odd ones one a column, among empty ones that fill up. scores: an array of each anchor's class scores."""
    a = anchors(spark, sf)
    packed = a.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("det_idx", F.concat(F.array("cx", "cy", "w", "h"), scores).alias("f")))).alias("all"))
    by_row = F.flatten(F.transform("all", lambda x: x["f"]))
    at = lambda k: lambda i: F.coalesce(F.get(F.get(F.col("all"), i)["f"], k), F.lit(0.0))
    by_col = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(_WIDE - 1)), at(k))))
    even = F.col("frame_idx") % 2 == 0
    return packed.select("frame_idx", F.when(even, F.size("all")).otherwise(features).alias("rows"), F.when(even, features).otherwise(_WIDE).alias("cols"), F.when(even, by_row).otherwise(by_col).alias("values"))


@query(f"WITH {_NMS} SELECT {_BOX} FROM nms")
def decode_raw(spark, sf):
    """From raw output in both layouts to the same boxes as from decoded anchors."""
    scores = F.transform(F.array(*map(F.lit, range(3))), lambda k: F.when(k == F.col("class_id"), F.col("conf")).otherwise(0.0))
    return raw.boxes(_tensors(spark, sf, scores, 7))


@query(f"""WITH {ANCHORS_SQL}, s AS (SELECT frame_idx, det_idx, cx, cy - 8 AS y, list_transform(range(0, 13), lambda i: CAST((det_idx * 7 + i * 5 + frame_idx) % 13 AS DOUBLE) / 13) AS s FROM anchors)
SELECT frame_idx, det_idx, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS class_id, list_max(s) AS conf, cx AS x, y FROM s WHERE list_max(s) >= 0.25 AND cx BETWEEN 0 AND 1280 AND y BETWEEN 0 AND 720""")
def corners_raw(spark, sf):
    """Corners before suppression, from raw output of 13 scores in both layouts."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: ((F.col("det_idx") * 7 + i * 5 + F.col("frame_idx")) % 13).cast("double") / 13)
    return raw.candidates(_tensors(spark, sf, scores, 17))


@query(f"""WITH {BOXES_SQL}, f AS (SELECT DISTINCT frame_idx FROM anchors WHERE frame_idx % 7 <> 4 AND NOT (frame_idx % 60 BETWEEN 20 AND 29)),
l AS (SELECT stride, frame_idx, max(CASE WHEN frame_idx % stride = 0 THEN frame_idx END) OVER (PARTITION BY stride ORDER BY frame_idx) AS from_frame FROM f, (VALUES (CAST(1 AS INTEGER)), (2), (3)) t(stride))
SELECT stride, l.frame_idx, from_frame, count(*) AS n, CAST(sum(det_idx) AS BIGINT) AS places FROM l JOIN boxes b ON b.frame_idx = from_frame AND class_id <> 0 GROUP BY ALL""")
def carry_any_stride(spark, sf):
    """Balls and referees carried from looked-at frames at three strides, over a spine with holes, short and long: how many each frame shows, and the sum of their places."""
    spine = anchors(spark, sf).select("frame_idx").distinct().filter("frame_idx % 7 <> 4 AND NOT (frame_idx % 60 BETWEEN 20 AND 29)")
    b = _boxes(spark, sf).filter("class_id <> 0")
    out = None
    for s in (1, 2, 3):
        one = d.carry_forward(b, spine, stride=s).groupBy("frame_idx", "from_frame").agg(F.count("*").alias("n"), F.sum("det_idx").alias("places")).withColumn("stride", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


_CLIPS = 6


@query(f"""WITH {EMBEDDINGS_SQL}, c AS (SELECT vec_id % {_CLIPS} AS clip_id, vec_id // {_CLIPS} % 2 AS side FROM emb), n AS (SELECT clip_id, count(*) AS n, count(*) FILTER (side = 0) AS a FROM c GROUP BY 1)
SELECT clip_id, n, clip_id < {_CLIPS - 1} AS valid, CAST(CASE WHEN clip_id < {_CLIPS - 1} THEN least(a, n - a) ELSE 0 END AS BIGINT) AS smaller, CAST(CASE WHEN clip_id < {_CLIPS - 1} THEN 2 ELSE 1 END AS BIGINT) AS labels, CAST(2 AS BIGINT) AS combinations FROM n""")
def team_models(spark, sf):
    """Six clips whose kits and light differ: each is judged by its own model, fitted on a sample of its own. In five of them two sides differ; the last one's players all look alike, so its model isn't valid.

    What is compared doesn't depend on which side is called 0: sizes, and that sides and labels go together."""
    e = embeddings(spark, sf)
    clip, side = F.col("vec_id") % _CLIPS, F.floor(F.col("vec_id") / _CLIPS) % 2
    # the sides differ along axes of the clip's own, by less than clips do from one another
    look = F.transform("e", lambda x, i: F.when(clip == _CLIPS - 1, 0.0).otherwise(x + F.when(side == 1, F.when(i % _CLIPS == clip, 8.0).otherwise(0.0)).otherwise(0.0)) + 40.0 * clip)
    players = e.select(clip.alias("clip_id"), F.floor(F.col("vec_id") / (_CLIPS * 10)).alias("frame_idx"), F.col("vec_id").cast("int").alias("det_idx"), side.alias("side"), look.alias("feature"))
    # ten players a frame, each frame looked at in training
    players = players.withColumn("frame_idx", F.col("frame_idx") * 12)
    models = teams.fit_by_clip(players)
    labels = teams.predict_by_clip(players, models).join(players.select("clip_id", "frame_idx", "det_idx", "side"), ["clip_id", "frame_idx", "det_idx"])
    n = labels.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("predicted").alias("ones"), F.count_distinct("predicted").alias("labels"), F.count_distinct("predicted", "side").alias("combinations"))
    return n.join(models.select("clip_id", teams.separated(F.col("score")).alias("valid")), "clip_id").select("clip_id", "n", "valid", F.least("ones", F.col("n") - F.col("ones")).alias("smaller"), "labels", "combinations")


@query(f"""WITH {OBSERVATIONS_SQL}, g AS (SELECT clip_id, frame_idx, lag(frame_idx) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS before FROM (SELECT DISTINCT clip_id, frame_idx FROM obs WHERE event_id % 3 <> 1)),
s AS (SELECT clip_id, frame_idx, max(CASE WHEN before IS NULL OR frame_idx - 1 - before >= 6 THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS piece FROM g),
u AS (SELECT clip_id, piece, count(*) AS frames FROM s GROUP BY ALL)
SELECT clip_id, piece, frames, lead(piece) OVER (PARTITION BY clip_id ORDER BY piece) - 1 AS until FROM u""")
def clip_pieces(spark, sf):
    """Where clips fall apart: stretches of six empty frames, for a tracker that keeps lost tracks so long."""
    return tracker.pieces(observations(spark, sf).filter("event_id % 3 <> 1"), buffer=6).groupBy("clip_id", "piece", "until").agg(F.count("*").alias("frames"))


@query(f"""WITH {OBSERVATIONS_SQL}, o AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) - 1 AS k FROM obs) SELECT clip_id, k // 10 * 140 + k % 10 AS frame_idx, CAST(k // 10 + 1 AS INTEGER) AS track_id, 0 AS det_idx FROM o""")
def track_pieces(spark, sf):
    """An object that shows in ten frames and then goes for longer than any track lives: every appearance is a piece of its clip, and ids go on from piece to piece."""
    k = F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_idx")) - 1
    o = observations(spark, sf).select("clip_id", k.alias("k")).select("clip_id", (F.floor(F.col("k") / 10) * 140 + F.col("k") % 10).cast("long").alias("frame_idx"), F.lit(0).alias("det_idx"), (F.col("k") % 10).alias("step"))
    x = 100.0 + 3.0 * F.col("step")
    return tracker.run(o.select("clip_id", "frame_idx", "det_idx", (x - 20).alias("x1"), F.lit(60.0).alias("y1"), (x + 20).alias("x2"), F.lit(140.0).alias("y2"), F.lit(0.9).alias("conf")))


_BACK = "floor({v} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


@query(f"WITH {BOXES_SQL} SELECT frame_idx, det_idx, {_BACK.format(v='(x1 + x2) / 2')} AS x, {_BACK.format(v='CASE WHEN class_id = 1 THEN (y1 + y2) / 2 ELSE y2 END')} AS y FROM boxes WHERE frame_idx % 3 <> 0")
def to_frame_by_frame(spark, sf):
    """From the frame to the pitch and back, by each frame's own homography and its inverse; a third of them can't be inverted."""
    b = _boxes(spark, sf)
    odd = {3: F.when(F.col("frame_idx") % 3 == 0, 2 * _H[0]).otherwise(_H[3]), 4: F.when(F.col("frame_idx") % 3 == 0, 2 * _H[1]).otherwise(_H[4])}
    move = _H[2] + F.col("frame_idx") % 7
    h = F.array(*[odd.get(k, move if k == 2 else F.lit(v)) for k, v in enumerate(_H)])
    h = F.when(F.col("frame_idx") % 3 == 0, F.transform(h, lambda v, k: F.when(k == 5, 2 * move).otherwise(v))).otherwise(h)
    fits = b.select("frame_idx").distinct().withColumn("h", h)
    back = homography.to_frame(pitch.tactical(b, fits.withColumn("valid", F.lit(True))), fits)
    return back.select("frame_idx", "det_idx", *[(F.floor(F.col(c) * 1e6 + 0.5).cast("double") / 1e6).alias(n) for c, n in (("fx", "x"), ("fy", "y"))])
