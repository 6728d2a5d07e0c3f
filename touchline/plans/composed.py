"""Queries over several clips, and over what the engine composes: team votes, corners in use, telemetry, drawing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import engine
from ..operators import detections as d
from ..operators import pitch, sequences, teams
from ..sources import sinks
from ..sources.adapters import BOXES_SQL, OBSERVATIONS_SQL, embeddings, observations, table
from . import clips, extended
from .catalogue import _H_SQL, _MOVING, _NMS, _ON_PITCH, ORACLES, QUERIES, _boxes, _moving, _on_pitch, query

__all__ = ["ORACLES", "QUERIES"]
assert extended.QUERIES is clips.QUERIES is QUERIES


def _by_clip(df):
    """Two clips whose frames have the same numbers."""
    return df.withColumn("clip_id", F.col("frame_idx") % 2).withColumn("frame_idx", F.floor(F.col("frame_idx") / 2).cast("long"))


_CLIP = "frame_idx % 2 AS clip_id, CAST(floor(frame_idx / 2) AS BIGINT) AS frame_idx"


@query(f"WITH {_NMS} SELECT {_CLIP}, det_idx, class_id, conf FROM nms")
def nms_by_clip(spark, sf):
    return d.nms(_by_clip(_boxes(spark, sf))).select("clip_id", "frame_idx", "det_idx", "class_id", "conf")


@query(f"""WITH {BOXES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, class_id ORDER BY conf DESC, det_idx) AS rn FROM boxes WHERE class_id > 0)
SELECT {_CLIP}, det_idx, class_id, CAST(CASE WHEN class_id = 2 THEN rn - 1 END AS INTEGER) AS referee_id FROM r WHERE class_id = 2 OR rn = 1""")
def ball_referee_view(spark, sf):
    """A frame's ball, if it has an area, and its referees by ordinal."""
    b = _by_clip(_boxes(spark, sf))
    balls = d.best_ball(d.valid_balls(b)).select("clip_id", "frame_idx", "det_idx", "class_id", F.lit(None).cast("int").alias("referee_id"))
    return balls.unionByName(b.join(d.referee_ordinals(b), ["clip_id", "frame_idx", "det_idx"]).select("clip_id", "frame_idx", "det_idx", "class_id", "referee_id"))


@query(f"""WITH {BOXES_SQL}, t AS (SELECT *, det_idx % 7 - 1 AS track_id FROM boxes WHERE class_id = 0),
k AS (SELECT frame_idx, track_id, max(det_idx) AS det_idx FROM t WHERE track_id >= 0 GROUP BY ALL),
b AS (SELECT frame_idx, det_idx, row_number() OVER (PARTITION BY frame_idx ORDER BY conf DESC, det_idx) AS rn FROM boxes WHERE class_id = 1),
f AS (SELECT DISTINCT frame_idx FROM anchors), r AS (SELECT frame_idx, count(*) AS referees FROM boxes WHERE class_id = 2 GROUP BY 1)
SELECT f.frame_idx, (SELECT count(*) FROM k WHERE k.frame_idx = f.frame_idx) AS players, (SELECT sum(track_id) FROM k WHERE k.frame_idx = f.frame_idx) AS ids, b.det_idx AS ball, r.referees
FROM f LEFT JOIN b ON b.frame_idx = f.frame_idx AND rn = 1 LEFT JOIN r ON r.frame_idx = f.frame_idx""".replace("sum(track_id)", "CAST(sum(track_id) AS BIGINT)"))
def stored_tracks(spark, sf):
    """What is kept of each frame: tracks and the sum of their ids, the ball's place, referees."""
    from ..sources.adapters import anchors

    b = _boxes(spark, sf)
    players, balls, referees = engine.store_tracks(b.filter("class_id = 0").withColumn("track_id", F.col("det_idx") % 7 - 1), b, b.filter("class_id = 2"))
    out = anchors(spark, sf).select("frame_idx").distinct().join(players.groupBy("frame_idx").agg(F.count("*").alias("players"), F.sum("track_id").alias("ids")), "frame_idx", "left").na.fill(0, ["players"])
    return out.join(balls.select("frame_idx", F.col("det_idx").alias("ball")), "frame_idx", "left").join(referees.groupBy("frame_idx").agg(F.count("*").alias("referees")), "frame_idx", "left")


_VOTES = "votes AS (SELECT user_id AS track_id, event_id AS seq, CASE WHEN event_id % 4 = 3 THEN -1 WHEN event_id % 9 = 5 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 2 AS INTEGER) END AS vote FROM events)"


def _votes(spark, sf):
    vote = F.when(F.col("event_id") % 4 == 3, -1).when(F.col("event_id") % 9 != 5, (F.floor(F.col("value")) % 2).cast("int"))
    return table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), vote.alias("vote"))


@query(f"""WITH {_VOTES}, k AS (SELECT *, count(*) FILTER (vote IN (0, 1)) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM votes),
g AS (SELECT track_id, k, vote FROM k WHERE vote IN (0, 1)),
n AS (SELECT track_id, k, 2 * sum(vote) OVER w > count(*) OVER w AS second FROM g WINDOW w AS (PARTITION BY track_id ORDER BY k ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
SELECT k.track_id, k.seq, CAST(n.second AS INTEGER) AS label FROM k LEFT JOIN n ON n.track_id = k.track_id AND n.k = k.k""")
def vote_invalid(spark, sf):
    """Votes among which some don't count."""
    return sequences.majority(_votes(spark, sf))


@query(f"""WITH RECURSIVE {_VOTES}, o AS (SELECT track_id % 2 AS clip_id, CAST(track_id AS INTEGER) AS track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY seq) * 7 AS BIGINT) AS frame_idx, CAST(CASE WHEN seq % 11 = 0 THEN 2 ELSE 0 END AS INTEGER) AS class_id, vote FROM votes),
s AS (SELECT track_id, CAST(0 AS BIGINT) AS frame_idx, CAST(NULL AS BIGINT) AS looked, CAST([] AS INTEGER[]) AS v, CAST(NULL AS BIGINT) AS clip_id, CAST(NULL AS INTEGER) AS team, false AS fresh FROM o GROUP BY 1
UNION ALL SELECT track_id, frame_idx, CASE WHEN now THEN frame_idx ELSE looked END, v2, clip_id, CASE WHEN class_id = 2 THEN NULL WHEN len(v2) = 0 THEN -1 WHEN 2 * list_sum(v2) <= len(v2) THEN 0 ELSE 1 END, now FROM
  (SELECT *, CASE WHEN now AND vote IN (0, 1) THEN list_slice(list_append(v, vote), greatest(1, len(v) - 13), len(v) + 1) ELSE v END AS v2 FROM
  (SELECT o.*, s.looked, s.v, o.class_id <> 2 AND o.vote IS NOT NULL AND (s.looked IS NULL OR o.frame_idx - s.looked >= 60) AS now FROM s JOIN o ON o.track_id = s.track_id AND o.frame_idx = s.frame_idx + 7) a) b)
SELECT clip_id, frame_idx, track_id, CAST(team AS INTEGER) AS team, fresh FROM s WHERE clip_id IS NOT NULL""")
def team_votes(spark, sf):
    """Tracks that are looked at each 60 frames; an eleventh of their boxes are a referee's."""
    v = _votes(spark, sf)
    at = F.row_number().over(Window.partitionBy("track_id").orderBy("seq")) * 7
    o = v.select((F.col("track_id") % 2).alias("clip_id"), F.col("track_id").cast("int").alias("track_id"), at.cast("long").alias("frame_idx"), F.when(F.col("seq") % 11 == 0, 2).otherwise(0).alias("class_id"), F.col("vote").alias("predicted"))
    return sequences.team_labels(o)


def _seen_corners(spark, sf, frames: int = 20, corners: int = 6):
    """Corners of five clips: found anew in each tenth frame; flow moves them by 2 pixels a frame, and loses the last one in each seventh frame of ten."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("clip_id"))
    o = r.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long")))).withColumn("corner_idx", F.explode(F.sequence(F.lit(0), F.lit(corners - 1))))
    at = F.floor(F.col("frame_idx") / 10)
    x, y = 100.0 + 150.0 * F.col("corner_idx") + 30.0 * at, 50.0 + 90.0 * F.col("corner_idx") + F.col("clip_id")
    found = o.select("clip_id", "frame_idx", "corner_idx", (F.col("corner_idx") % 13).cast("int").alias("class_id"), x.alias("x"), y.alias("y"), F.lit(0.9).alias("conf"))
    since = (F.col("frame_idx") % 10).cast("double")
    flow = o.select("clip_id", "frame_idx", "corner_idx", (x + 2.0 * since).alias("x"), y.alias("y"), F.lit(1.0).alias("error"), (~((F.col("corner_idx") == corners - 1) & (F.col("frame_idx") % 10 == 7))).alias("status"))
    return found, flow


@query("""SELECT CAST(r_regionkey AS BIGINT) AS clip_id, CAST(f AS BIGINT) AS frame_idx, CAST(i AS INTEGER) AS corner_idx, CAST(i AS INTEGER) AS class_id, 100.0::DOUBLE + 150 * i + 30 * floor(f / 10) + 2 * (f % 10) AS x, 50.0::DOUBLE + 90 * i + r_regionkey AS y,
floor(0.9::DOUBLE * pow(0.995::DOUBLE, f % 10) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS conf FROM region, range(0, 20) a(f), range(0, 6) b(i) WHERE NOT (i = 5 AND f % 10 >= 7)""")
def flow_corners(spark, sf):
    found, flow = _seen_corners(spark, sf)
    return sequences.flow_corners(found, flow).withColumn("conf", F.floor(F.col("conf") * 1e9 + 0.5).cast("double") / 1e9)


@query("SELECT CAST(r_regionkey AS BIGINT) AS clip_id, CAST(f AS BIGINT) AS frame_idx, CAST(6 AS BIGINT) AS n_corners, CAST(CASE WHEN f % 3 = 0 THEN 3 ELSE 6 END AS BIGINT) AS n_visible FROM region, range(0, 20) a(f)")
def visible_corners(spark, sf):
    found, _ = _seen_corners(spark, sf)
    return sequences.visible(found.withColumn("conf", F.when((F.col("frame_idx") % 3 == 0) & (F.col("corner_idx") > 2), 0.2).otherwise(F.col("conf"))))


_BALLS_SQL = f"{OBSERVATIONS_SQL}, b AS (SELECT clip_id, frame_idx, x, y, 10.0::DOUBLE + event_id % 7 AS w, 12.0::DOUBLE + event_id % 5 AS h, event_id % 6 <> 0 AS valid FROM obs), seen AS (SELECT clip_id, frame_idx, x - w / 2 AS x1, y - h / 2 AS y1, x + w / 2 AS x2, y + h / 2 AS y2 FROM b WHERE valid)"


@query(f"""WITH {_BALLS_SQL}, c AS (SELECT clip_id, frame_idx, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, x2 - x1 AS w, y2 - y1 AS h FROM seen),
g AS (SELECT clip_id, frame_idx AS f1, x AS x0, y AS y0, w AS w0, h AS h0, lead(frame_idx) OVER o AS f2, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(w) OVER o AS w1, lead(h) OVER o AS h1, lag(frame_idx) OVER o AS f0, lag(x) OVER o AS px, lag(y) OVER o AS py FROM c WINDOW o AS (PARTITION BY clip_id ORDER BY frame_idx)),
i AS (SELECT *, CAST(f2 - f1 AS DOUBLE) AS gap, CAST(f1 - f0 AS DOUBLE) AS before FROM g WHERE f2 - f1 BETWEEN 2 AND 30),
v AS (SELECT *, CASE WHEN before <= 30 THEN (x0 - px) / before ELSE (nx - x0) / gap END AS vx, CASE WHEN before <= 30 THEN (y0 - py) / before ELSE (ny - y0) / gap END AS vy FROM i),
a AS (SELECT *, 2.0::DOUBLE * (nx - x0 - vx * gap) / (gap * gap) AS ax, 2.0::DOUBLE * (ny - y0 - vy * gap) / (gap * gap) AS ay, unnest(range(f1 + 1, f2)) AS f FROM v),
t AS (SELECT *, CAST(f - f1 AS DOUBLE) AS t FROM a), q AS (SELECT *, x0 + vx * t + 0.5::DOUBLE * ax * t * t AS x, y0 + vy * t + 0.5::DOUBLE * ay * t * t AS y, w0 + t / gap * (w1 - w0) AS w, h0 + t / gap * (h1 - h0) AS h FROM t),
e AS (SELECT clip_id, frame_idx, true AS seen, x1, y1, x2, y2 FROM seen UNION ALL SELECT clip_id, CAST(f AS BIGINT), false, greatest(0, least(x - 0.5::DOUBLE * w, 1280)), greatest(0, least(y - 0.5::DOUBLE * h, 720)), greatest(0, least(x + 0.5::DOUBLE * w, 1280)), greatest(0, least(y + 0.5::DOUBLE * h, 720)) FROM q)
SELECT clip_id, frame_idx, seen, {", ".join(f"floor({c} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS {c}" for c in ("x1", "y1", "x2", "y2"))} FROM e""")
def ball_boxes(spark, sf):
    """Observed balls, a sixth of them without an area, and the boxes in between."""
    w, h = 10.0 + F.col("event_id") % 7, 12.0 + F.col("event_id") % 5
    flat = F.col("event_id") % 6 == 0
    box = {"x1": F.col("x") - w / 2, "y1": F.col("y") - h / 2, "x2": F.when(flat, F.col("x") - w / 2).otherwise(F.col("x") + w / 2), "y2": F.col("y") + h / 2}
    o = observations(spark, sf).select("clip_id", "frame_idx", F.lit(1).alias("class_id"), F.lit(0.8).alias("conf"), *[v.alias(k) for k, v in box.items()])
    return sequences.interpolate_boxes(o).select("clip_id", "frame_idx", (F.col("conf") > 0.5).alias("seen"), *[(F.floor(F.col(c) * 1e6 + 0.5).cast("double") / 1e6).alias(c) for c in box])


@query("SELECT c_custkey AS track_id, CAST(1 AS BIGINT) AS clip_id, c_custkey % 9 AS frame_idx, CAST(CASE WHEN c_custkey % 5 < 2 THEN c_custkey % 2 ELSE 7 END AS INTEGER) AS class_id FROM customer")
def player_teams(spark, sf):
    """Players whose frame has a team for their track take it; others keep their class."""
    c = table(spark, sf, "customer").select(F.lit(1).cast("long").alias("clip_id"), (F.col("c_custkey") % 9).alias("frame_idx"), F.col("c_custkey").alias("track_id"), F.lit(7).alias("class_id"))
    return d.with_teams(c, c.filter("track_id % 5 < 2").select("clip_id", "frame_idx", "track_id", (F.col("track_id") % 2).cast("int").alias("team")))


@query(f"""WITH {BOXES_SQL}, f AS (SELECT DISTINCT frame_idx FROM anchors), c AS (SELECT frame_idx, count(*) FILTER (class_id = 0 AND det_idx % 3 = 0) AS a, count(*) FILTER (class_id = 0 AND det_idx % 3 = 1) AS b, count(*) FILTER (class_id = 1) AS l, count(*) FILTER (class_id = 2) AS r FROM boxes GROUP BY 1)
SELECT f.frame_idx, coalesce(a, 0) AS num_team1, coalesce(b, 0) AS num_team2, coalesce(a, 0) + coalesce(b, 0) AS num_players, coalesce(l, 0) AS num_balls, coalesce(r, 0) AS num_referees FROM f LEFT JOIN c ON c.frame_idx = f.frame_idx""")
def team_counts(spark, sf):
    """A third of all players is of each team, a third of none."""
    from ..sources.adapters import anchors

    b = _boxes(spark, sf)
    return d.team_counts(anchors(spark, sf), b.filter("class_id = 0").withColumn("class_id", F.col("det_idx") % 3), b.filter("class_id = 1"), b.filter("class_id = 2"))


_BY_FRAME = [*_H_SQL[:2], f"({_H_SQL[2]} + frame_idx % 7)", *_H_SQL[3:]]
_AT = f"({_H_SQL[6]} * fx + {_H_SQL[7]} * fy + {_H_SQL[8]})"


@query(f"""WITH {BOXES_SQL}, f AS (SELECT frame_idx, det_idx, class_id, (x1 + x2) / 2 AS fx, CASE WHEN class_id = 1 THEN (y1 + y2) / 2 ELSE y2 END AS fy FROM boxes WHERE frame_idx % 3 <> 0)
SELECT frame_idx, det_idx, class_id, ({_BY_FRAME[0]} * fx + {_BY_FRAME[1]} * fy + {_BY_FRAME[2]}) / {_AT} AS x, ({_H_SQL[3]} * fx + {_H_SQL[4]} * fy + {_H_SQL[5]}) / {_AT} AS y FROM f WHERE abs({_AT}) > 1e-12""")
def tactical_by_frame(spark, sf):
    """Each frame has a homography of its own; a third of them none that is valid."""
    from .catalogue import _H

    b = _boxes(spark, sf)
    h = F.array(*[F.lit(v) if k != 2 else F.lit(v) + F.col("frame_idx") % 7 for k, v in enumerate(_H)])
    return pitch.tactical(b, b.select("frame_idx").distinct().select("frame_idx", h.alias("h"), (F.col("frame_idx") % 3 != 0).alias("valid")))


@query("""SELECT page_id, CASE WHEN ends_with(p, '.json') THEN 'json' ELSE 'video' END AS kind FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.mp4' ELSE '.json.bak' END AS p FROM pages)""")
def output_kind(spark, sf):
    end = F.when(F.col("page_id") % 3 == 0, ".json").when(F.col("page_id") % 3 == 1, ".mp4").otherwise(".json.bak")
    return table(spark, sf, "pages").select("page_id", sinks.output_kind(F.concat("url", end)).alias("kind"))


_ODD = "CASE WHEN p_partkey % 5 = 0 THEN 'NaN'::DOUBLE WHEN p_partkey % 7 = 0 THEN 'inf'::DOUBLE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice / 3.0::DOUBLE END"
_JSON_NUMBER = "CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN 'null' ELSE printf('%.2f', {v}) END"


@query(f"SELECT p_partkey, {_JSON_NUMBER.format(v='v')} AS number, '[' || {_JSON_NUMBER.format(v='v')} || ',' || {_JSON_NUMBER.format(v='w')} || ']' AS point FROM (SELECT p_partkey, {_ODD} AS v, p_size / 7.0::DOUBLE AS w FROM part)")
def json_numbers(spark, sf):
    k = F.col("p_partkey")
    v = F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf")).when(k % 11 == 0, F.lit(None)).otherwise(F.col("p_retailprice") / 3.0)
    return table(spark, sf, "part").select("p_partkey", sinks.json_number(v).alias("number"), sinks.json_array(v, F.col("p_size") / 7.0).alias("point"))


@query("SELECT p_partkey, (v / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE AS r, (v / 255.0::DOUBLE - 0.456::DOUBLE) / 0.224::DOUBLE AS g, (v / 255.0::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE AS b FROM (SELECT p_partkey, p_partkey % 256 AS v FROM part)")
def pixel_normalise(spark, sf):
    v = F.col("p_partkey") % 256
    return table(spark, sf, "part").select("p_partkey", *[d.normalised(v, c).alias(c) for c in "rgb"])


@query("SELECT p_partkey, coalesce(NOT isnan(s) AND s >= 0.15::DOUBLE, false) AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'NaN'::DOUBLE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_size - 20) / 60.0::DOUBLE END AS s FROM part)")
def separation_gate(spark, sf):
    s = F.when(F.col("p_partkey") % 5 == 0, float("nan")).when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise((F.col("p_size") - 20) / 60.0)
    return table(spark, sf, "part").select("p_partkey", teams.separated(s).alias("valid"))


@query("SELECT least(120, count(*)) AS n, least(120, count(*)) AS ids FROM embeddings")
def train_rows(spark, sf):
    """How many rows a team model is fitted on: its sample is the feature."""
    return teams.training_rows(embeddings(spark, sf)).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"))


@query(f"WITH {BOXES_SQL} SELECT frame_idx, det_idx AS corner_idx, CAST(trunc(x1) AS INTEGER) AS x, CAST(trunc(y1) AS INTEGER) AS y, 5 AS radius, 'cls: ' || class_id AS text, CAST(trunc(x1) AS INTEGER) + 8 AS text_x, CAST(trunc(y1) AS INTEGER) - 8 AS text_y, [0, 255, 255] AS colour FROM boxes WHERE conf >= 0.25")
def corner_marks(spark, sf):
    return sinks.corner_marks(_boxes(spark, sf).select("frame_idx", F.col("det_idx").alias("corner_idx"), "class_id", F.col("x1").alias("x"), F.col("y1").alias("y"), "conf"))


_WHOLE = "CAST(trunc({v}) AS INTEGER)"


@query(f"""WITH {BOXES_SQL}, p AS (SELECT frame_idx, det_idx, det_idx % 3 AS team, det_idx - 2 AS track, (x1 + x2) / 2 AS cx, * EXCLUDE (frame_idx, det_idx) FROM boxes),
e AS (SELECT frame_idx, 0 AS z, track AS who, 'ellipse' AS kind, {_WHOLE.format(v='cx')} AS x, {_WHOLE.format(v='y2')} AS y, CASE WHEN team = 1 THEN [0, 0, 255] ELSE [0, 255, 0] END AS colour, NULL AS points, {_WHOLE.format(v='(x2 - x1) * 0.5::DOUBLE')} AS rx, {_WHOLE.format(v='(y2 - y1) * 0.15::DOUBLE')} AS ry, NULL AS text FROM p WHERE class_id = 0
UNION ALL SELECT frame_idx, 1, track, 'label', {_WHOLE.format(v='cx')}, {_WHOLE.format(v='y1 - 5')}, [255, 255, 255], NULL, NULL, NULL, '#' || track FROM p WHERE class_id = 0 AND track >= 0
UNION ALL SELECT frame_idx, 2, 0, 'triangle', {_WHOLE.format(v='cx')}, {_WHOLE.format(v='y1 - 10')}, [0, 0, 255], '(' || {_WHOLE.format(v='cx')} || ' ' || {_WHOLE.format(v='y1 - 20')} || ')(' || {_WHOLE.format(v='cx - 8')} || ' ' || {_WHOLE.format(v='y1 - 5')} || ')(' || {_WHOLE.format(v='cx + 8')} || ' ' || {_WHOLE.format(v='y1 - 5')} || ')', NULL, NULL, NULL FROM p WHERE class_id = 1
UNION ALL SELECT frame_idx, 3, det_idx, 'ellipse', {_WHOLE.format(v='cx')}, {_WHOLE.format(v='y2')}, [255, 0, 0], NULL, {_WHOLE.format(v='(x2 - x1) * 0.5::DOUBLE')}, {_WHOLE.format(v='(y2 - y1) * 0.15::DOUBLE')}, NULL FROM p WHERE class_id = 2)
SELECT frame_idx, z, CAST(who AS BIGINT) AS who, kind, x, y, colour, points, rx, ry, text FROM e""")
def annotate(spark, sf):
    """Whole draw lists: players of two teams and none with tracks, every ball, referees."""
    b = _boxes(spark, sf)
    players = b.filter("class_id = 0").withColumn("track_id", F.col("det_idx") - 2).withColumn("class_id", F.col("det_idx") % 3)
    a = sinks.annotations(players, b.filter("class_id = 1"), b.filter("class_id = 2").withColumn("referee_id", F.col("det_idx")))
    points = F.array_join(F.transform("points", lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))), "")
    return a.withColumn("points", points)


@query(f"WITH {_ON_PITCH} SELECT id, CASE id % 4 WHEN 0 THEN [128, 0, 128] WHEN 1 THEN [0, 0, 255] WHEN 2 THEN [255, 255, 255] ELSE [0, 0, 0] END AS colour FROM on_pitch")
def pitch_colours(spark, sf):
    return pitch.positions(_on_pitch(spark, sf).select("id", (F.col("id") % 4).alias("role"), "x", "y"), coloured=True).select("id", "colour")


@query("""SELECT p_partkey, CASE WHEN ok THEN (sx - 2) || ' 8 ' || (w - 8) || ' ' || (ey + 2) END AS border, CASE WHEN ok THEN 'Tactical View ' || sx || ' 5' END AS caption FROM
(SELECT *, w - 10 > sx AND ey > 10 AS ok FROM (SELECT p_partkey, w, greatest(0, w - 510) AS sx, least(360, h) AS ey FROM (SELECT p_partkey, CAST(p_partkey % 900 AS INTEGER) AS w, CAST(p_size * 20 AS INTEGER) AS h FROM part)))""")
def overlay_border(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 900).cast("int").alias("w"), (F.col("p_size") * 20).cast("int").alias("h"))
    o = p.select("p_partkey", *pitch.overlay_frame(F.col("w"), F.col("h")))
    text = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    return o.select("p_partkey", F.when(F.col("border").isNotNull(), text("border.x1", "border.y1", "border.x2", "border.y2")).alias("border"), F.when(F.col("caption").isNotNull(), text("caption.text", "caption.x", "caption.y")).alias("caption"))


def _analysis(spark, sf):
    """Five clips of 20 frames with four players, two of each team, a ball in each fourth frame and a referee; even clips show six corners of the pitch, odd ones three."""
    o = _moving(spark, sf, 20).filter("det_idx < 4")
    looks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == F.col("det_idx") % 2, 10.0).otherwise(0.0) + 0.01 * F.col("det_idx") + 0.001 * (F.col("frame_idx") % 3))
    players = o.select("clip_id", "frame_idx", "det_idx", F.lit(0).alias("class_id"), "conf", "x1", "y1", "x2", "y2", looks.alias("feature"))
    one = o.filter("det_idx = 0")
    box = lambda x, y, s: [(F.lit(x) - s).alias("x1"), (F.lit(y) - s).alias("y1"), (F.lit(x) + s).alias("x2"), (F.lit(y) + s).alias("y2")]
    none = F.lit(None).cast("array<double>").alias("feature")
    ball = one.filter("frame_idx % 4 = 0").select("clip_id", "frame_idx", F.lit(10).alias("det_idx"), F.lit(1).alias("class_id"), F.lit(0.8).alias("conf"), *box(640.0, 600.0, 6.0), none)
    referee = one.select("clip_id", "frame_idx", F.lit(11).alias("det_idx"), F.lit(2).alias("class_id"), F.lit(0.8).alias("conf"), *box(1000.0, 600.0, 20.0), none)
    detections = players.unionByName(ball).unionByName(referee)
    frames = one.select("clip_id", "frame_idx")
    w = 1.0 + 0.002 * F.col("x") + 0.004 * F.col("y")
    seen = F.broadcast(pitch.pitch_points(spark).filter("class_id IN (0, 1, 4, 8, 10, 3)").filter("x >= -10"))
    idx = F.col("class_id") * 4 + F.col("ref_idx")
    corners = frames.join(seen).select("clip_id", "frame_idx", idx.alias("corner_idx"), "class_id", ((9.0 * F.col("x") + 1.5 * F.col("y") + 640.0) / w).alias("x"), ((0.5 * F.col("x") + 8.0 * F.col("y") + 360.0) / w).alias("y"), (0.9 - 0.005 * idx).alias("conf"))
    few = F.row_number().over(Window.partitionBy("clip_id", "frame_idx").orderBy("corner_idx"))
    corners = corners.withColumn("rn", few).filter("clip_id % 2 = 0 OR rn <= 3").drop("rn")
    used = corners.withColumn("corner_idx", (F.row_number().over(Window.partitionBy("clip_id", "frame_idx").orderBy("corner_idx")) - 1).cast("int"))
    flow = used.select("clip_id", "frame_idx", "corner_idx", "x", "y", F.lit(0.5).alias("error"), F.lit(True).alias("status"))
    return engine.analyze(detections, corners, flow, frames)


@query(f"""WITH {_MOVING.format(n=20)} SELECT DISTINCT clip_id, frame_idx, '{{"frame":' || frame_idx || ',"timestamp":' || printf('%.3f', frame_idx / 25.0::DOUBLE) || ',"tactical":{{"homography_valid":' || CASE WHEN clip_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"num_team1":2,"num_team2":2}}}}' AS line FROM o""")
def analyze_telemetry(spark, sf):
    """The whole dataflow on five clips: every other frame is looked at."""
    return _analysis(spark, sf).telemetry()


@query(f"""WITH {_MOVING.format(n=20)}, c AS (SELECT DISTINCT clip_id, frame_idx FROM o WHERE clip_id % 2 = 0)
SELECT clip_id, frame_idx, role, count(*) AS n FROM (SELECT clip_id, frame_idx, 0 AS role FROM c UNION ALL SELECT clip_id, frame_idx, 0 FROM c UNION ALL SELECT clip_id, frame_idx, 1 FROM c UNION ALL SELECT clip_id, frame_idx, 1 FROM c
UNION ALL SELECT clip_id, frame_idx, 2 FROM c WHERE frame_idx % 4 < 2 UNION ALL SELECT clip_id, frame_idx, 3 FROM c) GROUP BY ALL""")
def analyze_points(spark, sf):
    """Who is on the pitch in each frame: four players, the ball in the frames in which it was seen last, the referee; clips without a homography show none."""
    return _analysis(spark, sf).points.groupBy("clip_id", "frame_idx", "role").agg(F.count("*").alias("n"))
