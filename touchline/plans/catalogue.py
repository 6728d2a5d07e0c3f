"""All queries by name, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.boxes import PAD, grid
from ..operators import detections as d
from ..operators import pitch, sequences, teams, tracker
from ..sources import sinks
from ..sources.adapters import ANCHORS_SQL, BOXES_SQL, EMBEDDINGS_SQL, OBSERVATIONS_SQL, anchors, embeddings, observations, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return d.decode(anchors(spark, sf))


_BOX = "frame_idx, det_idx, class_id, conf, x1, y1, x2, y2"
_IOU = """CASE WHEN (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) > 0
  THEN greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))
  / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) ELSE 0.0::DOUBLE END"""
_NMS = f"""{BOXES_SQL}, packed AS (SELECT frame_idx, class_id, list({{'conf': conf, 'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY conf DESC, det_idx) AS a FROM boxes GROUP BY ALL),
kept AS (SELECT frame_idx, class_id, unnest(list_reduce(list_transform(a, lambda q: [q]), lambda acc, xs: CASE WHEN len(list_filter(acc, lambda k: {_IOU.format(a="k", b="xs[1]")} > 0.7::DOUBLE)) > 0 THEN acc ELSE list_concat(acc, xs) END)) AS k FROM packed),
nms AS (SELECT frame_idx, k.det_idx AS det_idx, class_id, k.conf AS conf, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM kept)"""


@query(f"WITH {BOXES_SQL} SELECT {_BOX} FROM boxes")
def decode_boxes(spark, sf):
    return _boxes(spark, sf)


@query(f"""WITH {ANCHORS_SQL}, s AS (SELECT frame_idx, det_idx, [conf, conf * 0.9::DOUBLE + 0.02::DOUBLE, 0.6::DOUBLE - conf] AS s FROM anchors),
c AS (SELECT frame_idx, det_idx, CASE WHEN s[1] >= s[2] AND s[1] >= s[3] AND s[1] >= 0.25 THEN 0 WHEN s[2] >= s[1] AND s[2] >= s[3] AND s[2] >= 0.15 THEN 1 WHEN s[3] >= s[1] AND s[3] >= s[2] AND s[3] >= 0.25 THEN 2 END AS class_id FROM s)
SELECT frame_idx, det_idx, class_id FROM c WHERE class_id IS NOT NULL""")
def classify_scores(spark, sf):
    c = F.col("conf")
    return anchors(spark, sf).select("frame_idx", "det_idx", d.classify(F.array(c, c * 0.9 + 0.02, 0.6 - c)).alias("class_id")).filter("class_id IS NOT NULL")


@query(f"WITH {_NMS} SELECT {_BOX} FROM nms")
def nms_kept(spark, sf):
    return d.nms(_boxes(spark, sf))


@query(f"WITH {_NMS} SELECT frame_idx, class_id, count(*) AS n FROM nms GROUP BY ALL")
def nms_counts(spark, sf):
    return d.nms(_boxes(spark, sf)).groupBy("frame_idx", "class_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_NMS}, spine AS (SELECT DISTINCT frame_idx FROM anchors)
SELECT s.frame_idx, CAST(count(*) FILTER (class_id = 0) AS BIGINT) AS players, CAST(count(*) FILTER (class_id = 1) AS BIGINT) AS balls, CAST(count(*) FILTER (class_id = 2) AS BIGINT) AS referees
FROM spine s LEFT JOIN nms n ON s.frame_idx = n.frame_idx GROUP BY 1""")
def frame_class_counts(spark, sf):
    return d.kept_counts(anchors(spark, sf))


#: Overlaps of pairs p (boxes a and b, keys), each part of them computed once.
_OVERLAPS = """w AS (SELECT *, greatest(0.0::DOUBLE, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0::DOUBLE, least(ay2, by2) - greatest(ay1, by1)) AS inter, (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) AS both_areas FROM p),
o AS (SELECT *, CASE WHEN both_areas - inter > 0 THEN inter / (both_areas - inter) ELSE 0.0::DOUBLE END AS over FROM w)"""
_PAIR = ", ".join(f"{t}.{c} AS {t}{c}" for t in "ab" for c in ("x1", "y1", "x2", "y2"))


@query(f"""WITH {BOXES_SQL}, p AS (SELECT a.frame_idx, a.class_id, a.det_idx AS a_idx, b.det_idx AS b_idx, {_PAIR} FROM boxes a JOIN boxes b ON a.frame_idx = b.frame_idx AND a.class_id = b.class_id AND a.det_idx < b.det_idx), {_OVERLAPS}
SELECT frame_idx, class_id, a_idx, count(*) AS pairs, max(over) AS iou FROM o WHERE over > 0 GROUP BY ALL""")
def iou_pairs(spark, sf):
    """How many later boxes of its frame and class each box overlaps, and by how much at most."""
    return d.iou_pairs(_boxes(spark, sf)).groupBy("frame_idx", "class_id", "a_idx").agg(F.count("*").alias("pairs"), F.max("iou").alias("iou"))


@query(f"""WITH {ANCHORS_SQL}, packed AS (SELECT frame_idx, class_id, list({{'conf': conf, 'det_idx': det_idx, 'x': cx, 'y': cy}} ORDER BY conf DESC, det_idx) AS a FROM anchors WHERE conf >= 0.25 GROUP BY ALL),
kept AS (SELECT frame_idx, class_id, unnest(list_reduce(list_transform(a, lambda q: [q]), lambda acc, xs: CASE WHEN len(list_filter(acc, lambda k: (k.x - xs[1].x) * (k.x - xs[1].x) + (k.y - xs[1].y) * (k.y - xs[1].y) < 225)) > 0 THEN acc ELSE list_concat(acc, xs) END)) AS k FROM packed)
SELECT frame_idx, k.det_idx AS det_idx, class_id, k.conf AS conf, k.x AS x, k.y AS y FROM kept""")
def corner_nms(spark, sf):
    return d.radius_nms(anchors(spark, sf).filter("conf >= 0.25").select("frame_idx", "det_idx", "class_id", "conf", F.col("cx").alias("x"), F.col("cy").alias("y")))


@query(f"""WITH {ANCHORS_SQL}, s AS (SELECT frame_idx, det_idx, cx, cy - 8 AS y, list_transform(range(0, 13), lambda i: CAST((det_idx * 7 + i * 5 + frame_idx) % 13 AS DOUBLE) / 13) AS s FROM anchors)
SELECT frame_idx, det_idx, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS class_id, list_max(s) AS conf FROM s WHERE list_max(s) >= 0.25 AND cx BETWEEN 0 AND 1280 AND y BETWEEN 0 AND 720""")
def corner_decode(spark, sf):
    s = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: ((F.col("det_idx") * 7 + i * 5 + F.col("frame_idx")) % 13).cast("double") / 13)
    a = anchors(spark, sf).withColumn("s", s).withColumn("conf", F.array_max("s")).withColumn("y", F.col("cy") - PAD)
    return a.filter("conf >= 0.25 AND cx BETWEEN 0 AND 1280 AND y BETWEEN 0 AND 720").select("frame_idx", "det_idx", (F.array_position("s", F.col("conf")) - 1).cast("int").alias("class_id"), "conf")


@query(f"WITH {BOXES_SQL}, t AS (SELECT *, coalesce(max(CASE WHEN class_id = 0 THEN y2 - y1 END) OVER (PARTITION BY frame_idx), 0) AS tall FROM boxes) SELECT {_BOX} FROM t WHERE class_id = 1 AND (tall <= 220 OR conf >= 0.35::DOUBLE)")
def closeup_ball_filter(spark, sf):
    return d.closeup_filter(_boxes(spark, sf))


@query(f"WITH {BOXES_SQL}, r AS (SELECT frame_idx, det_idx, CAST(row_number() OVER (PARTITION BY frame_idx ORDER BY conf DESC, det_idx) AS INTEGER) AS rank FROM boxes) SELECT * FROM r WHERE rank <= 40")
def top40(spark, sf):
    return d.top(_boxes(spark, sf)).select("frame_idx", "det_idx", "rank")


@query(f"WITH {ANCHORS_SQL} SELECT frame_idx, det_idx, CASE WHEN conf * 0.5::DOUBLE >= 0.25::DOUBLE THEN 'high' ELSE 'low' END AS part FROM anchors WHERE conf * 0.5::DOUBLE >= 0.10::DOUBLE")
def conf_split(spark, sf):
    return anchors(spark, sf).select("frame_idx", "det_idx", d.confidence_split(F.col("conf") * 0.5).alias("part")).filter("part IS NOT NULL")


@query(f"WITH {BOXES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY conf DESC, det_idx) AS rn FROM boxes WHERE class_id = 1) SELECT {_BOX} FROM r WHERE rn = 1")
def best_ball(spark, sf):
    return d.best_ball(_boxes(spark, sf))


@query(f"WITH {BOXES_SQL} SELECT frame_idx, det_idx, CAST(row_number() OVER (PARTITION BY frame_idx ORDER BY conf DESC, det_idx) - 1 AS INTEGER) AS referee_id FROM boxes WHERE class_id = 2")
def referee_ordinals(spark, sf):
    return d.referee_ordinals(_boxes(spark, sf))


@query(f"""WITH {_NMS}, r AS (SELECT t.frame_idx, t.det_idx AS track, b.det_idx AS raw, {_IOU.format(a='t', b='b')} AS iou,
  row_number() OVER (PARTITION BY t.frame_idx, t.det_idx ORDER BY {_IOU.format(a='t', b='b')} DESC, b.det_idx) AS rn FROM nms t JOIN boxes b ON t.frame_idx + 1 = b.frame_idx)
SELECT frame_idx, track, raw, iou FROM r WHERE rn = 1""")
def best_overlap(spark, sf):
    """Kept boxes of each frame against all boxes of the next."""
    b = _boxes(spark, sf)
    return d.best_overlap(d.nms(b), b.withColumn("frame_idx", F.col("frame_idx") - 1))


@query(f"WITH {BOXES_SQL}, f AS (SELECT DISTINCT frame_idx FROM anchors) SELECT f.frame_idx, b.frame_idx AS from_frame, det_idx, class_id, conf FROM f JOIN boxes b ON b.frame_idx = f.frame_idx - f.frame_idx % 2 AND class_id <> 0")
def stride_carry(spark, sf):
    a = anchors(spark, sf)
    return d.carry_forward(d.decode(a).filter("class_id <> 0"), a)


@query(f"WITH {BOXES_SQL}, c AS (SELECT frame_idx, det_idx, CAST(trunc(x1) AS INTEGER) AS x1, CAST(trunc(y1) AS INTEGER) AS y1, CAST(trunc(x2) AS INTEGER) AS x2, CAST(trunc(y2) AS INTEGER) AS y2 FROM boxes WHERE class_id = 0) SELECT * FROM c WHERE x2 > x1 AND y2 > y1")
def crop_rects(spark, sf):
    return d.crop_rects(_boxes(spark, sf))


@query(f"""WITH {BOXES_SQL}, n AS (SELECT frame_idx, count(*) AS n FROM boxes WHERE class_id = 0 AND frame_idx % 12 = 0 AND frame_idx < 2880 GROUP BY 1), p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM n)
SELECT frame_idx, n FROM p WHERE prior < 120""")
def train_sample(spark, sf):
    return sequences.training_sample(_boxes(spark, sf).filter("class_id = 0 AND frame_idx < 2880").groupBy("frame_idx").agg(F.count("*").alias("n")))


@query(f"""WITH {OBSERVATIONS_SQL}, g AS (SELECT clip_id, frame_idx AS f1, x AS x0, y AS y0, lead(frame_idx) OVER w AS f2, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(frame_idx) OVER w AS f0, lag(x) OVER w AS px, lag(y) OVER w AS py FROM obs WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
h AS (SELECT *, CAST(f2 - f1 AS DOUBLE) AS gap, CAST(f1 - f0 AS DOUBLE) AS before FROM g WHERE f2 - f1 BETWEEN 2 AND 30),
v AS (SELECT *, CASE WHEN before <= 30 THEN (x0 - px) / before ELSE (nx - x0) / gap END AS vx, CASE WHEN before <= 30 THEN (y0 - py) / before ELSE (ny - y0) / gap END AS vy FROM h),
a AS (SELECT *, 2.0::DOUBLE * (nx - x0 - vx * gap) / (gap * gap) AS ax, 2.0::DOUBLE * (ny - y0 - vy * gap) / (gap * gap) AS ay, unnest(range(f1 + 1, f2)) AS f FROM v)
SELECT clip_id, CAST(f AS BIGINT) AS frame_idx, x0 + vx * CAST(f - f1 AS DOUBLE) + 0.5::DOUBLE * ax * CAST(f - f1 AS DOUBLE) * CAST(f - f1 AS DOUBLE) AS x, y0 + vy * CAST(f - f1 AS DOUBLE) + 0.5::DOUBLE * ay * CAST(f - f1 AS DOUBLE) * CAST(f - f1 AS DOUBLE) AS y, 0.35::DOUBLE AS conf FROM a""")
def ball_interpolate(spark, sf):
    return sequences.interpolate(observations(spark, sf))


def _votes(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), (F.floor(F.col("value")) % 2).cast("int").alias("vote"))


_VOTES = "votes AS (SELECT user_id AS track_id, event_id AS seq, CAST(CAST(floor(value) AS BIGINT) % 2 AS INTEGER) AS vote FROM events)"


@query(f"WITH {_VOTES} SELECT track_id, seq, CASE WHEN sum(CAST(vote = 0 AS INTEGER)) OVER w >= sum(CAST(vote = 1 AS INTEGER)) OVER w THEN 0 ELSE 1 END AS label FROM votes WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)")
def vote_majority(spark, sf):
    return sequences.majority(_votes(spark, sf))


@query(f"WITH {_VOTES} SELECT track_id, seq, sum(CASE WHEN vote = 1 THEN 1 ELSE -1 END) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS is_referee FROM votes")
def role_vote(spark, sf):
    return sequences.role(_votes(spark, sf))


@query("WITH e AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, floor(list_reduce(v, lambda a, x: 0.9::DOUBLE * a + (1 - 0.9::DOUBLE) * x) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS ema FROM e")
def ema_scalar(spark, sf):
    return sequences.ema(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").withColumn("ema", grid(F.col("ema")))


@query("WITH e AS (SELECT user_id, list(event_id ORDER BY event_id) AS v FROM events GROUP BY 1), s AS (SELECT user_id, list_reduce(list_prepend({'last': NULL::BIGINT, 'n': 0::BIGINT}, list_transform(v, lambda x: {'last': x, 'n': 0::BIGINT})), lambda a, x: CASE WHEN a.last IS NULL OR x.last - a.last >= 60 THEN {'last': x.last, 'n': a.n + 1} ELSE a END) AS s FROM e) SELECT user_id, s.last AS last, s.n AS n FROM s")
def revalidate_cadence(spark, sf):
    return sequences.cadence(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""WITH i AS (SELECT user_id, event_id, sum(CAST(value >= 60 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM events)
SELECT user_id, event_id, CASE WHEN island > 0 THEN row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1 END <= 10 AS usable FROM i""")
def stale_reuse(spark, sf):
    return sequences.stale_reuse(table(spark, sf, "events").select("user_id", "event_id", (F.col("value") >= 60).alias("ok")), "user_id", "event_id", "ok")


def _filtered(value: str, conf: str) -> str:
    return f"""WITH RECURSIVE {OBSERVATIONS_SQL}, o AS (SELECT clip_id, {value} AS x, 10.0::DOUBLE * (1.0::DOUBLE - {conf}) + 1.0::DOUBLE AS r, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS k FROM obs),
f AS (SELECT clip_id, k, x AS p, 0.0::DOUBLE AS v, 10.0::DOUBLE AS a, 0.0::DOUBLE AS b, 10.0::DOUBLE AS c FROM o WHERE k = 1
  UNION ALL SELECT clip_id, k, p + v + (a1 / (a1 + r)) * (x - (p + v)), v + (b1 / (a1 + r)) * (x - (p + v)), (1.0::DOUBLE - a1 / (a1 + r)) * a1, (1.0::DOUBLE - a1 / (a1 + r)) * b1, c1 - (b1 / (a1 + r)) * b1
  FROM (SELECT f.clip_id, o.k, o.x, f.p, f.v, f.a + 2.0::DOUBLE * f.b + f.c + 1.0::DOUBLE AS a1, f.b + f.c AS b1, f.c + 0.25::DOUBLE AS c1, o.r FROM f JOIN o ON o.clip_id = f.clip_id AND o.k = f.k + 1))
SELECT clip_id, {", ".join(f"floor({c} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS {c}" for c in "pv")} FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY k DESC) AS rn FROM f) WHERE rn = 1"""


@query(_filtered("x", "0.9::DOUBLE"))
def kalman_axis(spark, sf):
    return sequences.kalman_axis(observations(spark, sf)).select("clip_id", grid(F.col("p")).alias("p"), grid(F.col("v")).alias("v"))


@query(_filtered("y", "greatest(0.05::DOUBLE, least(1.0::DOUBLE, (event_id % 13) / 10.0::DOUBLE))"))
def kalman_conf(spark, sf):
    """The other axis, at confidences from 0 to 1.2, which count as 0.05 to 1."""
    o = observations(spark, sf).withColumn("conf", (F.col("event_id") % 13) / 10.0)
    return sequences.kalman_axis(o, "y", "conf").select("clip_id", grid(F.col("p")).alias("p"), grid(F.col("v")).alias("v"))


_DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])), lambda s, x: s + x)"
_D2 = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))), lambda s, x: s + x)"
_MEAN, _COMPONENTS = [0.01] * 64, [[0.125 if (i >> k) % 2 == 0 else -0.125 for i in range(64)] for k in range(3)]
_CENTROIDS = [[0.1 if i % 2 == k else -0.1 for i in range(64)] for k in range(2)]


def _list(v: list[float]) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"


@query(f"WITH {EMBEDDINGS_SQL} SELECT vec_id, list_transform(e, lambda x: x / sqrt({_DOT.format(a='e', b='e')})) AS e FROM emb".replace("SELECT vec_id, list_transform(e, lambda x: x / sqrt", "SELECT vec_id, list_transform(e, lambda y: y / sqrt"))
def l2_normalize(spark, sf):
    return teams.normalise(embeddings(spark, sf))


@query(f"WITH {EMBEDDINGS_SQL} SELECT p.vec_id AS a, q.vec_id AS b, 1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_DOT.format(a='p.e', b='q.e')} / (sqrt({_DOT.format(a='p.e', b='p.e')}) * sqrt({_DOT.format(a='q.e', b='q.e')})))) AS distance FROM emb p JOIN emb q ON p.label = q.label AND p.vec_id < q.vec_id")
def cosine_pairs(spark, sf):
    return teams.cosine_pairs(embeddings(spark, sf))


@query(f"WITH {EMBEDDINGS_SQL}, c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: e[i] - {_list(_MEAN)}[i]) AS c FROM emb) SELECT vec_id, {', '.join(_DOT.format(a='c', b=_list(v)) + f' AS p{k}' for k, v in enumerate(_COMPONENTS))} FROM c")
def pca_project(spark, sf):
    return teams.project(embeddings(spark, sf), _MEAN, _COMPONENTS)


_ASSIGNED = f"{EMBEDDINGS_SQL}, dd AS (SELECT vec_id, e, {_D2.format(a='e', b=_list(_CENTROIDS[0]))} AS d0, {_D2.format(a='e', b=_list(_CENTROIDS[1]))} AS d1 FROM emb), assigned AS (SELECT vec_id, e, CASE WHEN d0 <= d1 THEN 0 ELSE 1 END AS team, least(d0, d1) AS d2 FROM dd)"
_GRID = "floor({v} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


@query(f"WITH {_ASSIGNED} SELECT vec_id, team, d2 FROM assigned")
def kmeans_assign(spark, sf):
    return teams.assign(embeddings(spark, sf), _CENTROIDS).select("vec_id", "team", "d2")


@query(f"WITH {_ASSIGNED}, ids AS (SELECT CAST(t AS INTEGER) AS team, CAST(k AS INTEGER) AS dim FROM range(0, 3) a(t), range(0, 64) b(k)), m AS (SELECT team, CAST(k - 1 AS INTEGER) AS dim, avg(e[k]) AS m FROM assigned, range(1, 65) r(k) GROUP BY ALL) SELECT team, dim, {_GRID.format(v='coalesce(m, 0.0::DOUBLE)')} AS mean FROM ids LEFT JOIN m USING (team, dim)")
def lloyd_step(spark, sf):
    return teams.centroid_step(teams.assign(embeddings(spark, sf), _CENTROIDS), 3, 64)


@query(f"WITH {_ASSIGNED} SELECT team, {_GRID.format(v='sum(d2)')} AS inertia FROM assigned GROUP BY 1")
def inertia(spark, sf):
    return teams.assign(embeddings(spark, sf), _CENTROIDS).groupBy("team").agg(grid(F.sum("d2")).alias("inertia"))


@query(f"""WITH {_ASSIGNED}, p AS (SELECT vec_id, team, e FROM assigned),
m AS (SELECT a.vec_id, avg(CASE WHEN a.team = b.team THEN sqrt({_D2.format(a='a.e', b='b.e')}) END) AS a, avg(CASE WHEN a.team <> b.team THEN sqrt({_D2.format(a='a.e', b='b.e')}) END) AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY 1)
SELECT vec_id, {_GRID.format(v='((b - a) / greatest(a, b))')} AS s FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 0""")
def silhouette(spark, sf):
    return teams.silhouette(teams.assign(embeddings(spark, sf), _CENTROIDS))


_H = [0.09, 0.01, -58.0, 0.002, 0.11, -42.0, 0.0001, 0.0003, 1.0]


def _points(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).cast("int").alias("class_id"), ((F.col("s_suppkey") * 37) % 1280).cast("double").alias("x"), ((F.col("s_suppkey") * 53) % 720).cast("double").alias("y"))


_POINTS = "pts AS (SELECT s_suppkey AS id, CAST(s_suppkey % 3 AS INTEGER) AS class_id, CAST((s_suppkey * 37) % 1280 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 720 AS DOUBLE) AS y FROM supplier)"
_H_SQL = [f"{v!r}::DOUBLE" for v in _H]
_W = f"({_H_SQL[6]} * x + {_H_SQL[7]} * y + {_H_SQL[8]})"
_ON_PITCH = f"{_POINTS}, on_pitch AS (SELECT id, class_id, ({_H_SQL[0]} * x + {_H_SQL[1]} * y + {_H_SQL[2]}) / {_W} AS x, ({_H_SQL[3]} * x + {_H_SQL[4]} * y + {_H_SQL[5]}) / {_W} AS y FROM pts)"


def _on_pitch(spark, sf):
    x, y = pitch.transform(_H, F.col("x"), F.col("y"))
    return _points(spark, sf).select("id", "class_id", x.alias("x"), y.alias("y"))


@query(f"WITH {_ON_PITCH} SELECT * FROM on_pitch")
def to_pitch(spark, sf):
    return _on_pitch(spark, sf)


_REFS = ", ".join(f"({c}, {i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for c, ps in pitch.PITCH.items() for i, (x, y) in enumerate(ps))


@query(f"WITH {_ON_PITCH}, r(class_id, ref_idx, rx, ry) AS (VALUES {_REFS}), n AS (SELECT id, ref_idx, (x - rx) * (x - rx) + (y - ry) * (y - ry) AS d2 FROM on_pitch JOIN r USING (class_id)) SELECT id, ref_idx, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, ref_idx) AS rn FROM n) WHERE rn = 1")
def nearest_ref(spark, sf):
    return pitch.nearest(_on_pitch(spark, sf), pitch.pitch_points(spark))


@query(f"WITH {_ON_PITCH} SELECT id, CAST(trunc((x + 52.5::DOUBLE) * 1050 / 105.0::DOUBLE) AS INTEGER) AS px, CAST(trunc((y + 34.0::DOUBLE) * 680 / 68.0::DOUBLE) AS INTEGER) AS py FROM on_pitch")
def pitch_pixels(spark, sf):
    px, py = pitch.pixels(F.col("x"), F.col("y"))
    return _on_pitch(spark, sf).select("id", px.alias("px"), py.alias("py"))


@query(f"""WITH {BOXES_SQL} SELECT frame_idx, det_idx, CASE WHEN class_id = 1 THEN 'triangle' ELSE 'ellipse' END AS kind, CAST(trunc((x1 + x2) / 2) AS INTEGER) AS x, CAST(trunc(CASE WHEN class_id = 1 THEN y1 - 10 ELSE y2 END) AS INTEGER) AS y,
CASE WHEN class_id = 1 THEN 8 ELSE CAST(trunc(0.5::DOUBLE * (x2 - x1)) AS INTEGER) END AS rx, CASE WHEN class_id = 1 THEN 5 ELSE CAST(trunc(0.15::DOUBLE * (y2 - y1)) AS INTEGER) END AS ry, CASE class_id WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS z FROM boxes""")
def draw_list(spark, sf):
    return sinks.draw_list(_boxes(spark, sf))


@query(f"""WITH {BOXES_SQL}, c AS (SELECT s.frame_idx, count(*) FILTER (class_id = 0) AS p, count(*) FILTER (class_id = 1) AS b, count(*) FILTER (class_id = 2) AS r FROM (SELECT DISTINCT frame_idx FROM anchors) s LEFT JOIN boxes x ON s.frame_idx = x.frame_idx GROUP BY 1)
SELECT frame_idx, '{{"frame":' || frame_idx || ',"timestamp":' || printf('%.3f', frame_idx / 25.0::DOUBLE) || ',"players":' || p || ',"balls":' || b || ',"referees":' || r || '}}' AS line FROM c""")
def telemetry_json(spark, sf):
    a = anchors(spark, sf)
    return sinks.telemetry(d.class_counts(a, d.decode(a)))


@query(r"""SELECT page_id, regexp_extract(url, '^(.*/)?([^/]*)$', 1) || CASE WHEN regexp_extract(n, '^.+(\.[^.]*)$', 1) = '' THEN n ELSE substr(n, 1, length(n) - length(regexp_extract(n, '^.+(\.[^.]*)$', 1))) END || '_out' ||
CASE WHEN regexp_extract(n, '^.+(\.[^.]*)$', 1) = '' THEN '.mp4' ELSE regexp_extract(n, '^.+(\.[^.]*)$', 1) END AS path FROM (SELECT page_id, url, regexp_extract(url, '^(.*/)?([^/]*)$', 2) AS n FROM pages)""")
def output_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", sinks.output_path(F.col("url"), "_out").alias("path"))


@query("SELECT event_type, count(*) AS frames, count(*) FILTER (event_id % 2 = 0) AS ran, floor(coalesce(sum(value) / count(*), 0) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS mean_ms, floor(coalesce(sum(CASE WHEN event_id % 2 = 0 THEN value END) / nullif(count(*) FILTER (event_id % 2 = 0), 0), 0) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS mean_ran_ms FROM events GROUP BY 1")
def timing_summary(spark, sf):
    ran = F.col("event_id") % 2 == 0
    n, k = F.count("*"), F.count_if(ran)
    return table(spark, sf, "events").groupBy("event_type").agg(n.alias("frames"), k.alias("ran"), grid(F.coalesce(F.sum("value") / n, F.lit(0.0)), 1e4).alias("mean_ms"), grid(F.coalesce(F.sum(F.when(ran, F.col("value"))) / F.nullif(k, F.lit(0)), F.lit(0.0)), 1e4).alias("mean_ran_ms"))


def _moving(spark, sf, frames: int = 20, gone: tuple[int, int] | None = None):
    """25 nations on a wide grid, region by region, at constant speed; number 0 is away in some frames."""
    n = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    o = table(spark, sf, "nation").withColumn("k", F.row_number().over(n) - 1).withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))))
    if gone:
        o = o.filter(~((F.col("k") == 0) & F.col("frame_idx").between(*gone)))
    x, y = 100.0 + F.col("k") * 200.0 + F.col("frame_idx") * 2.0, 200.0 + F.col("k") * 50.0
    return o.select(F.col("n_regionkey").cast("long").alias("clip_id"), "frame_idx", F.col("k").cast("int").alias("det_idx"), (x - 20).alias("x1"), (y - 40).alias("y1"), (x + 20).alias("x2"), (y + 40).alias("y2"), (0.9 - F.col("k") * 0.05).alias("conf"))


_MOVING = "k AS (SELECT CAST(n_regionkey AS BIGINT) AS clip_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS k FROM nation), o AS (SELECT clip_id, k, CAST(f AS BIGINT) AS frame_idx FROM k, range(0, {n}) t(f))"


@query(f"WITH {_MOVING.format(n=20)} SELECT clip_id, frame_idx, k + 1 AS track_id, k AS det_idx FROM o")
def track_linear(spark, sf):
    return tracker.run(_moving(spark, sf))


@query(f"WITH {_MOVING.format(n=30)} SELECT clip_id, frame_idx, k + 1 AS track_id, k AS det_idx FROM o WHERE NOT (k = 0 AND frame_idx BETWEEN 8 AND 12)")
def track_occlusion(spark, sf):
    """The object that was away five frames is found again by its predicted place."""
    return tracker.run(_moving(spark, sf, 30, (8, 12)))


@query(f"WITH {_MOVING.format(n=150)}, s AS (SELECT clip_id, max(k) + 2 AS fresh FROM o GROUP BY 1) SELECT clip_id, frame_idx, CAST(CASE WHEN k = 0 AND frame_idx > 130 THEN fresh ELSE k + 1 END AS INTEGER) AS track_id, k AS det_idx FROM o JOIN s USING (clip_id) WHERE NOT (k = 0 AND frame_idx BETWEEN 10 AND 130)")
def track_expiry(spark, sf):
    """After 120 misses a track is gone: the object gets a new id."""
    return tracker.run(_moving(spark, sf, 150, (10, 130)))


@query(f"WITH {_MOVING.format(n=30)} SELECT clip_id, frame_idx, k + 1 AS track_id, k AS det_idx FROM o WHERE NOT (k = 0 AND frame_idx BETWEEN 8 AND 12)")
def track_reid(spark, sf):
    """The object that was away five frames comes back beside its predicted place (less overlap than a match takes), and is found again by its looks."""
    o = _moving(spark, sf, 30, (8, 12))
    moved = F.when((F.col("det_idx") == 0) & (F.col("frame_idx") > 12), 60.0).otherwise(0.0)
    looks = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: (i == F.col("det_idx")).cast("double"))
    return tracker.run(o.withColumns({"y1": F.col("y1") + moved, "y2": F.col("y2") + moved, "feature": looks}), feature="feature")


@query(f"WITH {_MOVING.format(n=20)} SELECT clip_id, frame_idx, k + 1 AS track_id, CASE WHEN frame_idx % 3 = 0 THEN k END AS det_idx FROM o")
def track_stride(spark, sf):
    """Each third frame is looked at; tracks are predicted in the others."""
    return tracker.run(_moving(spark, sf), stride=3)
