"""The composed dataflow, its files, and what the queries' tables can't show."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.boxes import cosine_distance, iou
from touchline.operators import detections, sequences, teams, tracker
from touchline.plans import catalogue, composed
from touchline.sources import adapters, sinks

SF = "/root/testdata/sf0.001"


def test_telemetry_is_one_json_document_a_clip(spark, tmp_path):
    a = composed._analysis(spark, SF)
    videos = spark.createDataFrame([(c, f'clip "{c}".mp4', 1280, 720, 20) for c in range(5)], "clip_id long, path string, width int, height int, total_frames int")
    a.write(out := str(tmp_path / "out.json"), videos)
    for c in range(5):
        text = "".join(r.value for f in sorted((tmp_path / "out.json").glob(f"clip_id={c}/*.txt")) for r in spark.read.text(str(f)).collect())
        doc = json.loads(text)
        assert doc["video"] == {"path": f'clip "{c}".mp4', "width": 1280, "height": 720, "fps": 25.0, "total_frames": 20}
        assert [f["frame"] for f in doc["frames"]] == list(range(20)) and {f["tactical"]["homography_valid"] for f in doc["frames"]} == {c % 2 == 0}
        assert all(f["tactical"]["num_team1"] == f["tactical"]["num_team2"] == 2 for f in doc["frames"])
    assert out.endswith(".json")
    # one document a clip, at its own path; and figures on the way
    named = videos.withColumn("output", F.concat(F.lit(f"{tmp_path}/docs/"), "clip_id", F.lit(".json")))
    assert a.write_documents(named) == {"frames": 100}
    docs = [json.loads((tmp_path / "docs" / f"{c}.json").read_text()) for c in range(5)]
    assert [len(x["frames"]) for x in docs] == [20] * 5 and docs[4]["video"]["path"] == 'clip "4".mp4'
    timed = a.timed(a.tactical.filter("frame_idx < 10").select("clip_id", "frame_idx", F.lit(2.0).alias("ms")), track="ms")
    timed.frames.write.format("noop").mode("overwrite").save()
    got = timed.summary()
    assert (got["frames"], got["ran"], got["track_ms"], got["track_per_frame"], got["track_per_run"]) == (100, 50, 100.0, 1.0, 1.0)
    a.write(str(tmp_path / "drawn"), videos)
    drawn = spark.read.parquet(str(tmp_path / "drawn"))
    # each frame: four players with labels, a referee, and the ball: seen in each fourth frame and the one after it, from 0 to 17, and interpolated in between
    assert drawn.groupBy("kind").count().orderBy("kind").collect() == [("ellipse", 5 * 20 * 5), ("label", 5 * 20 * 4), ("triangle", 5 * 18)]


def test_clips_do_not_touch_each_other(spark):
    rows = [(c, 0, k, 0, 0.9 - 0.1 * k, 10.0 * k, 0.0, 10.0 * k + 100, 100.0) for c in (1, 2) for k in range(2)]
    b = spark.createDataFrame(rows, "clip_id long, frame_idx long, det_idx int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.clip_id, r.det_idx) for r in detections.nms(b, 0.5).collect()) == [(1, 0), (2, 0)]
    assert {r.rank for r in detections.top(b).collect()} == {1, 2}
    assert detections.iou_pairs(b).count() == 2
    assert {(r.clip_id, r.players) for r in detections.class_counts(b, b).collect()} == {(1, 2), (2, 2)}


def test_a_track_without_a_feature_costs_its_overlap_alone(spark):
    t = spark.createDataFrame([(0, 0, (0.0, 0.0, 10.0, 10.0), [], 0), (0, 1, (0.0, 0.0, 10.0, 10.0), None, 0), (0, 2, (0.0, 0.0, 10.0, 10.0), [1.0, 0.0], 0)], "frame_idx long, det_idx int, box struct<x1:double,y1:double,x2:double,y2:double>, feature array<double>, missed int")
    d = spark.createDataFrame([(0, 0, (0.0, 0.0, 10.0, 8.0), [1.0, 0.0])], "frame_idx long, det_idx int, box struct<x1:double,y1:double,x2:double,y2:double>, feature array<double>")
    got = {r.track: r.cost for r in detections.match_costs(t, d).collect()}
    assert got == pytest.approx({0: 0.2, 1: 0.2, 2: 0.75 * 0.2})


def test_match_costs_of_odd_rows_in_small_parts_equal_column_expressions(spark, monkeypatch):
    """Frames lie over several batches and parts; nulls and not a number in boxes, features, frames and counts; no array is folded a pair."""
    monkeypatch.setattr(detections, "AT_ONCE", 7)
    r, nan = random.Random(4), float("nan")

    def rows(n):
        boxes = [(x, y, x + r.choice([0.0, 9.0, 10.0]), y + 10.0) for x in (0.0, 2.0, 30.0) for y in (0.0, 1.0)] + [None, (None, 0.0, 5.0, 5.0), (0.0, nan, 10.0, 10.0)]
        features = [[1.0, 0.0], [0.9, 0.1], [0.6, 0.5], [0.0, 0.0], [], None, [1.0], [1.0, None], [nan, 1.0], [1e200, 1e200], [0.5, 0.5, 0.5]]
        return [(r.choice([1, 1, 1, 2, 3, None]), k, r.choice(boxes), r.choice(features), r.choice([0, 1, 2, None])) for k in range(n)]

    schema = "frame_idx long, det_idx int, box struct<x1:double,y1:double,x2:double,y2:double>, feature array<double>, missed int"
    t, d = spark.createDataFrame(rows(80), schema), spark.createDataFrame(rows(60), schema).drop("missed")
    c = F.col
    over, enough, both, app = iou(c("t.box"), c("d.box")), c("over") > 0.35, (F.size("t.feature") > 0) & (F.size("d.feature") > 0), cosine_distance(c("t.feature"), c("d.feature"))
    near = F.when(both, 0.75 * (1.0 - c("over")) + 0.25 * app).otherwise(1.0 - c("over"))
    cost = F.when(enough, near).when((c("t.missed") > 0) & (app <= 0.35), 0.45 + 0.45 * app + 0.10 * (1.0 - c("over")))
    want = t.alias("t").join(d.alias("d"), "frame_idx").withColumn("over", over).select("frame_idx", c("t.det_idx").alias("track"), c("d.det_idx").alias("det"), cost.alias("cost")).filter("cost IS NOT NULL")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        got = detections.match_costs(t, d)
        rows_got = sorted(map(repr, got.collect()))
        assert rows_got == sorted(map(repr, want.collect())) and len(rows_got) > 300
        assert "zip_with" not in got._jdf.queryExecution().toString()
        choices = detections.match_costs(t.withColumn("frame_idx", c("frame_idx") + 1), t.drop("missed")).groupBy("frame_idx", "track").agg(F.count("*").alias("allowed"), F.min("cost").alias("cost"))
        assert sorted(map(repr, detections.next_frame_choices(t).collect())) == sorted(map(repr, choices.collect()))
        assert detections.match_costs(t.limit(0), d).count() == detections.match_costs(t, d.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_tracking_jumps_over_empty_stretches_and_gives_boxes(spark):
    far = 10**12
    rows = [(1, f, 0, 100.0, 100.0, 140.0, 180.0, 0.9) for f in (0, 2, far, far + 2)]
    d = spark.createDataFrame(rows, "clip_id long, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double")
    got = tracker.run(d, stride=2, boxes=True).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.track_id, r.det_idx) for r in got if r.frame_idx > 2][-3:] == [(far, 2, 0), (far + 1, 2, None), (far + 2, 2, 0)]
    assert all((r.x2 - r.x1, r.conf is None) == (pytest.approx(40), r.det_idx is None) for r in got)
    ends = tracker.run(d.filter("frame_idx < 3").withColumn("last", F.lit(3)), stride=2, last="last")
    assert [r.frame_idx for r in ends.orderBy("frame_idx").collect()] == [0, 1, 2, 3]


def test_silhouette_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(teams, "BLOCK", 7)
    r = np.random.default_rng(3)
    x, team = r.normal(size=(60, 3)), r.integers(0, 2, 60)
    p = spark.createDataFrame([(i, int(t), v.tolist()) for i, (v, t) in enumerate(zip(x, team, strict=True))], "vec_id long, team int, e array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for row in teams.silhouette(p).collect():
        own = team == team[row.vec_id]
        a, b = d[row.vec_id][own].sum() / (own.sum() - 1), d[row.vec_id][~own].mean()
        assert row.s == pytest.approx((b - a) / max(a, b), abs=1e-6)


def test_lines_are_numbered_before_each_becomes_two_anchors(spark, tmp_path):
    """Half the rows are dealt out and sorted; lines that the order leaves equal get the places that both orders of theirs would take."""
    line = {"l_orderkey": 4, "l_linenumber": 1, "l_partkey": 1, "l_suppkey": 1, "l_extendedprice": 1.0, "l_tax": 0.0, "l_quantity": 1.0, "l_discount": 0.0}
    lines = [line | {"l_partkey": 0}, line, line | {"l_quantity": 2.0}, line | {"l_orderkey": 5}, line | {"l_orderkey": 9}]
    spark.createDataFrame(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    a = adapters.anchors(spark, str(tmp_path))
    got = sorted((r.frame_idx, r.det_idx, round(r.conf, 2)) for r in a.collect())
    assert got == [(1, k, c) for k, c in enumerate((0.05, 0.03, 0.05, 0.05, 0.03, 0.03, 0.05, 0.03))] + [(2, 0, 0.05), (2, 1, 0.03)]
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")


def test_assign_small_numbers_anchors_once_a_side(spark):
    plan = catalogue.QUERIES["assign_small"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_all_pairs_measures_copy_a_row_to_a_bounded_number_of_blocks(spark):
    """A table twice as long is copied twice, not four times."""
    copies = {n: teams._block_pairs(spark.range(n).withColumnRenamed("id", "vec_id"), F.lit(n)).groupBy("i", "j").count().collect() for n in (20_000, 40_000)}
    for n, groups in copies.items():
        assert len(groups) == teams.BLOCKS * (teams.BLOCKS + 1) // 2 and sum(r["count"] for r in groups) == n * teams.BLOCKS
    # a group is bounded: a long table has more blocks
    assert teams._block_pairs(spark.range(1).withColumnRenamed("id", "vec_id"), F.lit(40 * teams.BLOCK)).count() == 40


@pytest.mark.parametrize("block", [7, 32768])
def test_silhouette_of_copies_repeated_ids_and_broken_rows(spark, monkeypatch, block):
    monkeypatch.setattr(teams, "BLOCK", block)
    r = np.random.default_rng(4)
    x, team, ids = 1000.0 + r.normal(size=(40, 3)), r.integers(0, 2, 40), np.arange(40)
    x[10:20], ids[39], team[38:] = x[10], 38, (0, 1)
    rows = [(int(i), int(t), v.tolist()) for i, t, v in zip(ids, team, x, strict=True)]
    broken = [(None, 0, [0.0] * 3), (90, None, [0.0] * 3), (91, 1, None), (92, 1, [0.0, None, 0.0])]
    got = {row.vec_id: row.s for row in teams.silhouette(spark.createDataFrame([*rows, *broken], "vec_id long, team int, e array<double>")).collect()}
    d, apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), ids[:, None] != ids[None]
    own, other = apart & (team[:, None] == team[None]), apart & (team[:, None] != team[None])
    assert sorted(got) == list(range(39))
    for i, s in got.items():
        at = ids == i
        a, b = (d[at][m[at]].mean() for m in (own, other))
        assert s == pytest.approx((b - a) / max(a, b), abs=1.1e-6)


@pytest.mark.parametrize("block", [5, 32768])
def test_cosine_pairs_of_any_vectors_over_several_blocks(spark, monkeypatch, block):
    """All pairs of a label once, as cosine_distance() gives them to the last bit; no pair of rows is a row of a join."""
    monkeypatch.setattr(teams, "BLOCK", block)
    r = np.random.default_rng(6)
    rows = [(i, i % 3, r.normal(size=4).tolist()) for i in range(60)] + [(100 + i, i % 2, v) for i, v in enumerate([None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, 2.0], [2.0, 4.0], [1e-9] * 4, [float("inf"), 0.0, 0.0, 0.0]])]
    rows += [(3, 0, [1.0, 0.0, 0.0, 1.0]), (None, 0, [1.0] * 4), (200, None, [1.0] * 4), (201, 7, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, e array<double>")
    a, b = (df.select("label", F.col("vec_id").alias(k), F.col("e").alias(f"e_{k}")) for k in "ab")
    want = a.join(b, "label").filter("a < b").select("a", "b", cosine_distance(F.col("e_a"), F.col("e_b")).alias("distance"))
    found = teams.cosine_pairs(df)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert "a#" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert teams.cosine_pairs(df.limit(0)).count() == 0 and teams.silhouette(df.withColumnRenamed("label", "team").limit(0)).count() == 0


def test_cosine_pairs_of_copies_stand_together_and_one_label_goes_to_many_tasks(spark, monkeypatch):
    """A label's pairs of blocks are dealt out, also where its rows lie together by label; of copies, equal distances are neighbours; a vector that many rows have is spread over blocks."""
    monkeypatch.setattr(teams, "LABEL_SHORT", 50)
    r = np.random.default_rng(7)
    rows = [(i + 1000 * k, 1, v) for i, v in enumerate(r.normal(size=(80, 6)).astype(np.float32).astype(float).tolist()) for k in range(6)]
    rows += [(10_000 + i, 1, v) for i, v in enumerate(r.normal(size=(20, 6)).tolist())] + [(20_000 + i, 1, [0.5, 0.1, 0.0, -0.0, 2.0, 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, label int, e array<double>").repartition(4, "label")
    a, b = (df.select("label", F.col("vec_id").alias(k), F.col("e").alias(f"e_{k}")) for k in "ab")
    want = a.join(b, "label").filter("a < b").select("a", "b", cosine_distance(F.col("e_a"), F.col("e_b")).alias("distance"))
    got = [(x.p, (x.a, x.b, repr(x.distance))) for x in teams.cosine_pairs(df).withColumn("p", F.spark_partition_id()).collect()]
    assert sorted(x for _, x in got) == sorted((x.a, x.b, repr(x.distance)) for x in want.collect())
    parts = {p: [x[2] for q, x in got if q == p] for p in {p for p, _ in got}}
    assert len(parts) > 1 and max(map(len, parts.values())) < 0.7 * len(got)
    assert sum(x != y for d in parts.values() for x, y in zip(d, d[1:], strict=False)) < 0.4 * len(got)


def test_short_runs_are_sampled_more_closely(spark):
    counts = spark.createDataFrame([(f, 10) for f in range(200)], "frame_idx long, n long")
    assert [r.frame_idx for r in sequences.training_sample(counts, 20).collect()] == [0, 2, 4, 6, 8, 10]
    assert [r.frame_idx for r in sequences.training_sample(counts, 60).collect()] == [0, 12, 24, 36, 48]
    assert len(sequences.training_sample(counts).collect()) == 12


def test_flow_keeps_corners_where_too_few_are_left(spark):
    corners = spark.createDataFrame([(1, f, i, i, 100.0 * i, 50.0, 0.9) for f in range(3) for i in range(4)], "clip_id long, frame_idx long, corner_idx int, class_id int, x double, y double, conf double")
    flow = spark.createDataFrame([(1, f, i, 100.0 * i + f, 50.0, 1.0 if i < 3 or f == 1 else 21.0, True) for f in (1, 2) for i in range(4)], "clip_id long, frame_idx long, corner_idx int, x double, y double, error double, status boolean")
    got = {f: sorted((r.corner_idx, r.x, round(r.conf, 6)) for r in rows) for f in range(3) if (rows := [r for r in sequences.flow_corners(corners, flow).collect() if r.frame_idx == f])}
    assert got[1] == [(i, 100.0 * i + 1, 0.8955) for i in range(4)] and got[2] == got[1]


def test_numbers_that_json_lacks(spark):
    df = spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,), (1.005,)], "v double")
    assert [r[0] for r in df.select(sinks.json_number(F.col("v"), 1)).collect()] == ["null", "null", "null", "1.0"]
