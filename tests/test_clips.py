"""What is found a clip at a time, against plain versions: team models, sets carried forward, pieces of a clip; and raw tensors in both layouts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline import engine
from touchline.operators import detections, raw, sequences, teams, tracker

BOX = "clip_id long, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double"


def walk(seed, clips=3, frames=(0, 40, 41, 43, 400, 401, 650, 651, 4090, 4097, 4215, 4218, 4219, 20000)):
    """A few objects that move, in stretches of frames with pauses of all lengths between them."""
    r = random.Random(seed)
    rows = []
    for c in range(clips):
        for f in sorted(x + d for x in frames for d in range(r.randint(1, 4)) if r.random() < 0.9):
            for k in range(r.randint(1, 4)):
                x, y = 100.0 + 200 * k + r.randint(-3, 3), 200.0 + r.randint(-3, 3)
                rows.append((c, f, k, x, y, x + 40, y + 80, r.choice([0.2, 0.5, 0.9])))
    return list(dict(((c, f, k), (c, f, k, *v)) for c, f, k, *v in rows).values())


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_tracking_in_pieces_equals_tracking_whole_clips(spark, stride, monkeypatch):
    monkeypatch.setattr(tracker, "BUFFER", 120 // stride)
    monkeypatch.setattr(sequences, "BLOCK", 64)
    df = spark.createDataFrame(walk(stride), BOX).repartition(3)
    last = df.withColumn("last", F.lit(20_300).cast("long"))
    whole = tracker.run(last, stride=stride, boxes=True, last="last", cut=False)
    cut = tracker.run(last, stride=stride, boxes=True, last="last")
    assert cut.columns == whole.columns and sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))
    assert tracker.pieces(df, stride, tracker.BUFFER).select("clip_id", "piece").distinct().count() > 3 * 3


def test_a_long_clip_is_several_groups_and_tracked_once(spark):
    rows = [(1, 500 * k + f, 0, 100.0, 100.0, 140.0, 180.0, 0.9) for k in range(200) for f in range(3)]
    out = tracker.run(spark.createDataFrame(rows, BOX))
    assert sorted((r.frame_idx, r.track_id) for r in out.collect()) == [(500 * k + f, k + 1) for k in range(200) for f in range(3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert tracker.pieces(spark.createDataFrame(rows, BOX)).select("piece").distinct().count() == 200
    assert tracker.run(spark.createDataFrame([], BOX)).count() == 0 and plan


def test_running_max_equals_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 16)
    r = random.Random(3)
    data = [(c, f, r.choice([None, r.randint(0, 99)])) for c in (1, 2) for f in r.sample(range(500), 120)]
    df = spark.createDataFrame(data, "clip_id long, frame_idx long, v long")
    for strict in (False, True):
        got = {(x.clip_id, x.frame_idx): x.top for x in sequences.running_max(df, F.col("v"), "top", strict).collect()}
        for c, f, _ in data:
            assert got[c, f] == max((v for d, g, v in data if d == c and v is not None and (g < f or g == f and not strict)), default=None)


def test_sets_are_carried_from_irregular_looks(spark):
    spine = spark.createDataFrame([(c, f) for c in (1, 2) for f in (0, 1, 2, 5, 6, 7, 9)], "clip_id long, frame_idx long")
    boxes = spark.createDataFrame([(1, 1, 0, 1, 0.5), (1, 1, 1, 1, 0.6), (1, 6, 0, 1, 0.7), (1, 2, 0, 1, 0.9), (2, 5, 3, 2, 0.5)], "clip_id long, frame_idx long, det_idx int, class_id int, conf double")
    looks = spark.createDataFrame([(1, 1), (1, 6), (1, 7), (2, 5)], "clip_id long, frame_idx long")
    got = sorted((r.clip_id, r.frame_idx, r.from_frame, r.det_idx) for r in detections.carry_forward(boxes, spine, looks=looks).collect())
    # clip 1 sees nothing at 7, and shows nothing from then on; frame 2 wasn't looked at
    assert got == [(1, 1, 1, 0), (1, 1, 1, 1), (1, 2, 1, 0), (1, 2, 1, 1), (1, 5, 1, 0), (1, 5, 1, 1), (1, 6, 6, 0), (2, 5, 5, 3), (2, 6, 5, 3), (2, 7, 5, 3), (2, 9, 5, 3)]


def test_pieces_share_a_task(spark):
    """Short pieces are no Python group each: they follow one another in a task, whole ones also where they lie over batches of rows."""
    rows = [(c, 500 * k + f, d, 100.0 + 200 * d, 100.0, 140.0 + 200 * d, 180.0, 0.9) for c in range(2) for k in range(40) for f in range(3) for d in (0, 1)]
    df = spark.createDataFrame(rows, BOX).repartition(5)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        out = tracker.run(df, cut=False)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        got = [sorted((r.clip_id, r.frame_idx, r.det_idx, r.track_id) for r in x.collect()) for x in (out, tracker.run(df))]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got[0] == got[1] == sorted((c, f, d, 2 * (f // 500) + d + 1) for c, f, d, *_ in rows)


def players(spark, seed=1, clips=4):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(clips):
        axis = r.normal(size=16) * 6
        for f in range(0, 240, 12):
            for k in range(10):
                rows.append((c, f, k, (r.normal(size=16) + 100 * c + (k % 2) * axis).tolist()))
    return spark.createDataFrame([*rows, (0, 0, 99, None), (9, 0, 0, [1.0, 2.0]), (8, 24, 0, [1.0] * 16), (8, 24, 1, [1.0] * 16), (8, 24, 2, [1.0] * 16)], "clip_id long, frame_idx long, det_idx int, feature array<double>")


def test_team_models_by_clip_equal_a_model_of_each_clip_alone(spark):
    df = players(spark)
    models = {m.clip_id: m for m in teams.fit_by_clip(df).collect()}
    assert sorted(models) == [0, 1, 2, 3, 8, 9] and all(models[c].rows == 120 and models[c].score > 0.4 for c in range(4))
    assert models[9].mean is None and models[9].score == models[8].score == -1
    got = {(r.clip_id, r.frame_idx, r.det_idx): r.predicted for r in teams.predict_by_clip(df, teams.fit_by_clip(df)).collect()}
    for c in range(4):
        alone = df.filter(F.col("clip_id") == c)
        one = teams.fit_by_clip(alone).collect()[0]
        assert one.centroids == models[c].centroids and one.mean == models[c].mean
        model = teams.TeamModel(mean=np.array(one.mean), axes=np.array(one.axes), centroids=np.array(one.centroids), score=one.score)
        want = model.predict(alone.filter("feature IS NOT NULL").select(F.struct("clip_id", "frame_idx", "det_idx").alias("vec_id"), F.col("feature").alias("e"))).collect()
        assert all(got[tuple(r.vec_id)] == r.team for r in want)
        assert {(k[2] % 2, v) for k, v in got.items() if k[0] == c and k[2] < 99} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
    # a model that isn't valid says 0; rows without a feature aren't judged
    assert [got[8, 24, k] for k in range(3)] == [0, 0, 0] and got[9, 0, 0] == 0 and (0, 0, 99) not in got
    # one model for all clips would tell clips apart, not sides
    single = teams.TeamModel().fit(df.filter("clip_id < 4 AND feature IS NOT NULL").select(F.xxhash64("clip_id", "frame_idx", "det_idx").alias("vec_id"), F.col("feature").alias("e")))
    assert single.valid and teams.fit_by_clip(df.limit(0)).count() == 0


def test_training_rows_are_the_smallest_hashes_of_each_clip(spark):
    df = players(spark).withColumnRenamed("feature", "e")
    got = teams.training_rows(df, 7, by=("clip_id",), ident=("frame_idx", "det_idx"))
    every = df.filter("e IS NOT NULL").withColumn("h", F.xxhash64("clip_id", "frame_idx", "det_idx")).collect()
    for c in {r.clip_id for r in every}:
        want = sorted((r.h, r.frame_idx, r.det_idx) for r in every if r.clip_id == c)[:7]
        assert sorted((r.frame_idx, r.det_idx) for r in got.filter(F.col("clip_id") == c).collect()) == sorted(w[1:] for w in want)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def tensor(detections, features, wide):
    t = np.zeros((features, max(wide, len(detections))))
    for i, d in enumerate(detections):
        t[: len(d), i] = d[:features]
    return (features, t.shape[1], t.ravel().tolist()) if wide else (t.shape[1], features, t.T.ravel().tolist())


def test_raw_output_in_both_layouts(spark):
    objects = [(100, 108, 40, 80, 0.25, 0, 0), (300, 108, 40, 80, 0.2, 0.2, 0.1), (500, 108, 40, 80, 0.24, 0.1, 0.24), (700, 108, 40, 80, 0.3, 0.3, 0.3), (900, 108, 40, 80, 0, 0, 0.3), (100, 110, 40, 80, 0.9, 0, 0), (1270, 4, 60, 30, 0.1, 0.16, 0.1), (5, 5, 0, 10, 0.9, 0, 0)]
    short = [(100, 108, 40, 80, 0.5), (300, 108, 40, 80, 0.1)]
    frames = [tensor(objects, 7, 0), tensor(objects, 7, 128), tensor(short, 5, 0), tensor(short, 5, 101), tensor(short, 3, 0), (2, 7, [1.0] * 13), (0, 7, []), (7, 0, None), (None, 7, [0.0])]
    df = spark.createDataFrame([(1, f, *t) for f, t in enumerate(frames)], "clip_id long, frame_idx long, rows int, cols int, values array<float>")
    got = {}
    for r in raw.boxes(df).collect():
        got.setdefault(r.frame_idx, []).append((r.det_idx, r.class_id, round(r.conf, 4), r.x1, r.y1, r.x2, r.y2))
    # a tie of player and ball below the player's threshold is a ball; the first box is hidden by the sixth; the seventh is cut off by the frame
    want = [(1, 1, 0.2, 280.0, 60.0, 320.0, 140.0), (3, 0, 0.3, 680.0, 60.0, 720.0, 140.0), (4, 2, 0.3, 880.0, 60.0, 920.0, 140.0), (5, 0, 0.9, 80.0, 62.0, 120.0, 142.0), (6, 1, 0.16, 1240.0, 0.0, 1280.0, 11.0)]
    assert sorted(got[0]) == sorted(got[1]) == want
    assert got[2] == got[3] == [(0, 0, 0.5, 80.0, 60.0, 120.0, 140.0)] and set(got) == {0, 1, 2, 3}
    assert raw.boxes(df.limit(0)).count() == 0 and raw.boxes(df.drop("clip_id")).columns[0] == "frame_idx"


def test_raw_corners(spark):
    points = [(100, 108, 0, 0, *[0.1] * 5, 0.8, 0.8), (108, 110, 0, 0, 0.9), (200, 4, 0, 0, 0.9), (1280, 728, 0, 0, *[0.0] * 12, 0.3), (400, 300, 0, 0, 0.24)]
    df = spark.createDataFrame([(f, *tensor(points, 17, w)) for f, w in ((0, 0), (1, 120))] + [(2, *tensor([(50, 58, 0, 0, 0.3, 0.5)], 6, 0))], "frame_idx long, rows int, cols int, values array<double>")
    got = sorted((r.frame_idx, r.det_idx, r.class_id, r.x, r.y) for r in raw.corners(df).collect())
    one = [(0, 5, 100.0, 100.0), (1, 0, 108.0, 102.0), (3, 12, 1280.0, 720.0)]
    assert got == [(f, *x) for f in (0, 1) for x in one] + [(2, 0, 1, 50.0, 50.0)]


def test_players_without_a_label_are_of_the_first_team(spark):
    """A clip whose players have no features has no model: its players stay of class 0, which counts as the first team. At stride 3, referees and balls stay for three frames."""
    frames = spark.createDataFrame([(1, f) for f in range(7)], "clip_id long, frame_idx long")
    rows = [(1, f, 0, 0, 0.9, 100.0, 100.0, 140.0, 180.0) for f in range(7)] + [(1, f, k, c, 0.8, 300.0 + 100 * k, 300.0, 310.0 + 100 * k, 310.0) for f in (0, 6) for k, c in ((1, 1), (2, 1), (3, 2))]
    found = spark.createDataFrame(rows, "clip_id long, frame_idx long, det_idx int, class_id int, conf double, x1 double, y1 double, x2 double, y2 double").withColumn("feature", F.lit(None).cast("array<double>"))
    none = spark.createDataFrame([], "clip_id long, frame_idx long, corner_idx int, class_id int, x double, y double, conf double")
    flow = spark.createDataFrame([], "clip_id long, frame_idx long, corner_idx int, x double, y double, error double, status boolean")
    a = engine.analyze(found, none, flow, frames, stride=3)
    got = [(r.frame_idx, r.num_team1, r.num_team2, r.num_balls, r.num_referees) for r in a.tactical.orderBy("frame_idx").collect()]
    assert got == [(f, 1, 0, *((2, 1) if f in (0, 1, 2, 6) else (0, 0))) for f in range(7)]
    # the best ball's path goes on between what was seen
    assert sorted(r.frame_idx for r in a.ball_path.collect()) == list(range(7))
