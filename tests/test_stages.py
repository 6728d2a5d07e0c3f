"""Streamed stages give what their batch forms give: with rows that come late, frames that come twice, a restart from the checkpoint, and keys that end."""

import random
import time

import pytest
from pyspark.sql import functions as F

from touchline.operators import homography, sequences
from touchline.streaming import stages

PARTS = [(0, 9), (9, 10), (10, 24)]


class Stream:
    """A folder of files, each a batch; the query can be stopped, and started again from its checkpoint."""

    def __init__(self, spark, folder, schema, make, name):
        stages.store(spark)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        self.spark, self.folder, self.schema, self.make, self.name, self.n, self.rows = spark, folder, schema, make, name, 0, []

    def start(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        out = self.rows
        self.query = self.make(source).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{self.folder}/state").start()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        if not self.n:
            self.start()
        self.n += 1
        self.query.processAllAvailable()

    def restart(self):
        self.query.stop()
        self.start()


def late(rows, seed):
    """Rows by frame, some of them up to two places late, and a few twice."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda x: (x[1] + r.choice([0, 0, 0, 1, 2]), r.random()))
    return [*rows, *r.sample(rows, 2)]


def run(spark, folder, schema, make, rows, name, slack=3):
    """All rows in three batches, out of order, with a restart; then a far frame of each key that brings out what waits. What comes far too late goes."""
    s = Stream(spark, folder, schema, make, name)
    rows = late(rows, 3)
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    for k in range(3):
        s.put(rows[cuts[k] : cuts[k + 1]])
        if k == 1:
            s.restart()
    keys = {x[0]: x for x in rows}
    s.put([(c, 1000, *x[2:]) for c, x in keys.items()] + [(c, 0, *x[2:]) for c, x in keys.items()])
    s.query.stop()
    assert all(r[1] < 1000 for r in s.rows)
    return sorted(map(repr, s.rows))


def test_corner_cache(spark, tmp_path):
    r = random.Random(1)
    rows = [(c, f, n := r.choice([0, 3, 6, 6]), min(n, r.choice([2, 6]))) for c in (1, 2) for f in range(40)]
    schema = "clip_id long, frame_idx long, n_corners long, n_visible long"
    want = sorted(map(repr, map(tuple, sequences.corner_cache(spark.createDataFrame(rows, schema), 5).collect())))
    assert run(spark, tmp_path, schema, lambda s: stages.corner_cache(s, 5, slack=3), rows, "cache") == want


def test_smoothing_and_reuse(spark, tmp_path):
    r = random.Random(2)
    h = lambda: [1 + r.random(), r.random(), 5 * r.random(), r.random(), 1 + r.random(), 60 * r.random(), 0.0, 0.0, 1.0]
    rows = [(c, f, None if r.random() < 0.3 or 10 < f < 24 else h() if r.random() < 0.8 else [float("nan")] * 9) for c in (1, 2) for f in range(40)]
    rows[4] = (1, 4, [1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0])
    schema = "clip_id long, frame_idx long, h array<double>"
    want = sorted(map(repr, map(tuple, homography.smooth(spark.createDataFrame(rows, schema)).collect())))
    assert run(spark, tmp_path, schema, lambda s: stages.smooth(s, slack=3), rows, "smooth") == want
    assert any(", None, False)" in x for x in want)


def test_team_votes(spark, tmp_path):
    r = random.Random(4)
    rows = [(c, f, t, 2 if r.random() < 0.1 else 0, r.choice([None, 0, 1, 1, -1])) for c in (1, 2) for t in (1, 2) for f in range(30)]
    schema = "clip_id long, frame_idx long, track_id int, class_id int, predicted int"
    want = sorted(repr((r.clip_id, r.frame_idx, r.track_id, r.team, r.fresh)) for r in sequences.team_labels(spark.createDataFrame(rows, schema), 7).collect())
    make = lambda s: stages.team_labels(s, 7, slack=3).select("clip_id", "frame_idx", "track_id", "team", "fresh")
    s = Stream(spark, tmp_path, schema, make, "votes")
    shuffled = late(rows, 3)
    half = len(shuffled) // 2
    s.put(shuffled[:half])
    s.restart()
    s.put(shuffled[half:])
    s.put([(c, 1000, t, 0, None) for c in (1, 2) for t in (1, 2)])
    s.query.stop()
    assert sorted(map(repr, s.rows)) == want


def test_flow(spark, tmp_path):
    r = random.Random(5)
    frames = []
    for c in (1, 2):
        for f in range(24):
            at = f // 8
            corners = [(i, i, 100.0 + 50 * i + 30 * at, 60.0 + 40 * i, 0.9) for i in range(0 if f == 20 else 6)]
            flow = [(i, 100.0 + 50 * i + 30 * at + f % 8, 60.0 + 40 * i, r.choice([1.0, 1.0, 1.0, 25.0]), r.random() < 0.95) for i in range(6)]
            frames.append((c, f, corners, flow))
    schema = f"clip_id long, frame_idx long, corners array<struct<{stages._CORNER.replace(' ', ':').replace(',:', ',')}>>, flow array<struct<{stages._MOVED.replace(' ', ':').replace(',:', ',')}>>"
    df = spark.createDataFrame(frames, schema)
    found = df.select("clip_id", "frame_idx", F.explode_outer("corners").alias("c")).select("clip_id", "frame_idx", "c.*")
    moved = df.select("clip_id", "frame_idx", F.explode("flow").alias("c")).select("clip_id", "frame_idx", "c.*")
    want = sorted(map(repr, map(tuple, sequences.flow_corners(found, moved).select("clip_id", "frame_idx", "corner_idx", "class_id", "x", "y", "conf").collect())))
    assert run(spark, tmp_path, schema, lambda s: stages.flow_corners(s, slack=3), frames, "flow") == want


def test_a_key_that_ends_gives_what_waits_and_starts_anew(spark, tmp_path):
    schema = "clip_id long, frame_idx long, n_corners long, n_visible long"
    s = Stream(spark, tmp_path, schema, lambda x: stages.corner_cache(x, 5, slack=2, idle=1500), "ended")
    s.put([(1, f, 6, 6) for f in range(4)])
    assert sorted(r[1] for r in s.rows) == [0, 1]
    time.sleep(2)
    # any batch, of other keys too, finds that the key has ended
    s.put([(2, 0, 6, 6)])
    assert sorted(r[1] for r in s.rows if r[0] == 1) == [0, 1, 2, 3]
    s.put([(1, f, 6, 6) for f in range(3)])
    s.query.stop()
    assert sorted(r[1:3] for r in s.rows if r[0] == 1) == [(0, 0), (0, 0), (1, 0), (2, 0), (3, 0)]


def test_each_frame_has_its_own_way_back(spark):
    r = random.Random(6)
    rows = [(f, [1 + r.random(), 0.1, 40 * r.random(), 0.05, 1 + r.random(), 30 * r.random(), 0.001 * r.random(), 0.0, 1.0]) for f in range(20)] + [(90, None), (91, [1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0]), (92, [float("inf")] * 9)]
    for row in homography.with_inverse(spark.createDataFrame(rows, "frame_idx long, h array<double>")).collect():
        if row.frame_idx >= 90:
            assert row.back is None
        else:
            move = lambda m, x, y: [(m[k] * x + m[k + 1] * y + m[k + 2]) / (m[6] * x + m[7] * y + m[8]) for k in (0, 3)]
            assert move(row.back, *move(row.h, 640.0, 300.0)) == pytest.approx([640.0, 300.0])
