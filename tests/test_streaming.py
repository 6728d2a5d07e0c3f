"""The streamed tracker gives what the batch one gives, also where frames are split over batches and rows come late."""

import pandas as pd

from touchline.operators import tracker
from touchline.streaming import tracking

SCHEMA = "clip_id long, frame_idx long, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double"


def rows(frames):
    return [(c, f, k, 100.0 * k + 2 * f, 50.0 + c, 100.0 * k + 40 + 2 * f, 130.0 + c, 0.9 - 0.1 * k) for c in (1, 2) for f in frames for k in range(3) if not (k == 2 and f in (4, 5))]


def streamed(spark, folder, parts, **how):
    for i, p in enumerate(parts):
        pd.DataFrame(p, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"det_idx": "int32"}).to_parquet(f"{folder}/{i}.parquet")
        if not i:
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
            q = tracking.run(source, **how).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{folder}-state").start()
        q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table("tracked").collect()))


def batch(spark, all_rows, **how):
    return sorted(tuple(-1 if v is None else v for v in r) for r in tracker.run(spark.createDataFrame(all_rows, SCHEMA), **how).collect())


def test_whole_frames(spark, tmp_path):
    parts = [rows(range(0, 4)), rows(range(4, 8))]
    assert streamed(spark, tmp_path, parts, whole_frames=True, stride=2) == batch(spark, sum(parts, []), stride=2)


def test_split_frames_and_late_rows(spark, tmp_path):
    r = rows(range(0, 8))
    first = [x for x in r if x[1] < 4 and not (x[1] == 3 and x[2] == 1)]
    rest = [x for x in r if x not in first]
    late = [(1, 0, 7, 500.0, 500.0, 540.0, 580.0, 0.9)]
    # frame 7 waits: more of it could come
    assert streamed(spark, tmp_path, [first, rest + late]) == [x for x in batch(spark, r) if x[1] < 7]


def test_features_find_a_track_again(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(globals(), "SCHEMA", f"{SCHEMA}, feature array<double>")
    all_rows = [(1, f, k, 100.0 * k, y := 50.0 + 60 * (k == 0 and f > 5), 100.0 * k + 40, y + 80, 0.9, None if k == 2 else [float(k == 0), float(k == 1)]) for f in range(10) for k in range(3) if not (k == 0 and f in (4, 5))]
    want = batch(spark, all_rows, feature="feature")
    assert want == sorted((1, f, k + 1, k) for _, f, k, *_ in all_rows)
    assert max(r[2] for r in batch(spark, all_rows)) == 4
    assert streamed(spark, tmp_path, [[r for r in all_rows if r[1] < 5], [r for r in all_rows if r[1] >= 5]], whole_frames=True, feature="feature") == want
