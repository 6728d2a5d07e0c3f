"""Whole documents at their output paths, or none; and figures gathered on the way."""

import json
import os

import pytest
from pyspark.sql import functions as F

from touchline.sources import documents, metrics, sinks


def lines(spark, frames=5, clips=3):
    return spark.range(clips * frames).selectExpr(f"id % {clips} AS clip_id", f"id div {clips} AS frame_idx", f"concat('{{\"frame\":', id div {clips}, '}}') AS line")


def videos(spark, folder, clips=3):
    rows = [(c, '{"video":{"path":"v%d"}}' % c, f"{folder}/clip {c}_out.json") for c in range(clips)]
    return spark.createDataFrame(rows, "clip_id long, header string, output string")


def test_one_document_a_clip_at_its_path(spark, tmp_path):
    assert sinks.telemetry_documents(lines(spark), videos(spark, tmp_path)) == {"frames": 15}
    assert sorted(os.listdir(tmp_path)) == [f"clip {c}_out.json" for c in range(3)]
    for c in range(3):
        doc = json.loads((tmp_path / f"clip {c}_out.json").read_text())
        assert doc == {"video": {"path": f"v{c}"}, "frames": [{"frame": f} for f in range(5)]}
    # again, with fewer frames, and a clip without any: documents are replaced
    assert sinks.telemetry_documents(lines(spark, 2, 2), videos(spark, tmp_path)) == {"frames": 4}
    assert [len(json.loads((tmp_path / f"clip {c}_out.json").read_text())["frames"]) for c in range(3)] == [2, 2, 0]
    assert sinks.telemetry_documents(lines(spark).limit(0), videos(spark, tmp_path).limit(0)) == {"frames": 0}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    fail = F.when((F.col("clip_id") == 2) & (F.col("frame_idx") == 3), F.raise_error(F.lit("broken"))).otherwise(F.col("line"))
    with pytest.raises(Exception, match="broken"):
        sinks.telemetry_documents(lines(spark).withColumn("line", fail), videos(spark, tmp_path))
    assert os.listdir(tmp_path) == []
    (tmp_path / "clip 0_out.json").write_text("old")
    with pytest.raises(Exception, match="broken"):
        sinks.telemetry_documents(lines(spark).withColumn("line", fail), videos(spark, tmp_path))
    assert os.listdir(tmp_path) == ["clip 0_out.json"] and (tmp_path / "clip 0_out.json").read_text() == "old"


def test_a_second_attempt_of_a_task_adds_nothing(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"output": [f"{tmp_path}/a", f"{tmp_path}/a", f"{tmp_path}/b"], "at": [0, 1, 0], "value": ["x", "y", "z"]})
    w = documents._Writer("job")
    w.write(iter([batch]))  # its message is lost with its executor
    w.commit([w.write(iter([batch])), None])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and (tmp_path / "a").read_text() == "x\ny\n"
    w.abort([w.write(iter([batch]))])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_figures_equal_a_separate_aggregation(spark, tmp_path):
    df = spark.range(101).selectExpr("id AS frame_idx", "CASE WHEN id % 5 <> 3 THEN id / 7.0D END AS track", "1.5D AS detect").repartition(3)
    ran = F.col("frame_idx") % 2 == 0
    seen = metrics.Watched(df, ran, {"track": F.col("track"), "detect": F.col("detect")})
    seen.frames.write.parquet(str(tmp_path / "out"))
    got = seen.summary()
    rows = df.collect()
    track = [r.track or 0.0 for r in rows]
    even = [r.track or 0.0 for r in rows if r.frame_idx % 2 == 0]
    assert (got["frames"], got["ran"]) == (101, 51) and got["detect_per_frame"] == got["detect_per_run"] == 1.5
    assert got["track_per_frame"] == pytest.approx(sum(track) / 101) and got["track_per_run"] == pytest.approx(sum(even) / 51)
    empty = metrics.Watched(df.limit(0), ran, {"track": F.col("track")})
    empty.frames.write.parquet(str(tmp_path / "empty"))
    assert set(empty.summary().values()) == {0}


def test_figures_of_a_stream(spark, tmp_path):
    told = []
    progress = metrics.Progress("seen", told.append)
    spark.streams.addListener(progress)
    try:
        for k in range(2):
            spark.range(10 * k, 10 * k + 10).withColumnRenamed("id", "frame_idx").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("frame_idx long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        watched = stream.observe("seen", *metrics.figures(F.col("frame_idx") % 5 == 0, {"track": F.lit(2.0)}))
        q = watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        import time

        for _ in range(50):
            if progress.total()["frames"] == 20:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    assert progress.total() == {"frames": 20, "ran": 4, "track_ms": 40.0, "track_ran_ms": 8.0, "track_per_frame": 2.0, "track_per_run": 2.0} and told
