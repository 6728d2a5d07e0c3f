"""Input relations, derived from the test tables: anchors, observations, embeddings, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, det_idx, class_id, cx, cy, w, h, conf: two per line item."""
    # lines are numbered before each becomes two, so half the rows are dealt out and sorted; lines that the order leaves equal come one after the other, first all first ones and then all second ones
    order = Window.partitionBy("frame_idx").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").withColumn("frame_idx", F.floor(F.col("l_orderkey") / 4).cast("long"))
    li = li.withColumns({"rank": F.rank().over(order) - 1, "rn": F.row_number().over(order) - 1, "upto": F.count(F.lit(1)).over(order).cast("int")})
    return li.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "frame_idx",
        (F.col("rank") + F.col("rn") + F.col("j") * (F.col("upto") - F.col("rank"))).cast("int").alias("det_idx"),
        (F.col("l_linenumber") % 3).cast("int").alias("class_id"),
        (((F.col("l_partkey") * 37) % 1280).cast("double") + F.col("j") * F.col("l_tax") * 100.0).alias("cx"),
        ((F.col("l_suppkey") * 53) % 720).cast("double").alias("cy"),
        (80.0 + F.col("l_quantity") * 4.0).alias("w"),
        (120.0 + F.col("l_quantity") * 3.0).alias("h"),
        (0.05 + F.col("l_discount") * 9.0 - F.col("j") * 0.02).alias("conf"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id (user), frame_idx (minute), x, y: one an event, the last of each minute."""
    ev = table(spark, sf_dir, "events")
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000).cast("long")
    rows = ev.select(F.col("user_id").alias("clip_id"), minute.alias("m"), "event_id", "value")
    order = Window.partitionBy("clip_id", "m").orderBy(F.col("event_id").desc())
    rows = rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    base = Window.partitionBy("clip_id").orderBy("m")
    return rows.select("clip_id", (F.row_number().over(base) * 3 + F.col("event_id") % 3).cast("long").alias("frame_idx"), ((F.col("event_id") * 37) % 1280).cast("double").alias("x"), ((F.col("event_id") * 53) % 720).cast("double").alias("y"), "value", "event_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, e array<double>, label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")


#: DuckDB's forms of the same relations, for oracles.
ANCHORS_SQL = """anchors AS (SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS frame_idx,
  CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 4) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, j) - 1 AS INTEGER) AS det_idx,
  CAST(l_linenumber % 3 AS INTEGER) AS class_id, CAST((l_partkey * 37) % 1280 AS DOUBLE) + j * l_tax * 100.0 AS cx, CAST((l_suppkey * 53) % 720 AS DOUBLE) AS cy,
  80.0 + l_quantity * 4.0 AS w, 120.0 + l_quantity * 3.0 AS h, CAST(0.05 AS DOUBLE) + l_discount * 9.0 - j * CAST(0.02 AS DOUBLE) AS conf
  FROM lineitem, (VALUES (0), (1)) t(j))"""
BOXES_SQL = ANCHORS_SQL + """, decoded AS (SELECT frame_idx, det_idx, class_id, conf, greatest(0.0::DOUBLE, least(cx - w / 2, 1280.0::DOUBLE)) AS x1, greatest(0.0::DOUBLE, least(cy - h / 2 - 8, 720.0::DOUBLE)) AS y1,
  greatest(0.0::DOUBLE, least(cx + w / 2, 1280.0::DOUBLE)) AS x2, greatest(0.0::DOUBLE, least(cy + h / 2 - 8, 720.0::DOUBLE)) AS y2 FROM anchors
  WHERE conf >= CASE WHEN class_id = 1 THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END), boxes AS (SELECT * FROM decoded WHERE x2 > x1 AND y2 > y1)"""
OBSERVATIONS_SQL = """last AS (SELECT user_id AS clip_id, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS m, event_id, value,
  row_number() OVER (PARTITION BY user_id, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) ORDER BY event_id DESC) AS rn FROM events),
obs AS (SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY m) * 3 + event_id % 3 AS BIGINT) AS frame_idx, CAST((event_id * 37) % 1280 AS DOUBLE) AS x,
  CAST((event_id * 53) % 720 AS DOUBLE) AS y, value, event_id FROM last WHERE rn = 1)"""
EMBEDDINGS_SQL = "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
