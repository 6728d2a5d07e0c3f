"""Every query that has SQL, against DuckDB on the smallest tables; and what no SQL covers, on small fixtures."""

import os

import duckdb
import pytest

from touchline.operators import detections, sequences
from touchline.plans import catalogue, composed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(composed.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    r = duck.execute(catalogue.ORACLES[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(x[c] for c in cols) for x in df.collect()))) == sorted(map(repr, r.fetchall()))


def test_interpolation_fixture(spark):
    obs = spark.createDataFrame([(1, 0, 20.0, 20.0), (1, 5, 40.0, 25.0), (1, 10, 80.0, 45.0)], "clip_id long, frame_idx long, x double, y double")
    got = {r.frame_idx: (round(r.x, 6), round(r.y, 6)) for r in sequences.interpolate(obs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 6, 7, 8, 9] and got[3] == (32.0, 23.0) and got[7] == (51.2, 29.4)


def test_majority_ties_go_to_zero(spark):
    votes = spark.createDataFrame([(7, 0, 1), (7, 1, 0), (7, 2, 1)], "track_id long, seq long, vote int")
    assert [r.label for r in sequences.majority(votes).orderBy("seq").collect()] == [1, 0, 1]


def test_suppression_is_idempotent_and_empty_tables_work(spark):
    b = catalogue._boxes(spark, SF)
    once = detections.nms(b)
    assert sorted(once.collect()) == sorted(detections.nms(once).collect())
    assert detections.nms(b.limit(0)).count() == 0
