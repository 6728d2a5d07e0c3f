"""Prefix scans against steps one by one, however rows are dealt out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import scans, sequences


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = []
    for key, n in (("a", 1), ("b", 2), ("c", 700), ("d", 33), ("é", 5)):
        out += [(key, f, r.uniform(-50, 50), r.choice([0.0, 0.3, 0.9, 1.4])) for f in r.sample(range(10 * n), n)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # many parts a key
    yield spark.createDataFrame([*rows, ("n", 1, None, 0.5), (None, 1, 1.0, 0.5)], "key string, f long, x double, conf double").repartition(5).cache()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def by_key(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_ema(df, rows):
    want = {}
    for k, v in by_key(rows).items():
        s = v[0][1]
        for _, x, _ in v[1:]:
            s = 0.8 * s + 0.2 * x
        want[k] = s
    got = {r.key: r.ema for r in sequences.ema(df, "key", "f", "x", 0.8).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert sequences.ema(df.limit(0), "key", "f", "x").count() == 0


def test_filter_at_all_confidences(df, rows):
    want = {}
    for k, v in by_key(rows).items():
        m, p = np.array([v[0][1], 0.0]), np.diag([10.0, 10.0])
        step = np.array([[1.0, 1.0], [0.0, 1.0]])
        for _, x, conf in v[1:]:
            m, p = step @ m, step @ p @ step.T + np.diag([1.0, 0.25])
            gain = p[:, 0] / (p[0, 0] + 10 * (1 - min(max(conf, 0.05), 1)) + 1)
            m, p = m + gain * (x - m[0]), p - np.outer(gain, p[0])
        want[k] = m
    got = {r.clip_id: (r.p, r.v) for r in sequences.kalman_axis(df.withColumnRenamed("key", "clip_id").withColumnRenamed("f", "frame_idx"), "x", "conf").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(tuple(want[k]), abs=1e-8) for k in want)


def test_compositions_are_associative():
    r = np.random.default_rng(2)
    for fold, v in ((scans.ema(0.9), r.normal(size=(3, 1))), (scans.kalman(), np.c_[r.normal(size=3), r.uniform(1, 11, 3)])):
        a, b, c = (fold.lift(v)[k : k + 1] for k in range(3))
        assert fold.combine(fold.combine(a, b), c) == pytest.approx(fold.combine(a, fold.combine(b, c)))
        s = fold.start(r.normal(size=(1, 2)))
        assert fold.apply(fold.apply(s, a), b) == pytest.approx(fold.apply(s, fold.combine(a, b)))


@pytest.mark.parametrize("every", [1, 7, 60, 10_000])
def test_cadence(df, rows, every):
    want = {}
    for k, v in by_key(rows).items():
        last, n = None, 0
        for f, *_ in v:
            if last is None or f - last >= every:
                last, n = f, n + 1
        want[k] = (last, n)
    got = {r.key: (r.last, r.n) for r in sequences.cadence(df.filter("x IS NOT NULL"), "key", "f", every).collect()}
    assert got == want


def test_what_is_sent_of_a_part_is_bounded():
    at = np.arange(0, 1_000_000, 3)
    places, ends, counts = scans.looks(at, 60)
    assert len(places) == len(ends) == len(counts) == 21 and counts[0] == 16_667 and ends[0] == 60 * 16_666


def test_a_key_of_many_rows_is_many_tasks_work(spark):
    """Two million rows of one key: no task reads more than a part of them, and what is sent on is a row a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    n = 2_000_000
    df = spark.range(n).selectExpr("1L AS clip_id", "id AS frame_idx", "id * 2.0D AS x")
    out = sequences.kalman_axis(df)
    row = out.collect()[0]
    assert (row.p, row.v) == (pytest.approx(2.0 * (n - 1)), pytest.approx(2.0))
    assert sequences.ema(df, "clip_id", "frame_idx", "x").collect()[0].ema == pytest.approx(2.0 * (n - 1) - 18)
    assert sequences.cadence(df, "clip_id", "frame_idx").collect()[0][1:] == (60 * ((n - 1) // 60), (n - 1) // 60 + 1)
    assert df.agg(F.count("*")).first()[0] == n
