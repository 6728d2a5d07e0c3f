"""Homographies and team models on small fixtures."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.operators import homography, pitch, sequences, teams


def seen(h, classes):
    refs = [(c, *p) for c in classes for p in pitch.PITCH[c]]
    p = np.array([[x, y, 1.0] for _, x, y in refs]) @ np.array(pitch.inverse(h)).reshape(3, 3).T
    return np.array([c for c, *_ in refs]), p[:, :2] / p[:, 2:], np.linspace(0.9, 0.5, len(refs))


@settings(max_examples=25, deadline=None)
@given(st.floats(0.05, 0.2), st.floats(-0.02, 0.02), st.floats(-60, -40), st.floats(0, 0.0002))
def test_corners_come_back_onto_pitch_points(scale, shear, shift, tilt):
    h = [scale, shear, shift, 0.0, scale, -34.0, 0.0, tilt, 1.0]
    found, residual = homography.best(*seen(h, [0, 4, 8, 10]))
    assert found is not None and residual < 1e-6


def test_exact_fit_equals_the_known_one():
    src = np.array([[[0, 0], [100, 5], [90, 80], [3, 70]]], float)
    h = np.array([0.1, 0.02, -5, 0.01, 0.2, -8, 0.0001, 0.0003, 1.0])
    q = np.c_[src[0], np.ones(4)] @ h.reshape(3, 3).T
    assert np.allclose(homography.solve(src, (q[:, :2] / q[:, 2:])[None])[0], h)
    assert np.isnan(homography.solve(src[:, [0, 0, 1, 2]], src[:, [0, 0, 1, 2]])).all()


@pytest.mark.parametrize("n", [0, 3])
def test_too_few_corners_have_no_fit(n):
    found, residual = homography.best(np.arange(n), np.zeros((n, 2)), np.full(n, 0.9))
    assert found is None and math.isnan(residual)


def test_unknown_classes_and_weak_corners_take_no_part():
    c, p, k = seen([0.1, 0, -50, 0, 0.1, -34, 0, 0, 1.0], [0, 4, 8])
    plain = homography.best(c, p, k)
    more = homography.best(np.r_[c, 99, 0], np.r_[p, [[1.0, 2.0]], [[3.0, 4.0]]], np.r_[k, 0.95, 0.1])
    assert plain == more


def test_fit_and_smooth_keep_failed_frames_for_a_while(spark):
    rows = [(1, f, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] if f == 2 else None) for f in range(16)]
    got = homography.smooth(spark.createDataFrame(rows, "clip_id long, frame_idx long, h array<double>")).orderBy("frame_idx").collect()
    assert [r.valid for r in got] == [False, False] + [True] * 11 + [False] * 3
    assert homography.fit(spark.createDataFrame([], "frame_idx long, corner_idx long, class_id int, x double, y double, conf double")).count() == 0


def test_one_group_fails_the_gate_and_two_pass(spark):
    rng = np.random.default_rng(1)
    one = [(i, rng.normal(size=8).tolist()) for i in range(100)]
    two = [(i, [x + 20 * (i % 2) for x in v]) for i, v in one]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, e array<double>")
    a, b = (teams.TeamModel().fit(frame(r)) for r in ([(i, v[:1] * 8) for i, v in one][:1], two))
    assert not a.valid and {r.team for r in a.predict(frame(one)).collect()} == {0}
    assert b.valid and len({(r.vec_id % 2, r.team) for r in b.predict(frame(two)).collect()}) == 2
    assert not teams.TeamModel().fit(frame([])).valid


def test_gate_refuses_a_score_that_is_no_number():
    m = teams.TeamModel(centroids=np.zeros((2, 3)), score=float("nan"))
    assert not m.valid


def test_corner_cache_keeps_strong_corners_over_weak_ones(spark):
    rows = [(1, f, 5, 5 if f in (0, 17) else 1) for f in range(20)]
    got = sequences.corner_cache(spark.createDataFrame(rows, "clip_id long, frame_idx long, n_corners long, n_visible long")).orderBy("frame_idx").collect()
    assert [r.from_frame for r in got] == [0] * 17 + [17] * 3
    assert [r.frame_idx for r in got if r.detected] == [0, 16, 17]


def test_inverses_at_once_are_those_of_each(spark):
    r = np.random.default_rng(8)
    h = [*r.normal(size=(50, 9)), None, np.zeros(9), np.full(9, np.nan), np.array([1.0, 2, 3, 2, 4, 6, 0, 0, 1]), np.eye(3).ravel() * 1e-3, np.eye(3).ravel() * 1e200]
    with np.errstate(all="ignore"):
        want = [None if v is None else homography.inverse(v) for v in h]
        got = homography.inverses(h)
    assert [None if v is None else v.tolist() for v in got] == [None if v is None else v.tolist() for v in want]
    assert homography.inverses([None]) == [None] and homography.inverses([]) == []
    fits = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "frame_idx long, h array<double>")
    plan = homography.with_inverse(fits).filter("back IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("inverted(h") == 1
