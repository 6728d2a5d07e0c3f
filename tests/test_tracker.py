import itertools

import numpy as np
import pytest

from touchline.operators.tracker import Tracker, appearance, iou_matrix, likeness, solve


def box(x, y):
    return [x - 5, y - 10, x + 5, y + 10]


def update(t, rows, predicted=False):
    boxes = np.array([box(x, y) for x, y, _ in rows], float).reshape(-1, 4)
    return t.update(boxes, np.full(len(rows), 0.9), [np.array(f, float) for *_, f in rows], predicted)


def test_two_objects_get_two_ids_and_appearance_recovers_one():
    t = Tracker()
    first = update(t, [(100, 100, [1, 0, 0]), (300, 100, [0, 1, 0])])
    assert len({i for i, _ in first}) == 2
    update(t, [], predicted=True)
    again = update(t, [(180, 100, [1, 0, 0])])
    assert again == [(first[0][0], 0)]


def test_expiry_gives_a_new_id():
    t = Tracker(buffer=3)
    assert update(t, [(100, 100, [1, 0])]) == [(1, 0)]
    for _ in range(3):
        update(t, [])
    assert update(t, [(100, 100, [1, 0])]) == [(2, 0)]


def test_predicted_frames_show_active_tracks_only():
    t = Tracker()
    update(t, [(100, 100, [1, 0])])
    update(t, [])
    assert update(t, [], predicted=True) == []


def best(cost):
    n, m = cost.shape
    found = (0, 0.0)
    for k in range(min(n, m), 0, -1):
        sums = [sum(cost[r, c] for r, c in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k)]
        sums = [s for s in sums if np.isfinite(s)]
        if sums:
            return k, min(sums)
    return found


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_optimal(seed):
    r = np.random.default_rng(seed)
    cost = r.random((r.integers(1, 5), r.integers(1, 5)))
    cost[r.random(cost.shape) < 0.3] = np.inf
    pairs = solve(cost)
    k, s = best(cost)
    assert len(pairs) == k and sum(cost[p] for p in pairs) == pytest.approx(s)


def test_empty_frames_and_many_detections():
    t = Tracker()
    assert update(t, []) == []
    assert len(update(t, [(20 * i, 100, [1, 0]) for i in range(50)])) == 40


def test_overlap_and_appearance():
    assert iou_matrix(np.array([[0, 0, 2, 2.0]]), np.array([[1, 0, 3, 2.0], [5, 5, 6, 6], [1, 1, 1, 1]])).round(3).tolist() == [[0.333, 0, 0]]
    assert appearance(None, np.ones(2)) == 1 and appearance(np.zeros(2), np.ones(2)) == 1 and appearance(np.ones(2), np.ones(2)) == pytest.approx(0)


def test_a_features_length_does_not_count():
    t = Tracker()
    update(t, [(100, 100, [50, 0])])
    update(t, [(100, 100, [0, 1])])
    assert t.active[0].feature == pytest.approx(np.array([0.9, 0.1]) / np.hypot(0.9, 0.1))


def test_likeness_of_all_pairs_is_that_of_each():
    r = np.random.default_rng(5)
    some = [None, np.zeros(3), np.empty(0), *r.normal(size=(4, 3)), *r.normal(size=(2, 5)), np.full(3, 1e-9)]
    for a, b in ((some, some[::-1]), (some, []), ([], some), ([None], [None])):
        assert likeness(a, b) == pytest.approx(np.array([[appearance(x, y) for y in b] for x in a]).reshape(len(a), len(b)))
