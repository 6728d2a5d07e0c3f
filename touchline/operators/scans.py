"""Folds over a key's rows in order, as prefix scans: steps that compose are composed in parts, so one key's rows need never lie in one task or one array.

Rows are dealt out by ranges of (key, order). Each Arrow batch of a task composes its rows' steps by key, in a tree of NumPy operations over all its keys at once, and sends one row a key; those few rows of a key are
then composed in order. What a key's rows do is known up to the state before them, and that is all that a composition needs.

Rows whose order is equal go by their values. Rows without a key, an order or a value don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.package import ship


@dataclass
class Fold:
    """lift: a batch's values (rows x columns) to elements (rows x numbers); combine: elements of earlier and later rows to one; start: the first row's values to a state; apply: states and elements to states."""

    lift: Callable[[np.ndarray], np.ndarray]
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    start: Callable[[np.ndarray], np.ndarray]
    apply: Callable[[np.ndarray, np.ndarray], np.ndarray]


def composed(elements: np.ndarray, first: np.ndarray, combine: Callable) -> np.ndarray:
    """One element for each segment (first: where they begin), by combining neighbours again and again."""
    sizes = np.diff(np.r_[first, len(elements)])
    while len(elements) > len(sizes):
        start = np.cumsum(sizes) - sizes
        place = np.arange(len(elements)) - np.repeat(start, sizes)
        left = place % 2 == 0
        pair = np.flatnonzero(left & (place + 1 < np.repeat(sizes, sizes)))
        out = elements[left]
        at = np.cumsum(left) - 1
        out[at[pair]] = combine(elements[pair], elements[pair + 1])
        elements, sizes = out, (sizes + 1) // 2
    return elements


def _dealt(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    some = df.select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).dropna()
    by = ["key", "at", *(f"v{i}" for i in range(len(cols)))]
    return some.repartitionByRange(*by).sortWithinPartitions(*by)


def last_state(df: DataFrame, key: str, order: str, cols: list[str], fold: Fold, names: list[str]) -> DataFrame:
    """key and the state (names) after its last row."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    dealt = _dealt(df, key, order, cols)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys, values = b["key"].to_numpy(), b[[f"v{i}" for i in range(len(cols))]].to_numpy(float)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            elements = fold.lift(values)
            # the first row of a key's part stands apart: where it is the key's first, it is the start
            rest = np.delete(np.arange(len(b)), first)
            seg = np.searchsorted(first, rest, side="right") - 1
            has = np.unique(seg)
            more = composed(elements[rest], np.searchsorted(seg, has), fold.combine) if len(rest) else elements[:0]
            whole: list = [None] * len(first)
            for k, e in zip(has.tolist(), more, strict=True):
                whole[k] = e.tolist()
            n = np.arange(len(first))
            yield pd.DataFrame({"key": keys[first], "at": b["at"].to_numpy()[first], "tie": [values[i].tolist() for i in first], "first": [elements[i].tolist() for i in first], "rest": [whole[k] for k in n]})

    def join(df: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(df["key"], df["at"], map(tuple, df["tie"]), df["first"], df["rest"], strict=True), key=lambda r: r[:3])
        out, state, current = [], None, None
        for key, _, values, one, more in rows:
            if key != current:
                if state is not None:
                    out.append((current, *state[0].tolist()))
                current, state = key, fold.start(np.array([values], float))
            else:
                state = fold.apply(state, np.array([one], float))
            if more is not None:
                state = fold.apply(state, np.array([more], float))
        if state is not None:
            out.append((current, *state[0].tolist()))
        return pd.DataFrame(out, columns=["key", *names])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.mapInPandas(parts, f"key {kind}, at long, tie array<double>, first array<double>, rest array<double>")
    done = found.groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("bucket")).applyInPandas(lambda t: join(t), f"key {kind}, " + ", ".join(f"{n} double" for n in names))
    return done.withColumnRenamed("key", key)


def ema(keep: float) -> Fold:
    """s <- keep * s + (1 - keep) * x, from the first value: affine maps (a, b)."""
    return Fold(
        lambda v: np.c_[np.full(len(v), keep), (1 - keep) * v[:, 0]],
        lambda p, q: np.c_[q[:, 0] * p[:, 0], q[:, 0] * p[:, 1] + q[:, 1]],
        lambda v: v[:, :1],
        lambda s, e: e[:, :1] * s + e[:, 1:],
    )


def kalman(first: float = 10.0, noise: tuple[float, float] = (1.0, 0.25)) -> Fold:
    """A constant-velocity filter of one axis: values are (observed position, the observation's variance); states position, velocity.

    An element is what some steps do to any state before them: (A, b, C), the state after them where the one before is known exactly, and (eta, J), what they say about the one before. These compose (the associative
    form of filtering), with covariances that stay symmetric and positive; the composition in any grouping gives what steps one by one give, up to rounding."""
    step = np.array([[1.0, 1.0], [0.0, 1.0]])
    q = np.diag(noise)
    eye = np.eye(2)

    def unpack(e: np.ndarray):
        return e[:, :4].reshape(-1, 2, 2), e[:, 4:6, None], e[:, 6:10].reshape(-1, 2, 2), e[:, 10:12, None], e[:, 12:].reshape(-1, 2, 2)

    def pack(a, b, c, eta, j) -> np.ndarray:
        return np.concatenate([a.reshape(-1, 4), b[..., 0], c.reshape(-1, 4), eta[..., 0], j.reshape(-1, 4)], axis=1)

    def lift(v: np.ndarray) -> np.ndarray:
        s = q[0, 0] + v[:, 1]
        gain = np.zeros((len(v), 2, 1))
        gain[:, 0, 0] = q[0, 0] / s
        keep = eye[None] - gain @ np.array([[[1.0, 0.0]]])
        back = step.T @ np.array([[1.0], [0.0]])
        return pack(keep @ step, gain * v[:, :1, None], keep @ q, back[None] * (v[:, 0] / s)[:, None, None], (back @ back.T)[None] / s[:, None, None])

    def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = unpack(x), unpack(y)
        inner = np.linalg.inv(eye[None] + c1 @ j2)
        left, t = a2 @ inner, np.swapaxes
        right = t(a1, 1, 2) @ t(inner, 1, 2)
        return pack(left @ a1, left @ (b1 + c1 @ e2) + b2, left @ c1 @ t(a2, 1, 2) + c2, right @ (e2 - j2 @ b1) + e1, right @ j2 @ a1 + j1)

    def apply(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        a, b, c, eta, j = unpack(e)
        mean, cov = s[:, :2, None], s[:, 2:6].reshape(-1, 2, 2)
        left = a @ np.linalg.inv(eye[None] + cov @ j)
        return np.concatenate([(left @ (mean + cov @ eta) + b)[..., 0], (left @ cov @ np.swapaxes(a, 1, 2) + c).reshape(-1, 4)], axis=1)

    return Fold(lift, combine, lambda v: np.c_[v[:, 0], np.zeros(len(v)), np.full(len(v), first), np.zeros((len(v), 2)), np.full(len(v), first)], apply)


def looks(at: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For looks that begin at each of the first places (sorted, distinct) that may be the next one after an earlier look: the place, the last look, and how many there are.

    Each place points at the next one that is ``every`` or more further on; pointers are doubled until they reach the end."""
    n = len(at)
    to = np.append(np.searchsorted(at, at + every), n)
    end, count = np.append(np.arange(n), n), np.append(np.ones(n, np.int64), 0)
    while (to[:n] < n).any():
        # what lies behind a pointer is added to what lies before it
        end = np.where(to < n, end[to], end)
        count = count + count[to]
        to = to[to]
    few = int(np.searchsorted(at, at[0] + every)) + 1
    return at[:few], at[end[: min(few, n)]], count[: min(few, n)]


def cadence(df: DataFrame, key: str, order: str, every: int) -> DataFrame:
    """key, last, n: when a label was made anew last, and how often: at the first row, and then at the first one ``every`` or more after the last time.

    What a part of a key's rows does depends on the last look before it, which can only decide at which of the places within ``every`` of the part's first the next look is: so much is sent of a part, whatever its length."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    dealt = _dealt(df.select(key, order).distinct(), key, order, [])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys, at = b["key"].to_numpy(), b["at"].to_numpy()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            found = [looks(at[i:j], every) for i, j in zip(first, [*first[1:], len(at)], strict=True)]
            yield pd.DataFrame({"key": keys[first], "places": [f[0].tolist() for f in found], "ends": [f[1].tolist() for f in found], "counts": [f[2].tolist() for f in found]})

    def join(t: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for key, places, ends, counts in sorted(zip(t["key"], t["places"], t["ends"], t["counts"], strict=True), key=lambda r: (r[0], r[1][0])):
            last, n = out.get(key, (None, 0))
            k = 0 if last is None else int(np.searchsorted(np.asarray(places), last + every))
            out[key] = (last, n) if k >= len(ends) else (int(ends[k]), n + int(counts[k]))
        return pd.DataFrame([(k, *v) for k, v in out.items()], columns=["key", "last", "n"])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.mapInPandas(parts, f"key {kind}, places array<long>, ends array<long>, counts array<long>")
    done = found.groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("bucket")).applyInPandas(lambda t: join(t), f"key {kind}, last long, n long")
    return done.withColumnRenamed("key", key)
