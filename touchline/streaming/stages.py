"""Stages that go through a clip in order, over streams: corners in use, flow, homographies, team votes. Each is a processor with typed state, and takes the same steps as its batch form.

A row is a frame's (or a box's). Rows of a key are taken in order of frame_idx, each frame once: rows may come late by ``slack`` frames, and wait in state until a frame so much newer has come; rows of frames
that are done go. Without slack, a batch's rows are taken at once. A key of which nothing has come for ``idle`` milliseconds has ended: what waits comes out, and its state goes, so that state doesn't grow with
all clips ever seen. State lives in Spark's state store (RocksDB, which these stages need: see store()), is checkpointed with the query, and moves with its key when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import homography, sequences
from ..sources.package import ship


def store(spark: SparkSession) -> None:
    """Have the session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(v):
    """A value as state takes it: no NumPy scalars, NaN as None."""
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v.tolist()]
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    v = v.item() if isinstance(v, np.generic) else v
    return None if v is pd.NA or v is None or isinstance(v, float) and v != v else v


class Stage(StatefulProcessor):
    """What all stages share: order, lateness, the end of a key. A stage has typed state of its own and says what a frame's row does."""

    #: Names of a row's columns beside its keys, frame_idx first; their types, for rows that wait; the result's columns beside the keys.
    columns: list[str]
    types: str
    output: list[str]

    def __init__(self, keys: list[str], slack: int, idle: int | None):
        self.keys, self.slack, self.idle = keys, slack, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "frame_idx long, newest long")
        self.waiting = handle.getListState("waiting", self.types)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare the stage's own state."""

    def step(self, row: tuple) -> list[tuple]:
        """The results of a row."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clear the stage's own state."""

    def _taken(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = [(*key, *r) for row in rows for r in self.step(row)]
        return pd.DataFrame(out, columns=[*self.keys, *self.output]).astype(object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, newest = self.done.get() if self.done.exists() else (None, None)
        # pandas holds whole numbers beside nulls as floats, which state would take for nulls
        whole = [c.split()[1] in ("long", "int") for c in self.types.split(", ")]
        new = [tuple(int(v) if w and v is not None else v for w, v in zip(whole, map(_plain, r), strict=True)) for df in rows for r in df[self.columns].itertuples(index=False)]
        new = [r for r in new if done is None or r[0] > done]
        if self.slack:
            new += [tuple(r) for r in self.waiting.get()]
        first = {}
        for r in new:  # a frame that comes twice counts once
            first.setdefault(r[0], r)
        order = [first[f] for f in sorted(first)]
        newest = max([x for x in (newest, order[-1][0] if order else None) if x is not None], default=None)
        ready = [r for r in order if not self.slack or r[0] <= newest - self.slack]
        if self.slack:
            late = order[len(ready) :]
            self.waiting.put(late) if late else self.waiting.clear()
        result = self._taken(key, ready)
        if newest is not None:
            self.done.update((ready[-1][0] if ready else done, newest))
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield result

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        result = self._taken(key, sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[0]) if self.slack else [])
        for s in (self.done, self.waiting):
            s.clear()
        self.forget()
        yield result

    def close(self) -> None:
        pass


class CornerCache(Stage):
    columns, types, output = ["frame_idx", "n_corners", "n_visible"], "frame_idx long, n_corners long, n_visible long", ["frame_idx", "from_frame", "detected"]

    def __init__(self, keys: list[str], slack: int, idle: int | None, interval: int, least: int):
        super().__init__(keys, slack, idle)
        self.interval, self.least = interval, least

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getValueState("cache", "held long, age int, empty boolean")

    def step(self, row: tuple) -> list[tuple]:
        held, age, empty = self.cache.get() if self.cache.exists() else (None, 0, True)
        held, age, empty, ran = sequences.cache_step(held, age, empty, *row, self.interval, self.least)
        self.cache.update((held, age, empty))
        return [(row[0], held, ran)]

    def forget(self) -> None:
        self.cache.clear()


class Smoothed(Stage):
    columns, types, output = ["frame_idx", "h"], "frame_idx long, h array<double>", ["frame_idx", "h", "valid"]

    def __init__(self, keys: list[str], slack: int, idle: int | None, stale: int):
        super().__init__(keys, slack, idle)
        self.stale = stale

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "h array<double>, missed int")

    def step(self, row: tuple) -> list[tuple]:
        last, missed = self.kept.get() if self.kept.exists() else (None, 0)
        h = row[1] if row[1] is not None and all(x is not None for x in row[1]) else None
        last, missed, good = homography.smooth_step(None if last is None else np.array(last, float), missed, h, self.stale)
        last = None if last is None else last.tolist()
        self.kept.update((last, missed))
        return [(row[0], last if good else None, good)]

    def forget(self) -> None:
        self.kept.clear()


class Labels(Stage):
    columns, types, output = ["frame_idx", "class_id", "predicted"], "frame_idx long, class_id int, predicted int", ["frame_idx", "team", "fresh"]

    def __init__(self, keys: list[str], slack: int, idle: int | None, every: int, last: int):
        super().__init__(keys, slack, idle)
        self.every, self.last = every, last

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.votes = handle.getListState("votes", "vote int")
        self.label = handle.getValueState("label", "team int, looked long")

    def step(self, row: tuple) -> list[tuple]:
        votes = [v[0] for v in self.votes.get()]
        team, looked = self.label.get() if self.label.exists() else (-1, None)
        new, team, looked, now = sequences.vote_step(votes, team, looked, row[0], row[1], None if row[2] is None else int(row[2]), self.every, self.last)
        if new != votes:
            self.votes.put([(v,) for v in new])
        self.label.update((team, looked))
        return [(row[0], None if row[1] == 2 else team, now)]

    def forget(self) -> None:
        self.votes.clear()
        self.label.clear()


_CORNER = "corner_idx int, class_id int, x double, y double, conf double"
_MOVED = "corner_idx int, x double, y double, error double, status boolean"


class FlowCorners(Stage):
    """Rows hold a frame's corners and flow as flat arrays, each in the order of its columns: five numbers a corner (_CORNER), five a moved one (_MOVED, status as 1 or 0)."""

    columns, types = ["frame_idx", "corners", "flow"], "frame_idx long, corners array<double>, flow array<double>"
    output = ["frame_idx", "corner_idx", "class_id", "x", "y", "conf"]

    def __init__(self, keys: list[str], slack: int, idle: int | None, least: int):
        super().__init__(keys, slack, idle)
        self.least = least

    def open(self, handle: StatefulProcessorHandle) -> None:
        kind = "class_id double, x double, y double, conf double"
        self.used, self.taken, self.begun = handle.getListState("used", kind), handle.getListState("taken", kind), handle.getValueState("begun", "frame_idx long")

    @staticmethod
    def _table(state) -> np.ndarray:
        return np.array([list(r) for r in state.get()], float).reshape(-1, 4)

    def step(self, row: tuple) -> list[tuple]:
        now = np.array(row[1] or [], float).reshape(-1, 5)
        now = now[np.argsort(now[:, 0], kind="stable")][:, 1:]
        moved = {int(i): (x, y, e, s > 0) for i, x, y, e, s in np.array(row[2] or [], float).reshape(-1, 5).tolist()}
        used, last = sequences.flow_step(self._table(self.used), self._table(self.taken) if self.begun.exists() else None, now, moved, self.least)
        for state, rows in ((self.used, used), (self.taken, last)):
            state.put([tuple(r) for r in rows.tolist()]) if len(rows) else state.clear()
        self.begun.update((row[0],))
        return [(row[0], i, int(c[0]), float(c[1]), float(c[2]), float(c[3])) for i, c in enumerate(used)]

    def forget(self) -> None:
        for s in (self.used, self.taken, self.begun):
            s.clear()


def _run(rows: DataFrame, stage: Stage, schema: str) -> DataFrame:
    ship(rows.sparkSession)
    picked = rows.select(*stage.keys, *stage.columns)
    return picked.groupBy(*stage.keys).transformWithStateInPandas(stage, schema, "append", "processingtime" if stage.idle else "none")


def corner_cache(frames: DataFrame, interval: int = 15, least: int = 4, slack: int = 0, idle: int | None = None) -> DataFrame:
    """sequences.corner_cache over a stream of frames."""
    return _run(frames, CornerCache(["clip_id"], slack, idle, interval, least), "clip_id long, frame_idx long, from_frame long, detected boolean")


def smooth(fits: DataFrame, stale: int = 10, slack: int = 0, idle: int | None = None) -> DataFrame:
    """homography.smooth over a stream of fits; so is the reuse of stale ones."""
    return _run(fits, Smoothed(["clip_id"], slack, idle, stale), "clip_id long, frame_idx long, h array<double>, valid boolean")


def team_labels(tracked: DataFrame, every: int = 60, last: int = 15, slack: int = 0, idle: int | None = None) -> DataFrame:
    """sequences.team_labels over a stream of tracked boxes."""
    return _run(tracked.filter("track_id >= 0"), Labels(["clip_id", "track_id"], slack, idle, every, last), "clip_id long, track_id int, frame_idx long, team int, fresh boolean")


def flow_corners(frames: DataFrame, least: int = 4, slack: int = 0, idle: int | None = None) -> DataFrame:
    """sequences.flow_corners over a stream of frames: clip_id, frame_idx, corners and flow as arrays of structs (their columns as in batch; both may be empty or null)."""
    flat = lambda name, kind: f"flatten(transform({name}, s -> array({', '.join('cast(s.' + c.split()[0] + ' as ' + ('int) ' if c.endswith('boolean') else 'double) ') for c in kind.split(', '))})))"
    rows = frames.selectExpr("clip_id", "frame_idx", f"cast({flat('corners', _CORNER)} as array<double>) AS corners", f"cast({flat('flow', _MOVED)} as array<double>) AS flow")
    return _run(rows, FlowCorners(["clip_id"], slack, idle, least), f"clip_id long, frame_idx long, {_CORNER}")
