"""The tracker over a stream: the same Tracker as in batch, held as state by clip."""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracker import Tracker, features
from ..sources.package import ship

_COLS = ["frame_idx", "det_idx", "x1", "y1", "x2", "y2", "conf"]


def run(detections: DataFrame, stride: int = 1, whole_frames: bool = False, feature: str | None = None, idle: int | None = None) -> DataFrame:
    """clip_id, frame_idx, track_id, det_idx (-1 where predicted) of a stream of detections, as operators.tracker.run gives them in batch.

    A clip's frames may come in several batches. Its newest frame waits in state until a later one comes, since more of its rows may follow; ``whole_frames`` says that none do.
    Rows of frames that are already done come too late and go. State is a clip's tracker (at most as many tracks as its last frames had boxes) and one frame.
    ``feature`` is as in batch. A clip of which nothing has come for ``idle`` milliseconds has ended: its last frame comes out, and its state goes; without ``idle`` state stays."""
    cols = [*_COLS, *([feature] if feature else [])]

    empty = pd.DataFrame({c: pd.Series(dtype="int64" if c.endswith("idx") else "object" if c == feature else "float64") for c in cols})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, done, held = pickle.loads(state.get[0]) if state.exists else (Tracker(), None, None)
        ended = state.hasTimedOut
        rows = pd.concat([*([] if held is None else [held]), *(b[cols] for b in batches), empty], ignore_index=True)
        if done is not None:
            rows = rows[rows["frame_idx"] > done]
        out, held = [], None
        if len(rows):
            rows = rows.sort_values(["frame_idx", "det_idx"], kind="stable")
            first, last = (int(rows["frame_idx"].min()) if done is None else done + 1), int(rows["frame_idx"].max())
            if not whole_frames and not ended:
                held = rows[rows["frame_idx"] == last]
                last -= 1
            frames = {f: g for f, g in rows.groupby("frame_idx")}
            order, f = sorted(frames), first
            while f <= last:
                if f not in frames and not tracker.active and not tracker.lost:
                    # nothing lives: on to the next frame that has a box
                    k = bisect_right(order, f)
                    if k == len(order) or order[k] > last:
                        done = last
                        break
                    f = int(order[k])
                g = frames.get(f, rows.iloc[:0])
                ids = g["det_idx"].tolist()
                for i, k in tracker.update(g[["x1", "y1", "x2", "y2"]].to_numpy(float), g["conf"].to_numpy(float), features(g, feature), predicted=f % stride != 0):
                    out.append((key[0], f, i, ids[k] if k >= 0 else -1))
                done = f
                f += 1
        if ended:
            state.remove()
        else:
            state.update((pickle.dumps((tracker, done, held)),))
            if idle:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["clip_id", "frame_idx", "track_id", "det_idx"])

    ship(detections.sparkSession)
    return detections.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, frame_idx long, track_id int, det_idx int", "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
