"""Figures of a run, gathered while it runs: rows on their way to a sink are counted by the tasks that write them, so there is no second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def figures(ran: Column, times: dict[str, Column]) -> list[Column]:
    """frames, ran (frames in which the detector ran), and each stage's milliseconds: what is added up."""
    return [F.count("*").alias("frames"), F.count_if(ran).alias("ran"), *[F.sum(F.coalesce(v.cast("double"), F.lit(0.0))).alias(f"{k}_ms") for k, v in times.items()], *[F.sum(F.when(ran, v.cast("double")).otherwise(0.0)).alias(f"{k}_ran_ms") for k, v in times.items()]]


def summary(found: dict) -> dict[str, float]:
    """Sums, and means by both denominators: over all frames, and over those in which the detector ran. Empty runs give 0."""
    out = {k: v or 0 for k, v in found.items()}
    mean = lambda total, n: total / n if n else 0.0
    stages = [k.removesuffix("_ran_ms") for k in out if k.endswith("_ran_ms")]
    return out | {f"{k}_per_frame": mean(out[f"{k}_ms"], out["frames"]) for k in stages} | {f"{k}_per_run": mean(out[f"{k}_ran_ms"], out["ran"]) for k in stages}


class Watched:
    """A relation of frames whose figures are known once an action has run over it."""

    def __init__(self, frames: DataFrame, ran: Column, times: dict[str, Column] | None = None):
        self._seen = Observation()
        self.frames = frames.observe(self._seen, *figures(ran, times or {}))

    def summary(self) -> dict[str, float]:
        return summary(self._seen.get)


class Progress(StreamingQueryListener):
    """The same of streams: add it to spark.streams. Frames are observed as ``name`` (stream.observe(name, *figures(...))); total() holds what all batches so far add up to, and ``tell`` is called with it after each."""

    def __init__(self, name: str, tell=None):
        self.name, self.tell, self._sums = name, tell, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            for k, v in row.asDict().items():
                self._sums[k] = self._sums.get(k, 0) + (v or 0)
            if self.tell:
                self.tell(self.total())

    def total(self) -> dict[str, float]:
        return summary({"frames": 0, "ran": 0} | self._sums)
