"""The whole dataflow, from detections, corners and their flow to tracks, pitch positions and telemetry, as one plan of lazy tables.

Inputs are what the models and optical flow give, for any number of clips:

    detections  clip_id, frame_idx, det_idx, class_id (0 player, 1 ball, 2 referee), conf, x1, y1, x2, y2, feature array<double> (null where there is none)
    corners     clip_id, frame_idx, corner_idx, class_id, x, y, conf: what the corner detector would find in each frame
    flow        clip_id, frame_idx, corner_idx, x, y, error, status: where the corners in use have moved since the frame before
    frames      clip_id, frame_idx: the spine, all frames of all clips
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import detections as d
from .operators import homography, pitch, sequences, teams, tracker
from .sources import metrics, sinks
from .sources.shared import kept


@dataclass
class Analysis:
    """players: clip_id, frame_idx, track_id, class_id (the team), box; balls: all of each frame, as last seen; ball_path: the best of them, interpolated (for drawing alone); referees: as last seen, with referee_id; tactical:
    counts and homography of each frame; points: all of them on the pitch; models: the clips' team models."""

    players: DataFrame
    balls: DataFrame
    ball_path: DataFrame
    referees: DataFrame
    corners: DataFrame
    tactical: DataFrame
    points: DataFrame
    models: DataFrame
    fps: float = 25.0
    stride: int = 2

    def telemetry(self) -> DataFrame:
        return sinks.telemetry_frames(self.tactical, self.fps)

    def drawing(self) -> DataFrame:
        players, _, referees = store_tracks(self.players, self.balls, self.referees)
        return sinks.annotations(players, self.ball_path, referees)

    def write(self, path: str, videos: DataFrame) -> None:
        """By the path's ending: telemetry as JSON text, or the draw list that a renderer takes, as Parquet. videos: clip_id, path, width, height, total_frames."""
        if path.endswith(".json"):
            sinks.telemetry_files(self.telemetry(), self._headed(videos), path)
        else:
            self.drawing().write.parquet(path)

    def write_documents(self, videos: DataFrame, suffix: str = "_out") -> dict[str, float]:
        """Each clip's telemetry as one JSON document: at ``output``, if videos have it, else beside the video, named after it. Returns how many frames were written."""
        if "output" not in videos.columns:
            videos = videos.withColumn("output", F.regexp_replace(sinks.output_path(F.col("path"), suffix), r"\.[^./]*$", ".json"))
        return sinks.telemetry_documents(self.telemetry(), self._headed(videos, "output"))

    def timed(self, times: DataFrame, **stages: str) -> metrics.Watched:
        """The frames' telemetry, watched: writing ``.frames`` anywhere adds up how many there are, in how many the detector ran, and the milliseconds of each stage (columns of times, which has clip_id, frame_idx; a frame without any took none)."""
        both = self.telemetry().join(times.select("clip_id", "frame_idx", *[F.col(c).alias(f"{k}_time") for k, c in stages.items()]), ["clip_id", "frame_idx"], "left")
        return metrics.Watched(both, F.col("frame_idx") % self.stride == 0, {k: F.col(f"{k}_time") for k in stages})

    def _headed(self, videos: DataFrame, *more: str) -> DataFrame:
        header = sinks.header(F.col("path"), F.col("width"), F.col("height"), F.lit(self.fps), F.col("total_frames"))
        return videos.select("clip_id", header.alias("header"), *more)


def store_tracks(players: DataFrame, balls: DataFrame, referees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is kept of a frame: the last box of each track of 0 or more, the best ball that has an area, and referees by ordinal."""
    keys = d.frame(players)
    # predicted boxes have no place of their own: they come before all that do
    placed = players.withColumn("det_idx", F.coalesce("det_idx", F.lit(-1)))
    last = d.last_by_track(placed)
    best = d.best_ball(d.valid_balls(balls))
    kept = placed.join(last, [*keys, "track_id", "det_idx"], "left_semi").withColumn("det_idx", F.nullif("det_idx", F.lit(-1)))
    return kept, best, referees.drop("referee_id").join(d.referee_ordinals(referees), [*keys, "det_idx"])


def analyze(detections: DataFrame, corners: DataFrame, flow: DataFrame, frames: DataFrame, models: DataFrame | None = None, fps: float = 25.0, stride: int = 2, interval: int = 15) -> Analysis:
    """The analysis of all clips. Boxes are looked at in each ``stride``-th frame. models: the clips' team models (teams.fit_by_clip); each clip is judged by its own, and without ``models`` they are fitted on these detections.

    What several steps read (boxes, tracks, players, sets carried forward, homographies) is computed once and kept in the shared folder."""
    keys = ["clip_id", "frame_idx"]
    looked = detections.filter(F.col("frame_idx") % stride == 0)
    boxes = kept(d.nms(looked))
    # tracks, with their predicted boxes in the frames between
    people = boxes.filter(F.col("class_id") == d.PLAYER).join(looked.select(*keys, "det_idx", "feature"), [*keys, "det_idx"])
    people = kept(people)
    models = teams.fit_by_clip(people) if models is None else models
    ends = frames.groupBy("clip_id").agg(F.max("frame_idx").alias("last"))
    tracked = tracker.run(people.join(ends, "clip_id"), stride=stride, feature="feature", boxes=True, last="last")
    judged = teams.predict_by_clip(people, models)
    seen = tracked.join(judged, [*keys, "det_idx"], "left").withColumn("class_id", F.lit(d.PLAYER))
    # a track votes on what it is in the frames in which it is found, and keeps that in between
    votes = seen.filter("det_idx IS NOT NULL").select("clip_id", "track_id", F.col("frame_idx").alias("seq"), (F.col("class_id") == d.REFEREE).cast("int").alias("vote"))
    roles = sequences.role(votes).select("clip_id", "track_id", F.col("seq").alias("frame_idx"), "is_referee")
    seen = seen.join(roles, [*keys, "track_id"], "left").withColumn("class_id", F.when(F.col("is_referee"), d.REFEREE).otherwise(F.col("class_id"))).drop("is_referee")
    # only frames that were looked at vote; the others keep the label. Who has none yet stays of class 0, which is the first team's
    labels = sequences.team_labels(seen).filter("team >= 0")
    players = kept(d.with_teams(seen.drop("predicted"), labels))
    # balls of close-ups need more confidence; all balls, and all referees, of the last frame that was looked at
    looks = kept(sequences.last_look(frames, frames.filter(F.col("frame_idx") % stride == 0)))
    balls = kept(d.carried(d.closeup_filter(boxes), looks, boxed=True))
    referees = d.carried(boxes.filter(F.col("class_id") == d.REFEREE), looks, boxed=True)
    referees = kept(referees.join(d.referee_ordinals(referees), [*keys, "det_idx"]))
    path = sequences.interpolate_boxes(d.best_ball(d.valid_balls(balls)))
    # corners: detected now and then, moved along by flow in between; one homography a frame
    counted = frames.join(sequences.visible(corners), keys, "left").na.fill(0, ["n_corners", "n_visible"])
    cached = sequences.corner_cache(counted, interval).select(*keys, "from_frame")
    held = cached.join(corners.withColumnRenamed("frame_idx", "from_frame"), ["clip_id", "from_frame"], "left")
    used = sequences.flow_corners(held.select(*keys, "corner_idx", "class_id", "x", "y", "conf"), flow)
    fits = frames.join(homography.fit(used), keys, "left")
    smooth = kept(homography.smooth(fits.select(*keys, "h")))
    counts = d.team_counts(frames, players, balls, referees).join(smooth, keys)
    who = ["clip_id", "frame_idx", "det_idx", "class_id", "x1", "y1", "x2", "y2"]
    # roles on the pitch: 0 and 1 are teams, 2 balls, 3 referees
    everyone = players.filter("class_id IN (0, 1)").select(*[F.col("track_id").alias(c) if c == "det_idx" else c for c in who], F.col("class_id").alias("role"))
    for df, role, ident in ((balls, 2, F.col("det_idx")), (referees, 3, F.col("referee_id"))):
        everyone = everyone.unionByName(df.select(*[ident.cast("int").alias(c) if c == "det_idx" else F.col(c).cast("int") if c == "class_id" else c for c in who], F.lit(role).alias("role")))
    points = pitch.tactical(everyone.withColumn("class_id", F.when(F.col("role") == 2, 1).when(F.col("role") == 3, 2).otherwise(0)).withColumn("det_idx", F.col("role") * 1_000_000 + F.col("det_idx")), smooth)
    points = points.select("clip_id", "frame_idx", F.floor(F.col("det_idx") / 1_000_000).cast("int").alias("role"), (F.col("det_idx") % 1_000_000).alias("id"), "x", "y")
    return Analysis(players, balls, path, referees, used, counts, points, models, fps, stride)
