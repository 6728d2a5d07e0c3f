"""What leaves the engine: telemetry as JSON, output paths, draw lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.detections import frame
from . import documents, metrics


def output_path(path: Column, suffix: str) -> Column:
    """Folder/stem + suffix + extension; without an extension, .mp4."""
    folder, name = F.regexp_extract(path, "^(.*/)?([^/]*)$", 1), F.regexp_extract(path, "^(.*/)?([^/]*)$", 2)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    stem = F.when(ext == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(ext)))
    return F.concat(folder, stem, F.lit(suffix), F.when(ext == "", ".mp4").otherwise(ext))


def output_kind(path: Column) -> Column:
    """What a path asks for: telemetry as JSON, or a drawn video."""
    return F.when(F.endswith(path, F.lit(".json")), "json").otherwise("video")


def json_number(v: Column, digits: int = 2) -> Column:
    """A number with so many digits; null for what JSON can't hold."""
    v = v.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "null").otherwise(F.format_string(f"%.{digits}f", v))


def json_array(*values: Column) -> Column:
    """Boxes, points: numbers in brackets."""
    return F.concat(F.lit("["), F.concat_ws(",", *map(json_number, values)), F.lit("]"))


def telemetry_frames(tactical: DataFrame, fps: float = 25.0) -> DataFrame:
    """clip_id, frame_idx and each frame's JSON: its time, whether its homography is valid, and how many players of each team it shows."""
    line = F.concat(
        F.format_string('{"frame":%d,"timestamp":', "frame_idx"), json_number(F.col("frame_idx") / F.lit(fps), 3), F.lit(',"tactical":{"homography_valid":'), F.col("valid").cast("string"),
        F.format_string(',"num_team1":%d,"num_team2":%d}}', "num_team1", "num_team2"),
    )
    return tactical.select("clip_id", "frame_idx", line.alias("line"))


def _document(frames: DataFrame, videos: DataFrame, *more: str) -> DataFrame:
    """clip_id, at, value and what videos hold besides: the header's line, the frames in order, the end."""
    opening = videos.select("clip_id", F.lit(-1).cast("long").alias("at"), F.concat(F.expr("substring(header, 1, length(header) - 1)"), F.lit(',"frames":[')).alias("value"), *more)
    first = frames.groupBy("clip_id").agg(F.min("frame_idx").alias("first"))
    lines = frames.join(first, "clip_id").select("clip_id", F.col("frame_idx").alias("at"), F.concat(F.when(F.col("frame_idx") > F.col("first"), ",").otherwise(""), "line").alias("value"))
    if more:
        lines = lines.join(videos.select("clip_id", *more), "clip_id")
    closing = videos.select("clip_id", F.lit((1 << 63) - 1).cast("long").alias("at"), F.lit("]}").alias("value"), *more)
    return opening.unionByName(lines).unionByName(closing)


def telemetry_files(frames: DataFrame, videos: DataFrame, path: str) -> None:
    """Write each clip's telemetry below path as text, a folder a clip: the header's line (videos: clip_id, header as header() makes it), the frames in order, the end. Joined, they are one JSON document.

    Clips are sorted within tasks and streamed out; none is gathered in memory."""
    every = _document(frames, videos)
    every.repartition("clip_id").sortWithinPartitions("clip_id", "at").select("clip_id", "value").write.partitionBy("clip_id").text(path)


def telemetry_documents(frames: DataFrame, videos: DataFrame) -> dict[str, float]:
    """Write each clip's telemetry as one JSON document at its video's ``output`` (videos: clip_id, header, output), all of them or, where the job fails, none; the number of lines written, by the way."""
    seen = metrics.Watched(_document(frames, videos, "output"), F.col("at").between(0, (1 << 62)))
    documents.write(seen.frames)
    return {"frames": seen.summary()["ran"]}


def telemetry(counts: DataFrame, fps: float = 25.0) -> DataFrame:
    """frame_idx and a JSON line for each frame."""
    line = F.format_string('{"frame":%d,"timestamp":%s,"players":%d,"balls":%d,"referees":%d}', "frame_idx", F.format_string("%.3f", F.col("frame_idx") / F.lit(fps)), "players", "balls", "referees")
    return counts.select(*frame(counts), line.alias("line"))


def draw_list(boxes: DataFrame) -> DataFrame:
    """Ellipses at the feet of players and referees, triangles above balls, in whole pixels; z is the order of drawing."""
    cx = (F.col("x1") + F.col("x2")) / 2
    ball = F.col("class_id") == 1
    kind = F.when(ball, "triangle").otherwise("ellipse")
    y = F.when(ball, F.col("y1") - 10).otherwise(F.col("y2"))
    rx, ry = F.when(ball, 8).otherwise((0.5 * (F.col("x2") - F.col("x1"))).cast("int")), F.when(ball, 5).otherwise((0.15 * (F.col("y2") - F.col("y1"))).cast("int"))
    z = F.when(F.col("class_id") == 0, 0).when(ball, 2).otherwise(3)
    return boxes.select(*frame(boxes), "det_idx", kind.alias("kind"), cx.cast("int").alias("x"), y.cast("int").alias("y"), rx.cast("int").alias("rx"), ry.cast("int").alias("ry"), z.cast("int").alias("z"))


def json_escape(text: Column) -> Column:
    """Backslash, quote, line feed and tab, escaped; nothing else."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def header(path: Column, width: Column, height: Column, fps: Column, frames: Column) -> Column:
    """A video's JSON header; a frame rate of 0 or less counts as 30."""
    return F.format_string('{"video":{"path":"%s","width":%d,"height":%d,"fps":%.2f,"total_frames":%d}}', json_escape(path), width, height, F.when(fps > 0, fps).otherwise(30.0), frames)


def track_labels(boxes: DataFrame) -> DataFrame:
    """frame_idx, det_idx, label of boxes with a track_id of 0 or more."""
    return boxes.filter("track_id >= 0").select(*frame(boxes), "det_idx", F.concat(F.lit("#"), F.col("track_id").cast("string")).alias("label"))


#: Colours as blue, green, red.
GREEN, RED, BLUE, YELLOW = (0, 255, 0), (0, 0, 255), (255, 0, 0), (0, 255, 255)


def _colour(c: tuple[int, int, int]) -> Column:
    return F.array(*map(F.lit, c))


def annotations(players: DataFrame, balls: DataFrame, referees: DataFrame) -> DataFrame:
    """A frame's whole draw list, z in the order of drawing: players' ellipses (in their team's colour: class_id 1 is the second team), their tracks' labels, ball triangles, referees' ellipses.

    Players have a track_id; labels stand five pixels above the box, centred at x. points are a triangle's corners; radii an ellipse's."""
    keys = frame(players)
    cx, whole = (F.col("x1") + F.col("x2")) / 2, lambda v: v.cast("int")
    point = lambda x, y: F.struct(whole(x).alias("x"), whole(y).alias("y"))
    none = {"points": F.lit(None).cast("array<struct<x:int,y:int>>"), "rx": F.lit(None).cast("int"), "ry": F.lit(None).cast("int"), "text": F.lit(None).cast("string")}

    def shapes(df: DataFrame, kind: str, z: int, who: Column, x: Column, y: Column, colour: Column, **more: Column) -> DataFrame:
        return df.select(*keys, F.lit(z).alias("z"), who.cast("long").alias("who"), F.lit(kind).alias("kind"), whole(x).alias("x"), whole(y).alias("y"), colour.alias("colour"), *[(none | more)[k].alias(k) for k in none])

    size = {"rx": whole((F.col("x2") - F.col("x1")) * 0.5), "ry": whole((F.col("y2") - F.col("y1")) * 0.15)}
    top = F.col("y1") - 10
    corners = F.array(point(cx, top - 10), point(cx - 8, top + 5), point(cx + 8, top + 5))
    team = F.when(F.col("class_id") == 1, _colour(RED)).otherwise(_colour(GREEN))
    out = shapes(players, "ellipse", 0, F.col("track_id"), cx, F.col("y2"), team, **size)
    out = out.unionByName(shapes(players.filter("track_id >= 0"), "label", 1, F.col("track_id"), cx, F.col("y1") - 5, _colour((255, 255, 255)), text=F.concat(F.lit("#"), F.col("track_id").cast("string"))))
    out = out.unionByName(shapes(balls, "triangle", 2, F.lit(0), cx, top, _colour(RED), points=corners))
    return out.unionByName(shapes(referees, "ellipse", 3, F.col("referee_id"), cx, F.col("y2"), _colour(BLUE), **size))


def corner_marks(corners: DataFrame, least: float = 0.25) -> DataFrame:
    """What shows a frame's corners: a dot of radius 5 at each that is sure enough, and its class beside it."""
    x, y = F.col("x").cast("int"), F.col("y").cast("int")
    return corners.filter(F.col("conf") >= least).select(*frame(corners), "corner_idx", x.alias("x"), y.alias("y"), F.lit(5).alias("radius"), F.concat(F.lit("cls: "), F.col("class_id").cast("string")).alias("text"), (x + 8).alias("text_x"), (y - 8).alias("text_y"), _colour(YELLOW).alias("colour"))
