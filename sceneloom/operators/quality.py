"""Integrity checks: every check gives its violations as (check, table, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocked import blocked_last

#: Frames of a block of scenes that are checked in order.
FRAMES = 15_000
# Formats of ids.
ID_FORMATS = {"video_id": r"^L\d{2}_V\d{3}$", "scene_id": r"^L\d{2}_V\d{3}_S\d{4,}$", "keyframe_id": r"^L\d{2}_V\d{3}_S\d{4,}_F\d{6,}$"}


def failing(df: DataFrame, check: str, table: str, key: str, bad: Column) -> DataFrame:
    return df.where(bad).select(F.lit(check).alias("check"), F.lit(table).alias("table"), F.col(key).cast("string").alias("key"))


def id_format(df: DataFrame, table: str, key: str) -> DataFrame:
    return failing(df, "id_format", table, key, ~F.coalesce(F.col(key).rlike(ID_FORMATS[key]), F.lit(False)))


def duplicate_keys(df: DataFrame, table: str, key: str) -> DataFrame:
    """Keys of several rows, each once."""
    return failing(df.groupBy(key).count(), "duplicate_key", table, key, F.col("count") > 1)


def conflicting_keys(df: DataFrame, table: str, key: str, content: list[str]) -> DataFrame:
    """Keys whose rows differ in content; equal rows are one delivered twice and do no harm."""
    return failing(df.groupBy(key).agg(F.countDistinct(F.to_json(F.struct(*content))).alias("n")), "conflicting_rows", table, key, F.col("n") > 1)


def scene_checks(scenes: DataFrame, videos: DataFrame) -> DataFrame:
    """Interval order, child ids derived from the parent, overlap and gaps of successive scenes, scenes beyond the video's end."""
    # blocks of some minutes of frames, so that no video is one task
    chained = blocked_last(scenes.where("video_id is not null and start_frame is not null"), ["video_id"], ["start_frame", "scene_idx", "scene_id"], "end_frame_exclusive", "before", F.floor(F.col("start_frame") / FRAMES), inclusive=False)
    length = videos.groupBy("video_id").agg(F.max("frame_count").alias("frame_count"))
    bounded = scenes.join(length, "video_id", "left")
    return reduce(
        DataFrame.unionByName,
        [
            failing(scenes, "frame_interval", "scenes", "scene_id", F.col("end_frame_exclusive") <= F.col("start_frame")),
            failing(scenes, "time_interval", "scenes", "scene_id", F.col("end_sec") <= F.col("start_sec")),
            failing(scenes, "derived_id", "scenes", "scene_id", F.col("scene_id") != F.format_string("%s_S%04d", "video_id", "scene_idx")),
            failing(chained, "overlap", "scenes", "scene_id", F.col("start_frame") < F.col("before")),
            failing(chained, "gap", "scenes", "scene_id", F.col("start_frame") > F.col("before")),
            failing(bounded, "beyond_video", "scenes", "scene_id", F.col("end_frame_exclusive") > F.col("frame_count")),
            failing(bounded, "unknown_video", "scenes", "scene_id", F.col("frame_count").isNull()),
        ],
    )


def keyframe_checks(keyframes: DataFrame, scenes: DataFrame) -> DataFrame:
    """Keyframes outside their scene, of an unknown scene, with degenerate boxes, with a time that doesn't fit the frame number."""
    met = keyframes.join(scenes.select("scene_id", "start_frame", "end_frame_exclusive"), "scene_id", "left")
    boxes = F.exists("objects", lambda o: (o["bbox"]["x2"] <= o["bbox"]["x1"]) | (o["bbox"]["y2"] <= o["bbox"]["y1"]))
    return reduce(
        DataFrame.unionByName,
        [
            failing(met, "outside_scene", "keyframes", "keyframe_id", (F.col("frame_idx") < F.col("start_frame")) | (F.col("frame_idx") >= F.col("end_frame_exclusive"))),
            failing(met, "unknown_scene", "keyframes", "keyframe_id", F.col("start_frame").isNull()),
            failing(keyframes, "degenerate_box", "keyframes", "keyframe_id", F.coalesce(boxes, F.lit(False))),
        ],
    )


def video_checks(videos: DataFrame) -> DataFrame:
    """Duration that doesn't fit frames and rate, within the larger of 0.1 s and two frames."""
    off = F.abs(F.col("duration_sec") - F.col("frame_count") / F.col("fps")) > F.greatest(F.lit(0.1), 2 / F.col("fps"))
    return failing(videos, "duration", "videos", "video_id", (F.col("fps") <= 0) | off)


def speech_checks(segments: DataFrame) -> DataFrame:
    """Segments (segment_id, scene_id, seg_start, seg_end, start_sec, end_sec): reversed, or outside their scene."""
    return failing(segments, "speech_interval", "asr_segments", "segment_id", F.col("seg_end") <= F.col("seg_start")).unionByName(
        failing(segments, "speech_outside_scene", "asr_segments", "segment_id", (F.col("seg_start") < F.col("start_sec")) | (F.col("seg_end") > F.col("end_sec")))
    )


def quarantine(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that break no rule, and the others with the first rule that they break as ``reason``."""
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in reasons.items()])
    marked = df.withColumn("reason", first)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def normalized_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners sorted and clamped to 0..1; null if nothing is left."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    a, b, c, d = clamp(F.least(x1, x2)), clamp(F.least(y1, y2)), clamp(F.greatest(x1, x2)), clamp(F.greatest(y1, y2))
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))
