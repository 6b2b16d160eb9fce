"""Join-shaped operators on media time: containment, overlap, nearest, neighbours, ordered steps.

Range conditions get an equi-key, a bucket of the time axis, so that no pair of rows meets that lies far apart
and a long video is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: float) -> Column:
    """The buckets that [start, end] touches."""
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(F.greatest(start, end) / width).cast("long")))


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, width: float, closed: bool = False) -> DataFrame:
    """Points with the intervals that hold them; [start, end), or [start, end] if closed. Columns of both sides."""
    p = points.withColumn("__b", F.floor(F.col(point) / width).cast("long"))
    i = intervals.withColumn("__b", _buckets(F.col(start), F.col(end), width)).withColumnRenamed(key, "__k")
    upper = F.col(point) <= F.col(end) if closed else F.col(point) < F.col(end)
    return p.join(i, (p[key] == i["__k"]) & (p["__b"] == i["__b"]) & (F.col(point) >= F.col(start)) & upper).drop("__b", "__k")


def overlaps(left: DataFrame, right: DataFrame, key: str, ls: str, le: str, rs: str, re: str, width: float) -> DataFrame:
    """Pairs of intervals of one key that overlap (greater start < smaller end), each once."""
    a = left.withColumn("__b", _buckets(F.col(ls), F.col(le), width))
    b = right.withColumn("__b", _buckets(F.col(rs), F.col(re), width)).withColumnRenamed(key, "__k").withColumnRenamed("__b", "__b2")
    low = F.greatest(ls, rs)
    # a pair meets in each bucket that both touch; it counts in the one where the overlap starts
    return a.join(b, (a[key] == b["__k"]) & (F.col("__b") == F.col("__b2"))).where((low < F.least(le, re)) & (F.col("__b") == F.floor(low / width).cast("long"))).drop("__b", "__b2", "__k")


def clip_overlaps(segments: DataFrame, scenes: DataFrame, width: float = 60.0) -> DataFrame:
    """Speech segments (video_id, seg_start, seg_end, text, segment_id) cut at scenes (video_id, scene_id, start_sec, end_sec) and numbered in each."""
    spoken = segments.where("trim(text) <> ''")
    met = overlaps(spoken, scenes, "video_id", "seg_start", "seg_end", "start_sec", "end_sec", width)
    clipped = met.select("video_id", "scene_id", "segment_id", "text", F.greatest("seg_start", "start_sec").alias("clip_start"), F.least("seg_end", "end_sec").alias("clip_end"))
    return clipped.withColumn("number", F.row_number().over(Window.partitionBy("scene_id").orderBy("clip_start", "clip_end", "segment_id")) - 1)


def aligned(segments: DataFrame, scenes: DataFrame, width: float = 60.0) -> DataFrame:
    """(segment_id, scene_id): scenes that share enough of a segment's time; failing that, the first that holds its middle.

    Enough is a tenth of the segment, but at least 0.05 s and at most 0.75 s.
    """
    length = F.col("seg_end") - F.col("seg_start")
    enough = F.least(F.lit(0.75), F.greatest(F.lit(0.05), 0.1 * length))
    met = overlaps(segments, scenes, "video_id", "seg_start", "seg_end", "start_sec", "end_sec", width)
    main = met.where(F.least("seg_end", "end_sec") - F.greatest("seg_start", "start_sec") >= enough).select("segment_id", "scene_id", F.lit("overlap").alias("how"))
    rest = segments.join(main.select("segment_id").distinct(), "segment_id", "left_anti").withColumn("middle", (F.col("seg_start") + F.col("seg_end")) / 2)
    held = point_in_interval(rest, scenes, "video_id", "middle", "start_sec", "end_sec", width)
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("segment_id").orderBy("start_sec", "scene_id"))).where("r = 1")
    return main.unionByName(first.select("segment_id", "scene_id", F.lit("middle").alias("how")))


def keyframes_in_scenes(keyframes: DataFrame, scenes: DataFrame, width: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """Each keyframe (keyframe_id, video_id, frame_idx) with the first scene whose [start_frame, end_frame_exclusive) holds it, and those left over."""
    frames = keyframes.select("keyframe_id", "video_id", "frame_idx")
    spans = scenes.select("video_id", F.col("scene_id").alias("in_scene"), "start_frame", "end_frame_exclusive")
    held = point_in_interval(frames, spans, "video_id", "frame_idx", "start_frame", "end_frame_exclusive", width)
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("keyframe_id").orderBy("start_frame", "in_scene"))).where("r = 1").drop("r")
    return first, frames.join(first.select("keyframe_id"), "keyframe_id", "left_anti")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, other_at: str, most: float, tie: str) -> DataFrame:
    """Each left row with the nearest right row of its key at a distance of at most ``most``; ties by ``tie``. Needs a column ``left_id``."""
    a = left.withColumn("__b", F.explode(F.sequence(F.floor((F.col(at) - most) / most).cast("long"), F.floor((F.col(at) + most) / most).cast("long"))))
    b = right.withColumn("__b", F.floor(F.col(other_at) / most).cast("long"))
    gap = F.abs(F.col(at) - F.col(other_at))
    met = a.join(b, [key, "__b"]).where(gap <= most).withColumn("gap", gap)
    return met.withColumn("__r", F.row_number().over(Window.partitionBy("left_id").orderBy("gap", tie))).where("__r = 1").drop("__r", "__b")


def neighbours(scenes: DataFrame, columns: list[str]) -> DataFrame:
    """Each scene with the given columns of the scenes just before and after by number; a gap in the numbers has no neighbour."""
    side = lambda step, name: scenes.select("video_id", (F.col("scene_idx") - step).alias("scene_idx"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return scenes.join(side(-1, "previous"), ["video_id", "scene_idx"], "left").join(side(1, "next"), ["video_id", "scene_idx"], "left")


def merge_by_key(base: DataFrame, packs: dict[str, DataFrame], keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The base left-joined with packs of further columns; of rows with one key the first counts, the others are (pack, *keys, reason)."""
    rejected = None
    for name, pack in packs.items():
        numbered = pack.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        base = base.join(numbered.where("__r = 1").drop("__r", order), keys, "left")
        bad = numbered.where("__r > 1").select(F.lit(name).alias("pack"), *keys, F.lit("duplicate key").alias("reason"))
        rejected = bad if rejected is None else rejected.unionByName(bad)
    return base, rejected
