"""Windows over media time: clips, events, buckets, uniform scenes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .blocked import blocked_cumsum, blocked_last

STRIDE, LENGTH, SHORTEST = 2.0, 4.0, 1.0
EVENT_GAP, EVENT_LONGEST = 2.0, 60.0


def clip_windows(scenes: DataFrame, stride: float = STRIDE, length: float = LENGTH, shortest: float = SHORTEST) -> DataFrame:
    """(scene_id, video_id, number, start_sec, end_sec): windows of ``length`` every ``stride`` until one reaches the end of the scene.

    A last window shorter than ``shortest`` is merged into the one before.
    """
    span = F.col("end_sec") - F.col("start_sec")
    count = F.greatest(F.lit(1), F.ceil(F.round((span - length) / stride, 9)) + 1).cast("int")
    each = scenes.where("end_sec > start_sec").select("scene_id", "video_id", F.col("start_sec").alias("s0"), F.col("end_sec").alias("e0"), count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("number"))
    start = F.col("s0") + F.col("number") * stride
    last_start = F.col("s0") + (F.col("n") - 1) * stride
    merged = (F.col("n") > 1) & (F.col("e0") - last_start < shortest)
    kept = each.where(~(merged & (F.col("number") == F.col("n") - 1)))
    is_last = F.col("number") == F.col("n") - 1 - F.when(merged, 1).otherwise(0)
    return kept.select("scene_id", "video_id", "number", F.round(start, 6).alias("start_sec"), F.round(F.when(is_last, F.col("e0")).otherwise(F.least(start + length, F.col("e0"))), 6).alias("end_sec"))


def seconds_to_frame(sec: Column, fps: Column) -> Column:
    """Half to even, as the frame numbers of clips are rounded."""
    return F.bround(sec * fps, 0).cast("long")


def _block(start: str) -> Column:
    """Ten minutes of media time: what windows are scanned in, so that no video is one task."""
    return F.floor(F.col(start) / 600)


def _with_openers(df: DataFrame, key: str, start: str, end: str, gap: float, order: list[str]) -> DataFrame:
    """Adds ``__opens``: 1 where an interval is the first of its key, or starts more than ``gap`` after the end of the one before."""
    seen = blocked_last(df, [key], order, end, "__before", _block(start), inclusive=False)
    return seen.withColumn("__opens", F.when(F.col("__before").isNull() | (F.col(start) - F.col("__before") > gap), 1).otherwise(0)).drop("__before")


def session_groups(df: DataFrame, key: str, start: str, end: str, gap: float, order: list[str]) -> DataFrame:
    """Adds ``group``: intervals of a key follow each other in a group while the gap to the one before is at most ``gap``. ``order`` begins with ``start`` and is total."""
    opened = _with_openers(df, key, start, end, gap, order)
    return blocked_cumsum(opened, [key], order, "__opens", "group", _block(start)).withColumn("group", F.col("group") - 1).drop("__opens")


_SCENE = "video_id string, event_idx int, scene_id string, scene_idx int, start_sec double, end_sec double"


def event_groups(scenes: DataFrame, gap: float = EVENT_GAP, longest: float = EVENT_LONGEST) -> DataFrame:
    """(video_id, event_idx, scene_id, scene_idx, start_sec, end_sec): scenes in order, in groups without a gap above ``gap`` that last at most ``longest``.

    The length makes the grouping depend on the path: a group starts at the first scene that doesn't fit into the one
    before. Blocks of ten minutes are tasks of their own nevertheless. What a block does depends only on the start of the
    group that is open when it begins, and that start is less than ``longest`` old; so each block first tells, for every
    scene that may be the first not to fit, how many groups follow and which is open at its end. These short summaries
    are walked in order, a video at a time, and give each block its open group, with which its scenes are numbered.

    Scenes without video, start or end are left out.
    """
    rows = scenes.select("video_id", "scene_id", F.col("scene_idx").cast("int").alias("scene_idx"), "start_sec", "end_sec").where("video_id is not null and start_sec is not null and end_sec is not null")
    order = ["start_sec", "scene_idx", "scene_id"]
    rows = checkpoint(_with_openers(rows, "video_id", "start_sec", "end_sec", gap, order).withColumn("block", _block("start_sec")))

    def ordered(t: pa.Table) -> pa.Table:
        return t.sort_by([(c, "ascending") for c in order])

    def summary(t: pa.Table) -> pa.Table:
        t = ordered(t)
        start, end, opens = (t[c].to_pylist() for c in ("start_sec", "end_sec", "__opens"))
        n = len(start)
        last, count = [0.0] * n, [0] * n
        for i in reversed(range(n)):
            j = i + 1
            while j < n and not opens[j] and end[j] - start[i] <= longest:
                j += 1
            last[i], count[i] = (start[i], 1) if j == n else (last[j], 1 + count[j])
        records, high = [], float("-inf")
        for j in range(n):
            reach = float("inf") if opens[j] else end[j]
            if reach > high:
                high = reach
                records.append({"reach": high, "last": last[j], "count": count[j]})
            if high - start[0] > longest:
                break  # no group that was open before the block goes beyond this scene
        return pa.table({"video_id": [t["video_id"][0].as_py()], "block": [t["block"][0].as_py()], "records": pa.array([records], pa.list_(pa.struct([("reach", pa.float64()), ("last", pa.float64()), ("count", pa.int32())])))})

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        open_, total, out = None, 0, []
        for records in t["records"].to_pylist():
            out.append((open_, total))
            hit = next((r for r in records if open_ is None or r["reach"] - open_ > longest), None)
            if hit:
                open_, total = hit["last"], total + hit["count"]
        return pa.table({"video_id": t["video_id"], "block": t["block"], "open": pa.array([x for x, _ in out], pa.float64()), "before": pa.array([x for _, x in out], pa.int32())})

    def number(t: pa.Table) -> pa.Table:
        t = ordered(t)
        open_, idx, out = t["open"][0].as_py(), t["before"][0].as_py() - 1, []
        for start, end, opens in zip(*(t[c].to_pylist() for c in ("start_sec", "end_sec", "__opens"))):
            if opens or open_ is None or end - open_ > longest:
                open_, idx = start, idx + 1
            out.append(idx)
        return pa.table({"video_id": t["video_id"], "event_idx": pa.array(out, pa.int32()), **{c: t[c] for c in ("scene_id", "scene_idx", "start_sec", "end_sec")}})

    blocks = rows.groupBy("video_id", "block").applyInArrow(summary, "video_id string, block bigint, records array<struct<reach:double,last:double,count:int>>")
    entries = blocks.groupBy("video_id").applyInArrow(walk, "video_id string, block bigint, open double, before int")
    return rows.join(entries, ["video_id", "block"]).groupBy("video_id", "block").applyInArrow(number, _SCENE)


def event_table(groups: DataFrame) -> DataFrame:
    """One row per event with its bounds, scenes in order, and the events before and after."""
    out = groups.groupBy("video_id", "event_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "scene_idx", "scene_id"))), lambda s: s["scene_id"]).alias("scene_ids"),
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"),
    )
    out = out.withColumn("event_id", F.format_string("%s_E%04d", "video_id", "event_idx"))
    w = Window.partitionBy("video_id").orderBy("event_idx")
    return out.withColumns({"previous_event_id": F.lag("event_id").over(w), "next_event_id": F.lead("event_id").over(w)})


def uniform_scenes(videos: DataFrame, seconds: float = 8.0) -> DataFrame:
    """(video_id, number, start_sec, end_sec): scenes of one length, the last one shorter."""
    n = F.ceil(F.round(F.col("duration_sec") / seconds, 9)).cast("int")
    each = videos.where("duration_sec > 0").select("video_id", "duration_sec", F.explode(F.sequence(F.lit(0), n - 1)).alias("number"))
    return each.select("video_id", "number", (F.col("number") * seconds).alias("start_sec"), F.round(F.least((F.col("number") + 1) * seconds, F.col("duration_sec")), 6).alias("end_sec"))


def clip_frames(clips: DataFrame, keyframes: DataFrame, most: int = 4, reach: float = 6.0) -> DataFrame:
    """(scene_id, number, keyframe_id, how, gap): the first frames in each clip's window, else the nearest one of its scene within ``reach``."""
    met = clips.join(keyframes.select("scene_id", "keyframe_id", "timestamp_sec"), "scene_id")
    inside = (F.col("timestamp_sec") >= F.col("start_sec")) & (F.col("timestamp_sec") < F.col("end_sec"))
    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    by = Window.partitionBy("scene_id", "number")
    ranked = met.withColumn("inside", inside).withColumn("gap", F.round(F.abs(F.col("timestamp_sec") - middle), 6)).withColumn("any", F.max(F.col("inside").cast("int")).over(by))
    a = ranked.where("inside").withColumn("r", F.row_number().over(by.orderBy("timestamp_sec", "keyframe_id"))).where(F.col("r") <= most).select("scene_id", "number", "keyframe_id", F.lit("window").alias("how"), F.lit(0.0).alias("gap"))
    b = ranked.where((F.col("any") == 0) & (F.col("gap") <= reach)).withColumn("r", F.row_number().over(by.orderBy("gap", "timestamp_sec", "keyframe_id"))).where("r = 1")
    return a.unionByName(b.select("scene_id", "number", "keyframe_id", F.lit("nearest").alias("how"), "gap"))
