"""Assembly of canonical tables from packs of rows, merges, and the rows of the vector index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import joins, quality

STAGES = ("video", "scene", "keyframe", "asr", "embedding", "color", "ocr", "object", "caption")


def stage_of(name: str) -> str | None:
    """The stage whose name a pack's name contains, the longest one."""
    return next((s for s in sorted(STAGES, key=len, reverse=True) if s in name.casefold()), None)


def discover(names: list[str]) -> dict[str, str]:
    """Stage -> pack; two packs of a stage are an error."""
    out: dict[str, str] = {}
    for n in names:
        if stage := stage_of(n):
            if stage in out:
                raise ValueError(f"two packs of stage {stage}: {out[stage]}, {n}")
            out[stage] = n
    return out


def assemble_scenes(rows: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenes from rows (video_id, scene_index, start_frame, end_frame inclusive, any type): renumbered in time, bounds clamped to the video.

    Rejected rows keep their number, so that the numbers of the others have gaps.
    """
    typed = rows.select("video_id", *[F.try_to_number(F.col(c).cast("string"), F.lit("999999999999")).cast("long").alias(c) for c in ("scene_index", "start_frame", "end_frame")])
    known = videos.groupBy("video_id").agg(F.max("fps").alias("fps"), F.max("frame_count").alias("frame_count"))
    met = typed.join(known, "video_id", "left").withColumn("end_frame_exclusive", F.least(F.col("end_frame") + 1, F.col("frame_count")))
    numbered = met.withColumn("scene_idx", F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame", "scene_index")) - 1)
    good, bad = quality.quarantine(
        numbered,
        {"unreadable": F.col("start_frame").isNull() | F.col("end_frame").isNull(), "unknown_video": F.col("frame_count").isNull(), "empty": F.col("end_frame_exclusive") <= F.greatest("start_frame", F.lit(0))},
    )
    start = F.greatest("start_frame", F.lit(0))
    out = good.select(
        F.format_string("%s_S%04d", "video_id", "scene_idx").alias("scene_id"), "video_id", "scene_idx", start.alias("start_frame"), "end_frame_exclusive",
        F.round(start / F.col("fps"), 6).alias("start_sec"), F.round(F.col("end_frame_exclusive") / F.col("fps"), 6).alias("end_sec"),
    )
    return out, bad.select("video_id", "scene_index", "start_frame", "end_frame", "reason")


def assemble_keyframes(rows: DataFrame, scenes: DataFrame, videos: DataFrame, packs: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Keyframes (video_id, frame_idx) placed in scenes, timed by the frame rate, with the packs' columns; and all rejected rows."""
    merged, duplicates = joins.merge_by_key(rows, packs, ["video_id", "frame_idx"], "row")
    keyed = merged.withColumn("keyframe_id", F.concat_ws("|", "video_id", "frame_idx"))
    placed, left = joins.keyframes_in_scenes(keyed, scenes)
    fps = videos.groupBy("video_id").agg(F.max("fps").alias("fps"))
    out = keyed.join(placed.select("keyframe_id", F.col("in_scene").alias("scene_id")), "keyframe_id").join(fps, "video_id")
    out = out.withColumn("keyframe_id", F.format_string("%s_F%06d", "scene_id", "frame_idx")).withColumn("timestamp_sec", F.round(F.col("frame_idx") / F.col("fps"), 6)).drop("fps")
    rejected = left.select(F.lit("keyframe").alias("pack"), "video_id", "frame_idx", F.lit("in no scene").alias("reason"))
    return out, rejected if duplicates is None else rejected.unionByName(duplicates)


def merge_captions(scenes: DataFrame, captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenes with imported captions (scene_id, text, language) appended, and the captions of unknown scenes."""
    known = captions.join(scenes.select("scene_id"), "scene_id", "left_semi")
    packed = known.groupBy("scene_id").agg(F.array_sort(F.collect_set("text")).alias("imported"))
    return scenes.join(packed, "scene_id", "left").withColumn("imported", F.coalesce("imported", F.array().cast("array<string>"))), captions.join(scenes.select("scene_id"), "scene_id", "left_anti")


def scene_keywords(objects: DataFrame) -> DataFrame:
    """(scene_id, keyword): the distinct labels of a scene's objects (scene_id, label) in lower case."""
    return objects.select("scene_id", T.lower(F.trim("label")).alias("keyword")).where("keyword <> ''").distinct()


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources in order of priority; of each key the first source counts."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn("__p", F.lit(i)) for i, s in enumerate(sources)])
    w = Window.partitionBy(key).orderBy("__p")
    return tagged.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__p")


def merge_identical(df: DataFrame, key: str) -> DataFrame:
    """One row per key where all rows of the key are equal; keys whose rows differ are left to ``quality.conflicting_keys``."""
    content = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    same = df.groupBy(key).agg(F.countDistinct(content).alias("n")).where("n = 1").select(key)
    return df.join(same, key, "left_semi").dropDuplicates([key])


def replace_artifact(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest with the artifacts of ``new`` in place of those of the same backend and name."""
    return manifest.join(new.select("backend", "name"), ["backend", "name"], "left_anti").unionByName(new)


def to_enrich(items: DataFrame, cache: DataFrame, content: list[str]) -> DataFrame:
    """Items whose content (hashed) isn't in the cache (content_hash) yet."""
    return items.withColumn("content_hash", F.sha2(F.concat_ws("\x1f", *content), 256)).join(cache.select("content_hash"), "content_hash", "left_anti")


def quality_state(errors: str = "errors", warnings: str = "warnings") -> tuple:
    """State and weight of a record by its numbers of errors and warnings."""
    state = F.when(F.col(errors) > 0, "invalid").when(F.col(warnings) > 0, "needs_review").otherwise("passed")
    return state, F.when(state == "passed", 1.0).when(state == "needs_review", 0.75).otherwise(0.0)
