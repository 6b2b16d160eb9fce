"""Tables of the project as query-time relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order))
    return df.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _texts(items: str | Column, field: str = "text") -> Column:
    """Texts of an array of structs, without nulls and blanks."""
    c = F.col(items) if isinstance(items, str) else items
    return F.filter(F.transform(F.coalesce(c, F.array()), lambda x: x[field]), lambda t: t.isNotNull() & (F.trim(t) != ""))


def scene_documents(scenes: DataFrame, keyframes: DataFrame) -> DataFrame:
    """One row per scene with its texts as flat arrays and its keyframes in order of frames.

    captions: of the scene, then of its keyframes; keywords: normalized where given; tags sorted and distinct.
    """
    frames = (
        keyframes.select(
            "scene_id",
            F.struct(
                "frame_idx", "keyframe_id", "timestamp_sec", "selection_score", "quality.sharpness", "quality.brightness", "quality.duplicate_score",
                _texts("captions").alias("captions"),
                _texts("ocr_instances").alias("ocr_texts"),
                F.coalesce(F.transform("objects", lambda o: o["label"]), F.array().cast("array<string>")).alias("labels"),
                F.coalesce("action_tags", F.array().cast("array<string>")).alias("action_tags"),
            ).alias("f"),
        )
        .groupBy("scene_id")
        .agg(F.array_sort(F.collect_list("f")).alias("keyframes"))
    )
    joined = scenes.join(frames, "scene_id", "left")
    held = F.coalesce("keyframes", F.array())
    spread = lambda field: F.flatten(F.transform(held, lambda f: f[field]))
    return joined.select(
        "scene_id", "video_id", "scene_idx", "start_frame", "end_frame_exclusive", "start_sec", "end_sec",
        F.concat(_texts("captions"), spread("captions")).alias("captions"),
        spread("ocr_texts").alias("ocr_texts"),
        _texts(F.transform("asr_segments", lambda s: F.struct(F.coalesce(s["normalized_text"], s["text"]).alias("text")))).alias("asr_texts"),
        _texts(F.transform("keywords", lambda k: F.struct(F.coalesce(k["normalized_text"], k["text"]).alias("text")))).alias("keywords"),
        F.array_sort(F.array_distinct(spread("labels"))).alias("object_labels"),
        spread("labels").alias("object_mentions"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("action_tags", F.array().cast("array<string>")), spread("action_tags")))).alias("action_tags"),
        F.col("extensions")["event_id"].alias("event_id"),
        held.alias("keyframes"),
    )


def scene_texts(scenes: DataFrame, keyframes: DataFrame, field: str) -> DataFrame:
    """(scene_id, field) for all current scenes: one list of ``scene_documents`` (captions, asr_texts or keywords), texts in any order, without moving the rest."""
    spoken = lambda c: _texts(F.transform(c, lambda s: F.struct(F.coalesce(s["normalized_text"], s["text"]).alias("text"))))
    texts = {"captions": _texts("captions"), "asr_texts": spoken("asr_segments"), "keywords": spoken("keywords")}[field]
    own = current(scenes.select("scene_id", "loaded_at", texts.alias("own")), "scene_id").select("scene_id", "own")
    if field != "captions":
        return own.withColumnRenamed("own", field)
    frames = current(keyframes.select("keyframe_id", "scene_id", "loaded_at", _texts("captions").alias("t")), "keyframe_id")
    frames = frames.where("size(t) > 0").groupBy("scene_id").agg(F.flatten(F.collect_list("t")).alias("of_frames"))
    return own.join(frames, "scene_id", "left").select("scene_id", F.concat("own", F.coalesce("of_frames", F.array().cast("array<string>"))).alias(field))


def boundary_distance(frame: Column, start: Column, end_exclusive: Column) -> Column:
    """Frames between a frame and the nearer end of its scene."""
    return F.least(frame - start, end_exclusive - 1 - frame)
