"""What goes with a result: evidence of a scene and its neighbours, frames to show, records in the order asked for, steps refined to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint
from . import selection

# Lengths of texts, frames around an anchor, confidence without a frame.
LONG, SHORT, WINDOW, NO_FRAME = 2000, 500, 45, 0.2


def joined(texts: Column, most: int) -> Column:
    """Texts in a row, cut; null if nothing is left."""
    return F.nullif(F.left(F.array_join(texts, " "), F.lit(most)), F.lit(""))


def evidence_packs(candidates: DataFrame, documents: DataFrame, form=None) -> DataFrame:
    """Candidates (query_id, doc_id, rank) with the texts of their scene and short ones of the scenes before and after it.

    Neighbours are those whose number in the video is one less or more. Candidates without a scene are left out. ``form`` is
    what is kept of a text (a function of a column, the text itself by default); it is taken once per scene, before candidates meet them.
    """
    form = form or (lambda c: c)
    cut = lambda name, most: form(joined(F.col(name), most))
    text = documents.select("scene_id", "video_id", "scene_idx", cut("captions", LONG).alias("caption"), cut("ocr_texts", LONG).alias("ocr"), cut("asr_texts", LONG).alias("asr"), cut("captions", SHORT).alias("brief"))
    text = checkpoint(text)  # read three times

    def beside(name: str, by: int) -> DataFrame:
        return text.groupBy("video_id", (F.col("scene_idx") + by).alias("scene_idx")).agg(F.min(F.struct("scene_id", "brief")).alias("n")).select("video_id", "scene_idx", F.col("n.scene_id").alias(f"{name}_id"), F.col("n.brief").alias(f"{name}_caption"))

    packs = text.drop("brief").join(beside("previous", 1), ["video_id", "scene_idx"], "left").join(beside("next", -1), ["video_id", "scene_idx"], "left")
    out = candidates.join(packs.withColumnRenamed("scene_id", "doc_id"), "doc_id")
    empty = form(F.lit(None).cast("string"))
    return out.select("query_id", "doc_id", "rank", "caption", "ocr", "asr", "previous_id", F.coalesce("previous_caption", empty).alias("previous_caption"), "next_id", F.coalesce("next_caption", empty).alias("next_caption"))


def shown_frames(frames: Column, best: Column, most: int = 3) -> Column:
    """Of sorted frame numbers: the best one (or the first), then others at even distances."""
    head = F.when(F.array_contains(frames, best), best).otherwise(F.get(frames, F.lit(0)))
    rest = F.array_remove(frames, head)
    step = F.size(rest) / (most - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 2)), lambda i: F.get(rest, F.least(F.floor(i * step).cast("int"), F.size(rest) - 1)))
    return F.when(F.size(frames) == 0, F.array().cast(frames_type())).otherwise(F.concat(F.array(head), F.when(F.size(rest) <= most - 1, rest).otherwise(spread)))


def frames_type() -> str:
    return "array<int>"


def multi_get(requests: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records in the order of requests (request_id, keys): (request_id, place, key, *records); unknown keys are left out, repeated ones come again."""
    asked = requests.select("request_id", F.posexplode("keys").alias("place", key))
    return asked.join(records, key)


def refine_steps(anchors: DataFrame, frames: DataFrame, semantic: float = 0.5, window: int = WINDOW) -> DataFrame:
    """(query_id, video_id, step, scene_id, frame_idx, confidence): each anchor (query_id, video_id, step, scene_id, anchor) moved to the safest frame near it.

    ``frames`` are the frames of scenes (scene_id, frame_idx, sharpness, duplicate_score, start_frame, end_frame_exclusive).
    Without a frame in the window the anchor stays, with little confidence.
    """
    met = anchors.join(frames, "scene_id", "left")
    near = F.col("frame_idx").isNotNull() & (F.abs(F.col("frame_idx") - F.col("anchor")) <= window)
    parts = selection.safe_frame_parts(F.col("frame_idx"), F.col("start_frame"), F.col("end_frame_exclusive"), F.col("sharpness"), F.col("duplicate_score"), F.lit(semantic))
    total = F.round(parts["total"], 6)
    best = met.groupBy("query_id", "video_id", "step", "scene_id", "anchor").agg(F.min(F.when(near, F.struct((-total).alias("t"), "frame_idx"))).alias("b"))
    confidence = F.when(F.col("b").isNull(), NO_FRAME).otherwise(F.least(F.greatest(-F.col("b.t"), F.lit(0.0)), F.lit(1.0)))
    return best.select("query_id", "video_id", "step", "scene_id", F.coalesce("b.frame_idx", "anchor").alias("frame_idx"), confidence.alias("confidence"))


def assemble_sequences(chains: DataFrame, videos: DataFrame, limit: int = 100) -> DataFrame:
    """(query_id, video_id, frames, missing, score, degraded, rank): chains of ranked videos, scored by both, videos in order.

    ``chains`` (query_id, video_id, frames, score, rank; a missed step is -1), ``videos`` as of ``sequences.rank_videos``.
    """
    met = chains.join(videos.select("query_id", "video_id", F.col("score").alias("video_score"), F.col("rank").alias("video_rank"), "below"), ["query_id", "video_id"])
    w = Window.partitionBy("query_id").orderBy("video_rank", "rank")
    missing = F.filter(F.transform("frames", lambda f, i: F.when(f < 0, i + 1)), lambda i: i.isNotNull())
    out = met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return out.select("query_id", "video_id", F.filter("frames", lambda f: f >= 0).alias("frames"), missing.alias("missing"), F.round(F.col("score") + F.col("video_score"), 6).alias("score"), F.col("below").alias("degraded"), F.col("place").alias("rank"))
