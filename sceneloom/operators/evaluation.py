"""Results against gold: hits in time, videos, answers, steps and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def gold_intervals(queries: DataFrame) -> DataFrame:
    """(query_id, video_id, start_sec, end_sec, scene_ids) of a query file: ids trimmed, in upper case and distinct; a reversed or half-open window is none."""
    whole = F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull() & (F.col("end_sec") > F.col("start_sec"))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("scene_ids", F.array().cast("array<string>")), lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
    return queries.select("query_id", "video_id", F.when(whole, F.col("start_sec")).alias("start_sec"), F.when(whole, F.col("end_sec")).alias("end_sec"), ids.alias("scene_ids"))


def time_hit(scene_id: Column, video_id: Column, start: Column, end: Column, gold: str = "g") -> Column:
    """Whether a result is one of the gold scenes or shares time with the gold window (touching is not enough); gold without a window is met by its video."""
    g = lambda c: F.col(f"{gold}.{c}")
    open_ = g("start_sec").isNull() | g("end_sec").isNull()
    return F.array_contains(g("scene_ids"), scene_id) | ((video_id == g("video_id")) & (open_ | ((start < g("end_sec")) & (end > g("start_sec")))))


def first_ranks(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, first_hit, first_video) for every query of the gold; null where there is none. Results: (query_id, scene_id, video_id, start_sec, end_sec, rank)."""
    met = results.join(gold.select("query_id", F.struct("video_id", "start_sec", "end_sec", "scene_ids").alias("g")), "query_id")
    hit = time_hit(F.col("scene_id"), F.col("video_id"), F.col("start_sec"), F.col("end_sec"))
    found = met.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first_hit"), F.min(F.when(F.col("video_id") == F.col("g.video_id"), F.col("rank"))).alias("first_video"))
    return gold.select("query_id").distinct().join(found, "query_id", "left")


def answer_matches(predicted: Column, accepted: Column) -> Column:
    """Whether an answer holds any accepted one, both normalized."""
    said = T.normalize(predicted)
    return (F.coalesce(said, F.lit("")) != "") & F.exists(accepted, lambda a: F.contains(said, T.normalize(a)))


def answer_scores(results: DataFrame, gold: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(query_id, evidence_rank, answered, joint) of results (query_id, video_id, frame_idx, answer, rank) against gold (query_id, video_id, low, high, accepted).

    answered: some result in the right place has a right answer; joint: and the first result is in the right place.
    Results with ``doc_id`` instead of an answer take it from ``answers`` (doc_id, answer); only those in the right place carry texts.
    """
    met = gold.join(results.withColumnRenamed("video_id", "v"), "query_id").where((F.col("v") == F.col("video_id")) & F.col("frame_idx").between(F.col("low"), F.col("high")))
    if answers is not None:
        met = met.join(answers, "doc_id", "left")
    right = answer_matches(F.col("answer"), F.col("accepted"))
    found = met.groupBy("query_id").agg(F.min("rank").alias("evidence_rank"), F.max(right).alias("answered"))
    out = gold.select("query_id").distinct().join(found, "query_id", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    return out.select("query_id", "evidence_rank", "answered", (F.col("answered") & (F.coalesce("evidence_rank", F.lit(0)) == 1)).alias("joint"))


def event_coverage(results: DataFrame, gold: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, covered): share of the gold events (query_id, event_id) that the first k results (query_id, event_id, rank) hold."""
    held = results.where((F.col("rank") <= k) & F.col("event_id").isNotNull()).select("query_id", "event_id", F.lit(1).alias("held")).distinct()
    return gold.select("query_id", "event_id").distinct().join(held, ["query_id", "event_id"], "left").groupBy("query_id").agg(F.round(F.count("held") / F.count(F.lit(1)), 6).alias("covered"))


def dataset_stats(scenes: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Per video: scenes, their mean length, scenes with speech, keyframes, captions and written texts."""
    a = scenes.groupBy("video_id").agg(F.count(F.lit(1)).alias("scenes"), F.round(F.avg(F.col("end_sec") - F.col("start_sec")), 6).alias("mean_sec"), F.count_if(F.size("asr_segments") > 0).alias("spoken"))
    b = keyframes.groupBy("video_id").agg(F.count(F.lit(1)).alias("keyframes"), F.sum(F.greatest(F.size("captions"), F.lit(0))).alias("captions"), F.sum(F.greatest(F.size("ocr_instances"), F.lit(0))).alias("written"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return a.join(b, "video_id", "left").select("video_id", "scenes", "mean_sec", "spoken", zero("keyframes"), zero("captions"), zero("written"))
