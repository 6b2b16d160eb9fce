"""Evaluation of ranked results, submissions and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 20, 50, 100)
# Ranks at which a zone of a submission ends.
ZONES = (("top1", 1), ("top5", 5), ("top20", 20), ("top50", 50), ("top100", 100))


def first_hits(results: DataFrame, hit: Column, queries: DataFrame) -> DataFrame:
    """(query_id, first_rank): the rank of each query's first hit, null where there is none."""
    found = results.where(hit).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").distinct().join(found, "query_id", "left")


def recall_mrr(first: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall at the cuts and mean reciprocal rank over (query_id, first_rank)."""
    r = F.col("first_rank")
    at = [F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in CUTS]
    return first.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("queries"), *at, F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"))


def ndcg(graded: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): results (query_id, rank, grade) against all grades (query_id, grade) of each query; 0 where nothing is relevant."""
    gain = lambda g, pos: (F.pow(F.lit(2.0), g) - 1) / F.log2(pos + 1)
    got = graded.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    best = ideal.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))).where(F.col("pos") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("pos"))).alias("idcg"))
    return best.join(got, "query_id", "left").select("query_id", F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))


def precision(graded: DataFrame, k: int) -> DataFrame:
    """(query_id, precision): relevant ones among the first k, over the number returned up to k."""
    top = graded.where(F.col("rank") <= k)
    return top.groupBy("query_id").agg(F.round(F.count_if(F.col("grade") > 0) / F.greatest(F.least(F.lit(k), F.count(F.lit(1))), F.lit(1)), 6).alias("precision"))


def step_score(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, r_score, complete): share of gold steps (query_id, video_id, step, low, high) whose frame in the answer lies inside, in the right video."""
    met = gold.join(answers.select("query_id", F.col("video_id").alias("v"), "step", "frame_idx"), ["query_id", "step"], "left")
    ok = F.coalesce((F.col("v") == F.col("video_id")) & F.col("frame_idx").between(F.col("low"), F.col("high")), F.lit(False))
    return met.groupBy("query_id").agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("r_score"), F.bool_and(ok).alias("complete"))


def zone(rank: str = "rank") -> Column:
    out = F.lit("beyond")
    for name, last in reversed(ZONES):
        out = F.when(F.col(rank) <= last, name).otherwise(out)
    return out


def latencies(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"))


def submission_issues(rows: DataFrame, videos: DataFrame, most: int = 100) -> DataFrame:
    """(query_id, rank, issue) of a submission (query_id, rank, video_id, frame_idx, answer): whatever would make it invalid."""
    known = videos.groupBy("video_id").agg(F.max("frame_count").alias("frame_count"))
    met = rows.join(known, "video_id", "left")
    times = F.row_number().over(Window.partitionBy("query_id", "video_id", "frame_idx", "answer").orderBy("rank"))
    flags = F.array_compact(
        F.array(
            F.when(F.col("rank") > most, "too_many"),
            F.when(F.col("frame_count").isNull(), "unknown_video"),
            F.when(F.col("frame_idx") < 0, "negative_frame"),
            F.when(F.col("frame_idx") >= F.col("frame_count"), "beyond_video"),
            F.when(times > 1, "duplicate"),
            F.when(F.trim(F.coalesce("answer", F.lit("-"))) == "", "empty_answer"),
            F.when(F.length("answer") > 100, "long_answer"),
        )
    )
    return met.withColumn("flags", flags).select("query_id", "rank", F.explode("flags").alias("issue"))
