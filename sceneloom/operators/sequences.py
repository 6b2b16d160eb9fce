"""Ordered steps inside one video: linking, ranking of videos, beam search, repair, variants.

Steps are known when the plan is made, so the search is unrolled: one join per step, and a window keeps the
beam after each. Only the beam, a stated number of rows per query (or query and video), goes from step to step.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SequenceOptions:
    """Parameters of a search for sequences, of which a request may set some."""

    gap_penalty: float = 0.002
    max_gap_sec: float = 300.0
    missing: float | None = -0.5
    beam: int = 50

    def overridden(self, asked: dict) -> SequenceOptions:
        """Only what a request states is changed; an unknown name is an error."""
        if unknown := set(asked) - {f.name for f in fields(self)}:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return replace(self, **asked)

    def search(self, hits: DataFrame, steps: int) -> DataFrame:
        return beam_search(hits, steps, self.beam, self.max_gap_sec, self.gap_penalty, self.missing)


def link_steps(hits: DataFrame, steps: int, beam: int = 100, gap_penalty: float = 0.002, max_gap: float | None = None) -> DataFrame:
    """(query_id, video_id, scenes, score, rank) from hits (query_id, step, video_id, scene_idx, start_sec, score).

    Scenes of one video with rising numbers, one per step; score: the sum, less ``gap_penalty`` per second between
    starts. Without a chain over all steps a query gives nothing.
    """
    at = lambda k: hits.where(F.col("step") == k).select("query_id", "video_id", F.col("scene_idx").alias("idx"), F.col("start_sec").alias("t"), F.col("score").alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id", "scenes")
    state = at(0).select("query_id", "video_id", F.array("idx").alias("scenes"), "t", F.round("s", 6).alias("score"))
    state = state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= beam)
    for k in range(1, steps):
        nxt = at(k).withColumnRenamed("t", "t2")
        met = state.drop("rank").join(nxt, ["query_id", "video_id"]).where(F.col("idx") > F.element_at("scenes", -1))
        if max_gap is not None:
            met = met.where(F.col("t2") - F.col("t") <= max_gap)
        gap = F.greatest(F.lit(0.0), F.col("t2") - F.col("t"))
        state = met.select("query_id", "video_id", F.concat("scenes", F.array("idx")).alias("scenes"), F.col("t2").alias("t"), F.round(F.col("score") + F.col("s") - gap_penalty * gap, 6).alias("score"))
        state = state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= beam)
    return state.select("query_id", "video_id", "scenes", "score", "rank")


def rank_videos(hits: DataFrame, steps: int, top: int = 5, least_coverage: float = 0.5) -> DataFrame:
    """(query_id, video_id, coverage, ordered, score, below, rank): how well each video holds the steps of a query in order.

    Hits are (query_id, step, video_id, scene_id, frame_idx, score); the best hit of each step counts. Score: coverage
    + 0.6 x share of the pairs of neighbouring steps that are both there and in order of frames + 0.4 x mean step score
    over the best score of the query - 0.5 x share of steps that use a scene of another step. Videos below the least
    coverage are left out, unless a query has no other: then its best one stays, marked ``below``.
    """
    best = hits.groupBy("query_id", "video_id", "step").agg(F.max_by(F.struct("frame_idx", "score", "scene_id"), F.struct("score", (-F.col("frame_idx")).alias("f"), "scene_id")).alias("b"))
    w = Window.partitionBy("query_id", "video_id").orderBy("step")
    following = (F.lead("step").over(w) == F.col("step") + 1) & (F.lead("b.frame_idx").over(w) > F.col("b.frame_idx"))
    out = best.withColumn("rising", following).groupBy("query_id", "video_id").agg(
        F.round(F.count(F.lit(1)) / F.lit(steps), 6).alias("coverage"),
        F.count_if("rising").alias("rising"),
        F.avg("b.score").alias("mean"),
        (1 - F.countDistinct("b.scene_id") / F.count(F.lit(1))).alias("shared"),
    )
    ordered = F.col("rising") / F.lit(steps - 1) if steps > 1 else F.lit(1.0)
    tops = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    context = F.col("mean") / F.coalesce(F.nullif("top", F.lit(0.0)), F.lit(1.0))
    scored = out.join(tops, "query_id").withColumn("ordered", F.round(ordered, 6)).withColumn("score", F.round(F.col("coverage") + 0.6 * F.col("ordered") + 0.4 * context - 0.5 * F.col("shared"), 6))
    enough = F.col("coverage") >= least_coverage
    served = scored.groupBy("query_id").agg(F.max(enough).alias("served"), F.max(F.struct("score", "video_id"))["video_id"].alias("last"))
    kept = scored.join(served, "query_id").withColumn("below", ~enough).where(enough | (~F.col("served") & (F.col("video_id") == F.col("last"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "video_id", "coverage", "ordered", "score", "below", "rank")


def beam_search(hits: DataFrame, steps: int, beam: int = 50, max_gap_sec: float = 300.0, gap_penalty: float = 0.002, missing: float | None = -0.5) -> DataFrame:
    """(query_id, video_id, frames, score, rank): the best chains of each video, hits being (query_id, step, video_id, frame_idx, timestamp_sec, score).

    Frames rise strictly, at most ``max_gap_sec`` apart; a step may be missed for the penalty ``missing``
    (None: never), its frame is then -1.
    """
    at = lambda k: hits.where(F.col("step") == k).select("query_id", "video_id", F.col("frame_idx").alias("f"), F.col("timestamp_sec").alias("ts"), F.col("score").alias("s"))
    w = Window.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "frames")
    none = F.lit(None)
    state = hits.select("query_id", "video_id").distinct().select("query_id", "video_id", F.array().cast("array<int>").alias("frames"), none.cast("int").alias("last"), none.cast("double").alias("t"), F.lit(0.0).alias("score"))
    for k in range(steps):
        met = state.join(at(k), ["query_id", "video_id"]).where(F.col("last").isNull() | ((F.col("f") > F.col("last")) & (F.col("ts") - F.col("t") <= max_gap_sec)))
        cost = F.when(F.col("last").isNull(), 0.0).otherwise(gap_penalty * (F.col("ts") - F.col("t")))
        grown = met.select("query_id", "video_id", F.concat("frames", F.array("f")).alias("frames"), F.col("f").alias("last"), F.col("ts").alias("t"), F.round(F.col("score") + F.col("s") - cost, 6).alias("score"))
        if missing is not None:
            grown = grown.unionByName(state.select("query_id", "video_id", F.concat("frames", F.array(F.lit(-1))).alias("frames"), "last", "t", F.round(F.col("score") + missing, 6).alias("score")))
        state = grown.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).drop("r")
    return state.where("last is not null").withColumn("rank", F.row_number().over(w)).select("query_id", "video_id", "frames", "score", "rank")


def increasing(frames: Column) -> Column:
    """Frames made strictly rising: one that isn't becomes the one before plus 1. Missing frames (-1) stay."""
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, f: Column) -> Column:
        fixed = F.when(f < 0, f).when(f <= s["last"], s["last"] + 1).otherwise(f)
        return F.struct(F.greatest(s["last"], fixed).alias("last"), F.concat(s["out"], F.array(fixed)).alias("out"))

    return F.aggregate(frames, zero, step)["out"]


def variants(sequences: DataFrame, frames: str = "frames") -> DataFrame:
    """Each sequence with one frame moved by one, as long as frames stay at least 0 and strictly rising."""
    each = sequences.select("*", F.posexplode(frames).alias("at", "f")).select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("by"))
    moved = F.transform(frames, lambda x, i: x + F.when(i == F.col("at"), F.col("by")).otherwise(0))
    rising = F.forall(F.zip_with(F.slice("moved", 1, F.size("moved") - 1), F.slice("moved", 2, F.size("moved")), lambda a, b: a < b), lambda x: x)
    return each.where("f >= 0").withColumn("moved", moved).where((F.array_min("moved") >= 0) & rising).select(*[c for c in sequences.columns if c != frames], F.col("at").alias("step"), "by", F.col("moved").alias(frames))
