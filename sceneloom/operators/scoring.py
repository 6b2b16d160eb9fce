"""Scores of ranked lists: normalisation, thresholds, fusion, rule-based adjustment. Lists are (query_id, branch, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_BY = ("query_id", "branch")
RRF_K = 60
#: Kinds of scores that lie in 0..1 by themselves.
BOUNDED = ("fuzzy_ratio", "confidence", "histogram_similarity", "overlap_ratio")
SCORE_KINDS = (*BOUNDED, "cosine", "bm25", "rrf", "model", "count")


def percentile(score: str = "score", by: tuple[str, ...] = _BY) -> Column:
    """Rank from below as a share, ties sharing their mean rank; 1 for a list of one."""
    part = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(part)
    place = F.rank().over(part.orderBy(score)) - 1 + (F.count(F.lit(1)).over(Window.partitionBy(*by, score)) - 1) / 2
    return F.when(n <= 1, 1.0).otherwise(place / (n - 1))


def minmax(score: str = "score", by: tuple[str, ...] = _BY) -> Column:
    part = Window.partitionBy(*by)
    low, high = F.min(score).over(part), F.max(score).over(part)
    return F.when(high <= low, 1.0).otherwise((F.col(score) - low) / (high - low))


def sigmoid(score: str = "score") -> Column:
    return 1 / (1 + F.exp(-F.col(score)))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def normalized(kind: str, unbounded: str = "percentile", score: str = "score", by: tuple[str, ...] = _BY) -> Column:
    """A score in 0..1 by the value of the column ``kind``; kinds without bounds by 'percentile', 'minmax' or 'calibrated'."""
    rest = {"percentile": lambda: percentile(score, by), "minmax": lambda: minmax(score, by), "calibrated": lambda: sigmoid(score)}[unbounded]()
    return F.when(F.col(kind).isin(*BOUNDED), clamp(F.col(score))).when(F.col(kind) == "cosine", clamp((F.col(score) + 1) / 2)).otherwise(rest)


def threshold(lists: DataFrame, value: str, least: float, hard: bool = True, by: tuple[str, ...] = _BY) -> DataFrame:
    """Rows below ``least`` are dropped (hard) or moved behind the others (soft); a null value stays. Ranks anew, with column ``below``."""
    marked = lists.withColumn("below", F.coalesce(F.col(value) < least, F.lit(False)))
    if hard:
        marked = marked.where(~F.col("below"))
    w = Window.partitionBy(*by).orderBy("below", "rank", "doc_id")
    return marked.withColumn("rank", F.row_number().over(w))


def fuse(lists: DataFrame, weights: dict[str, float], method: str = "rrf", k: int = RRF_K, least_branches: int = 2, limit: int | None = None, key: str = "doc_id", multiplier: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, branches, best_rank, rank): one list per query from those of its branches.

    A row contributes weight / (k + rank) to its key, times ``multiplier``; a key that a branch names several
    times gets each contribution. 'rrf' (also 'weighted_sum' and 'union', which are the same sum) adds them,
    'max_score' takes the largest, 'intersection' adds them for keys of at least so many branches. A branch
    without weight takes no part.
    """
    if not (live := {b: w for b, w in weights.items() if w > 0}):
        return lists.select("query_id", key, F.lit(0.0).alias("score"), F.lit("").alias("branches"), F.lit(0).alias("best_rank"), "rank").where("false")
    weight = F.lit(None).cast("double")
    for b, w in live.items():
        weight = F.when(F.col("branch") == b, F.lit(float(w))).otherwise(weight)
    part = weight / (k + F.col("rank"))
    if multiplier is not None:
        part = part * multiplier
    total = F.max("part") if method == "max_score" else F.sum("part")
    out = (
        lists.where(F.col("branch").isin(*live))
        .withColumn("part", part)
        .groupBy("query_id", key)
        .agg(F.round(total, 9).alias("score"), F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branches"), F.min("rank").alias("best_rank"), F.countDistinct("branch").alias("n"))
    )
    if method == "intersection":
        out = out.where(F.col("n") >= max(2, least_branches))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(["best_rank"] if multiplier is not None else []), key)
    out = out.drop("n").withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= limit) if limit else out


def fusion_details(lists: DataFrame, weights: dict[str, float], k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, branch, score, contribution, first_branch): what each branch gave to each key.

    The score is the last one that the branch gave; ``first_branch`` is where the key came up first, in order of branches.
    """
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    per = lists.groupBy("query_id", key, "branch").agg(F.max_by("score", F.struct("rank", "score")).alias("score"), F.round(F.sum(F.coalesce(w[F.col("branch")], F.lit(0.0)) / (k + F.col("rank"))), 9).alias("contribution"))
    return per.withColumn("first_branch", F.min("branch").over(Window.partitionBy("query_id", key)))


def frame_hints(lists: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """(query_id, scene_id, frame_idx): of the candidates with a frame, the one with the highest contribution to its scene."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    part = F.coalesce(w[F.col("branch")], F.lit(0.0)) / (k + F.col("rank"))
    return lists.where("frame_idx is not null").groupBy("query_id", "scene_id").agg(F.max_by("frame_idx", F.struct(part.alias("p"), (-F.col("frame_idx")).alias("f"))).alias("frame_idx"))


# What each rule adds to or takes from a fused score.
OCR_EXACT, OCR_PARTIAL, OCR_MISS = 0.020, 0.010, -0.015
OBJECT, OBJECT_CAP, KEYWORD, KEYWORD_CAP = 0.004, 0.012, 0.003, 0.009


def rule_adjustment(phrases: Column, query: Column, ocr: Column, labels: Column, keywords: Column) -> Column:
    """The sum of the rules for one (query, document): phrases found in its OCR, labels and keywords found in the query.

    ``phrases`` are normalized quotes (an array), ``query`` and ``ocr`` normalized texts, ``labels`` and ``keywords`` arrays as stored.
    """
    levels = F.transform(phrases, lambda p: T.phrase_level(p, ocr))
    quoted = (
        F.when(F.size(phrases) == 0, 0.0)
        .when(F.array_contains(levels, "exact"), OCR_EXACT)
        .when(F.array_contains(levels, "partial"), OCR_PARTIAL)
        .when(F.forall(levels, lambda x: x == "miss"), OCR_MISS)
        .otherwise(0.0)
    )
    asked = T.words_of(query)
    hit = F.filter(F.array_distinct(labels), lambda x: F.size(F.array_except(T.words_of(T.normalize(x)), asked)) == 0)
    held = F.filter(F.array_distinct(keywords), lambda x: (T.normalize(x) != "") & F.contains(query, T.normalize(x)))
    return quoted + F.when(query != "", F.least(F.lit(OBJECT_CAP), F.size(hit) * OBJECT) + F.least(F.lit(KEYWORD_CAP), F.size(held) * KEYWORD)).otherwise(0.0)


def drop_negated(lists: DataFrame, constraints: DataFrame, words: DataFrame) -> DataFrame:
    """Without the documents (doc_id, words) that hold all words of any phrase (query_id, words) of their query; ranks anew.

    A document that isn't known stays.
    """
    phrases = constraints.select("query_id", F.col("words").alias("wanted")).where(F.size("wanted") > 0)
    bad = (
        lists.select("query_id", "doc_id").distinct()
        .join(phrases, "query_id")
        .join(words.select("doc_id", F.col("words").alias("held")), "doc_id")
        .where(F.size(F.array_except("wanted", "held")) == 0)
        .select("query_id", "doc_id")
    )
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return lists.join(bad, ["query_id", "doc_id"], "left_anti").withColumn("rank", F.row_number().over(w))
