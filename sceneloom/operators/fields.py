"""The second kind of search: fields with weights, a gate on coverage, hints that move weights, vectors of scenes and frames, sequences with events.

A scene has an index text per field; a branch sums what its fields give. Ranked lists are (query_id, branch, doc_id, score, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import checkpoint
from . import pruned, retrieval

# Words without content, hints, weights of branches, factors of hints and tasks, limits.
STOPWORDS = "ai bị bởi các cái cho chỉ có của cũng đã đang đến để đó được gì khi không là lại lúc mà một này những ở sau sẽ theo thì trên trong trước từ và vào về với".split()
WRITTEN = ["chữ", "văn bản", "biển", "logo", "tiêu đề", "phụ đề", "màn hình", "số điện thoại", "đọc được", "written", "text", "sign", "subtitle"]
SPOKEN = ["nói", "phát biểu", "trả lời", "hỏi", "âm thanh", "giọng", "nghe", "said", "says", "speech", "announces", "mentions"]
TEMPORAL = ["sau đó", "trước khi", "tiếp theo", "đầu tiên", "cuối cùng", " rồi ", "before", "after", "then", "next", "finally"]
ACTION = ["đang", "hành động", "di chuyển", "đi", "chạy", "cầm", "mở", "đóng", "action", "moving", "walking", "running", "holding"]
STEP_MARKERS = r"(?iU)\s+(?:sau đó|tiếp theo|rồi|trước khi|then|next|after that|before)\s+"
BRANCH_WEIGHTS = {"semantic": 1.35, "ocr": 1.0, "speech": 1.0, "tags": 1.1, "event": 0.9, "scene_vector": 1.35, "frame_vector": 1.0}
LEAST_TERMS, LEAST_COVERAGE, LEAST_SIMILARITY = 2, 0.34, 0.2
REVIEW_PENALTY, GAP_PENALTY = 0.75, 0.0001


def query_terms(c: Column) -> Column:
    """The different words with content, without accents: two letters or more, or digits."""
    stop = T.constants(sorted({T.plain_strip(w) for w in STOPWORDS}))
    words = F.regexp_extract_all(T.lower(T.strip_diacritics(F.coalesce(c, F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w) & ((F.length(w) >= 2) | w.rlike(r"^\p{Nd}+$"))))


def coverage(terms: Column, evidence_terms: Column) -> Column:
    """Share of the terms that the evidence has; 0 without terms."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, evidence_terms)) / F.size(terms)).otherwise(0.0)


def gate(terms: Column, evidence_terms: Column, match_all: bool = False) -> Column:
    """Whether enough of the terms are held: two of them (or all, if there are fewer) and a third; with ``match_all`` every one."""
    enough = F.size(F.array_intersect(terms, evidence_terms)) >= F.least(F.lit(LEAST_TERMS), F.size(terms))
    return (F.size(terms) > 0) & enough & (coverage(terms, evidence_terms) + 1e-12 >= (1.0 if match_all else LEAST_COVERAGE))


def match_expression(terms: Column, match_all: bool = False) -> Column:
    """The terms as a full-text expression, each quoted; empty without terms."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND " if match_all else " OR ")


def field_branch(docs: DataFrame, fields: dict[str, float], queries: DataFrame, k: int, match_all: bool = False) -> DataFrame:
    """(query_id, doc_id, score, coverage, rank): a branch over several fields with weights.

    ``docs`` is (doc_id, *fields as texts), ``queries`` (query_id, terms). A term's frequency is the weighted sum of
    those in the fields (as are the lengths), which BM25 then saturates once. What passes the gate counts.
    """
    spread = F.flatten(F.array(*[F.transform(query_words(f), _weighted(x)) for f, x in fields.items()]))
    each = checkpoint(docs.select("doc_id", spread.alias("ws")).select("doc_id", F.col("ws.token").alias("w"), F.col("ws.x").alias("x")))
    n, mean = each.agg(F.count(F.lit(1)), F.avg(F.aggregate("x", F.lit(0.0), lambda s, x: s + x))).first()
    asked = queries.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("token"), F.lit(1).alias("times"))
    share = 1.0 if match_all else LEAST_COVERAGE

    def least(terms: int) -> int:
        return next(m for m in range(min(LEAST_TERMS, terms), terms + 1) if m / terms + 1e-12 >= share)

    found = pruned.best(each, asked, k, *retrieval.bm25_parts(n, mean or 0.0), least)
    return found.select("query_id", "doc_id", "score", F.round(F.col("met") / F.col("n"), 6).alias("coverage"), "rank")


def _weighted(weight: float):
    return lambda w: F.struct(w.alias("token"), F.lit(float(weight)).alias("x"))


def query_words(field: str) -> Column:
    """All words of a field with content, repeated as often as they occur."""
    stop = T.constants(sorted({T.plain_strip(w) for w in STOPWORDS}))
    words = F.regexp_extract_all(T.lower(T.strip_diacritics(F.coalesce(F.col(field), F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(words, lambda w: ~F.array_contains(stop, w) & ((F.length(w) >= 2) | w.rlike(r"^\p{Nd}+$")))


def overlapping(df: DataFrame, start_sec: float | None = None, end_sec: float | None = None, video_id: str | None = None, invalid: Column | None = None) -> DataFrame:
    """Rows (video_id, start_sec, end_sec) that share time with a range, also if they only touch it; without those that are invalid."""
    if video_id:
        df = df.where(F.col("video_id") == video_id)
    if start_sec is not None:
        df = df.where(F.col("end_sec") >= start_sec)
    if end_sec is not None:
        df = df.where(F.col("start_sec") <= end_sec)
    return df if invalid is None else df.where(~F.coalesce(invalid, F.lit(False)))


def branch_weights(c: Column, task: str = "auto") -> dict[str, Column]:
    """The weight of each branch for a query text."""
    if task not in ("auto", "frame", "scene", "temporal", "qa"):
        raise ValueError(f"unknown task: {task}")
    padded = F.concat(F.lit(" "), T.lower(c), F.lit(" "))
    has = lambda hints: F.exists(T.constants(hints), lambda h: F.contains(padded, h))
    times = lambda condition, factor: F.when(condition, factor).otherwise(1.0)
    written, spoken, action = has(WRITTEN) | c.rlike(r"(?<![\p{L}\p{N}_])\p{Nd}{2,}(?![\p{L}\p{N}_])"), has(SPOKEN), has(ACTION)
    temporal = F.lit(True) if task == "temporal" else has(TEMPORAL)
    out = {b: F.lit(w) for b, w in BRANCH_WEIGHTS.items()}
    out["ocr"] *= times(written, 1.8)
    out["speech"] *= times(spoken, 1.8)
    out["event"] *= times(temporal, 1.8) * times(action, 1.25)
    out["tags"] *= times(temporal, 1.25) * times(action, 1.45)
    if task == "frame":
        out["frame_vector"], out["scene_vector"] = out["frame_vector"] * 1.5, out["scene_vector"] * 0.8
    elif task in ("scene", "qa"):
        out["semantic"], out["scene_vector"] = out["semantic"] * 1.2, out["scene_vector"] * 1.2
    return out


def temporal_steps(c: Column) -> Column:
    """A query cut at the words between its steps."""
    return F.filter(F.transform(F.split(c, STEP_MARKERS), lambda p: F.regexp_replace(p, r"^[ ,.;]+|[ ,.;]+$", "")), lambda p: p != "")


def first_per_scene(ranked: DataFrame, scene: str, k: int) -> DataFrame:
    """The best row of each scene of a query (ranked rows with a column of scenes), ranked anew and cut."""
    best = ranked.groupBy("query_id", scene).agg(F.min_by(F.struct(*[c for c in ranked.columns if c not in ("query_id", scene)]), F.struct("rank", "doc_id")).alias("b")).select("query_id", scene, "b.*")
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_branch(queries: DataFrame, vectors: DataFrame, k: int, over: int = 2, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Scenes by vectors: more are fetched than asked for, those below the least similarity are dropped."""
    found = retrieval.cosine_search(queries, vectors, over * k).where(F.col("score") >= least)
    return retrieval.top_k(found.drop("rank"), k)


def fused(lists: DataFrame, weights: DataFrame, penalties: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): lists added up by reciprocal ranks with each query's own weights (query_id, branch, weight) and each document's penalty (doc_id, penalty)."""
    part = F.col("weight") * F.coalesce("penalty", F.lit(1.0)) / (rrf_k + F.col("rank"))
    out = lists.join(weights.where("weight > 0"), ["query_id", "branch"]).join(penalties, "doc_id", "left").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))
    return retrieval.top_k(out, k)


def quality_state(statuses: Column, problems: Column) -> Column:
    """passed, needs_review or invalid, of the statuses and problems found for a scene."""
    return F.when(F.array_contains(statuses, "invalid"), "invalid").when(F.array_contains(statuses, "needs_review") | (F.size(problems) > 0), "needs_review").otherwise("passed")


def representative_frame(frames: DataFrame, given: Column, quality: Column, at: Column, start: Column, end: Column) -> DataFrame:
    """(scene_id, keyframe_id): the frame that is named, else the best one, else the one nearest to the middle."""
    order = F.struct(F.when(F.col("keyframe_id") == given, 0).otherwise(1).alias("a"), (-F.coalesce(quality, F.lit(float("-inf")))).alias("b"), F.round(F.abs(at - (start + end) / 2), 6).alias("c"), F.col("keyframe_id").alias("d"))
    return frames.groupBy("scene_id").agg(F.min_by("keyframe_id", order).alias("keyframe_id"))


def event_chains(hits: DataFrame, steps: int, beam: int = 200, max_gap: float | None = 120.0) -> DataFrame:
    """(query_id, video_id, scenes, score, rank) of hits (query_id, step, video_id, scene_no, at_sec, event_order, score).

    A step follows in a later scene, or in the same one with a later event, at most ``max_gap`` seconds on; a second costs little.
    """
    at = lambda n: hits.where(F.col("step") == n).select("query_id", "video_id", F.col("scene_no").alias("no2"), F.col("at_sec").alias("t2"), F.col("event_order").alias("e2"), F.col("score").alias("s2"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id", "scenes")
    cut = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= beam)
    state = cut(at(0).select("query_id", "video_id", F.array("no2").alias("scenes"), F.col("no2").alias("no"), F.col("t2").alias("t"), F.col("e2").alias("e"), F.round("s2", 6).alias("score")))
    for n in range(1, steps):
        gap = F.greatest(F.lit(0.0), F.col("t2") - F.col("t"))
        later = (F.col("no2") > F.col("no")) | ((F.col("no2") == F.col("no")) & (F.col("e2") > F.col("e")))
        met = state.drop("rank").join(at(n), ["query_id", "video_id"]).where(later)
        if max_gap is not None:
            met = met.where(gap <= max_gap)
        state = cut(met.select("query_id", "video_id", F.concat("scenes", F.array("no2")).alias("scenes"), F.col("no2").alias("no"), F.col("t2").alias("t"), F.col("e2").alias("e"), F.round(F.col("score") + F.col("s2") - GAP_PENALTY * gap, 6).alias("score")))
    return state.select("query_id", "video_id", "scenes", "score", "rank")
