"""The composed search: branches, thresholds, fusion, negations, rules, deduplication and hydration in one lazy plan for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval, scoring, selection
from ..sources import tables
from . import planner

#: What the branches read of a scene document.
FIELDS = {"caption": "captions", "ocr": "ocr_texts", "asr": "asr_texts", "keyword": "keywords", "object": "object_labels", "action": "action_tags"}


@dataclass(frozen=True)
class Options:
    """Options of a search; an unknown branch is refused."""

    task: str = "KIS"
    top_k: int = 100
    branch_k: int = 100
    weights: dict[str, float] = field(default_factory=lambda: {b: planner.WEIGHTS[b] for b in ("caption", "ocr", "asr", "keyword")})
    method: str = "rrf"
    least_normalized: float | None = None
    rules: bool = True
    filters: dict = field(default_factory=dict)
    scope: str | None = None

    def __post_init__(self) -> None:
        if unknown := set(self.weights) - set(FIELDS):
            raise ValueError(f"unknown branches: {', '.join(sorted(unknown))}")
        if self.method not in ("rrf", "weighted_sum", "union", "max_score", "intersection"):
            raise ValueError(f"unknown fusion: {self.method}")


@dataclass(frozen=True)
class BranchOptions:
    """Options of one branch; None leaves a value to the next one asked."""

    enabled: bool | None = None
    weight: float | None = None
    limit: int | None = None
    timeout_ms: int | None = None


def resolve(overrides: dict[str, BranchOptions], execution: str, branch: str, default: BranchOptions) -> BranchOptions:
    """The options of an execution of a branch: its own, those of the branch, the default, value by value.

    A branch that isn't enabled has no weight; a limit never exceeds the default one.
    """
    chain = [o for o in (overrides.get(execution), overrides.get(branch), default) if o is not None]
    first = lambda name: next((v for o in chain if (v := getattr(o, name)) is not None), None)
    enabled, limit = first("enabled"), first("limit")
    limit = limit if default.limit is None or limit is None else min(limit, default.limit)
    return BranchOptions(enabled, 0.0 if enabled is False else first("weight"), limit, first("timeout_ms"))


def registered(executions: dict[str, str], controls: dict[str, tuple[str, ...]]) -> list[dict]:
    """Branches in order of name, each with its executions and the controls that all of them know."""
    out = []
    for branch in sorted(set(executions.values())):
        own = sorted(e for e, b in executions.items() if b == branch)
        out.append({"branch": branch, "executions": own, "controls": sorted(set.intersection(*[set(controls.get(e, ())) for e in own]))})
    return out


class MomentEngine:
    """Search over scene documents (see ``tables.scene_documents``)."""

    def __init__(self, documents: DataFrame) -> None:
        self.documents = documents

    @classmethod
    def from_tables(cls, scenes: DataFrame, keyframes: DataFrame) -> MomentEngine:
        return cls(tables.scene_documents(tables.current(scenes, "scene_id"), tables.current(keyframes, "keyframe_id")))

    def branch(self, name: str, queries: DataFrame, options: Options) -> DataFrame:
        """One lexical branch: filtered first, then scored."""
        docs = retrieval.search_filter(self.documents, **options.filters)
        text = F.array_join(FIELDS[name], " ")
        return retrieval.bm25_top(docs, "scene_id", T.tokens(text), queries, T.tokens(F.col("query")), options.branch_k)

    def candidates(self, queries: DataFrame, options: Options) -> DataFrame:
        live = {b: self.branch(b, queries, options) for b, w in options.weights.items() if w > 0}
        lists = retrieval.union_branches(live)
        if options.least_normalized is not None:
            lists = scoring.threshold(lists.withColumn("p", scoring.percentile()), "p", options.least_normalized).drop("p", "below")
        return lists

    def search(self, queries: DataFrame, options: Options | None = None) -> DataFrame:
        """(query_id, scene_id, video_id, event_id, frame_idx, score, branches, rank) of a table of queries (query_id, query)."""
        options = options or Options()
        plans = planner.plan_queries(queries)
        asked = plans.select("query_id", F.col("normalized").alias("query"))
        fused = scoring.fuse(self.candidates(asked, options), options.weights, options.method)
        texts = self.documents.select(
            F.col("scene_id").alias("doc_id"),
            F.array_distinct(T.words_of(T.normalize(F.concat_ws(" ", "captions", "object_labels", "keywords", "action_tags", "ocr_texts")))).alias("words"),
        )
        banned = plans.select("query_id", F.explode("negatives").alias("p")).select("query_id", F.array_distinct(T.words_of(F.col("p"))).alias("words"))
        kept = scoring.drop_negated(fused, banned, texts)
        # candidates meet what rules and deduplication read; frames meet only the hits
        read = self.documents.select(F.col("scene_id").alias("doc_id"), "video_id", "event_id", "ocr_texts", "object_labels", "keywords")
        met = kept.join(read, "doc_id").join(plans.select("query_id", "normalized", "phrases"), "query_id")
        if options.rules:
            extra = scoring.rule_adjustment(F.transform("phrases", T.normalize), T.normalize(F.col("normalized")), T.normalize(F.array_join("ocr_texts", " ")), F.col("object_labels"), F.col("keywords"))
            met = retrieval.top_k(met.withColumn("score", F.round(F.col("score") + extra, 9)).drop("rank"), None)
        scope, per_video, per_event = selection.TASK_POLICY[options.task]
        scope = options.scope or scope
        hits = selection.deduplicate(met.withColumn("scene_id", F.col("doc_id")), scope, per_video, per_event).where(F.col("rank") <= options.top_k)
        hits = hits.select("query_id", "scene_id", "video_id", "event_id", "normalized", "score", "branches", "rank").join(self.documents.select("scene_id", "start_frame", "end_frame_exclusive", "keyframes"), "scene_id")
        # the frame with the most words of the query, else the one nearest to the middle of the scene
        words = T.tokens(F.col("normalized"))
        middle = (F.col("start_frame") + F.col("end_frame_exclusive") - 1) / 2

        def worth(f):
            shared = F.size(F.array_intersect(words, F.flatten(F.transform(F.concat(f["captions"], f["ocr_texts"]), T.tokens))))
            return F.struct((-shared).alias("s"), F.when(shared > 0, F.lit(0.0)).otherwise(F.abs(f["frame_idx"] - middle)).alias("d"), f["frame_idx"].alias("frame_idx"))

        frame = F.element_at(F.array_sort(F.transform("keyframes", worth)), 1)["frame_idx"]
        chosen = F.when(F.size("keyframes") > 0, frame).otherwise(F.floor(middle))
        return hits.select("query_id", "scene_id", "video_id", "event_id", chosen.cast("long").alias("frame_idx"), "score", "branches", "rank")
