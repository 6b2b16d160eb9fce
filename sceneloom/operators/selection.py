"""Deduplication, caps, reranking and choice of frames over ranked lists (query_id, doc_id, ..., score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a task keeps: scope of duplicates, most per video, most per event.
TASK_POLICY = {"KIS": ("event", 5, 1), "QA": ("scene", None, 3), "TRAKE": ("none", None, None), "AVS": ("event", 3, 1)}
WINDOW_SEC = 5.0


def group_key(scope: str) -> Column:
    """What counts as the same result; where a column is null, the row stands for itself."""
    own = F.concat(F.lit("id:"), F.col("doc_id"))
    keys = {
        "none": own,
        "frame": F.when(F.col("frame_idx").isNotNull(), F.concat_ws("|", F.lit("frame"), "video_id", "frame_idx")),
        "scene": F.when(F.col("scene_id").isNotNull(), F.concat(F.lit("scene|"), F.col("scene_id"))),
        "event": F.when(F.col("event_id").isNotNull(), F.concat(F.lit("event|"), F.col("event_id"))),
        "video_window": F.when(F.col("timestamp_sec").isNotNull(), F.concat_ws("|", F.lit("window"), "video_id", F.floor(F.col("timestamp_sec") / WINDOW_SEC).cast("long"))),
    }
    return F.coalesce(keys[scope], own)


def deduplicate(ranked: DataFrame, scope: str, per_video: int | None = None, per_event: int | None = None) -> DataFrame:
    """The first of each group, then at most so many per event (a null event has no limit) and per video; ranks anew.

    Exact in two stages: a row that a cap drops never makes room for another, so counting survivors is enough.
    """
    out = ranked.withColumn("__g", group_key(scope))
    first = lambda *keys: F.row_number().over(Window.partitionBy("query_id", *keys).orderBy("rank", "doc_id"))
    out = out.withColumn("__n", first("__g")).where("__n = 1")
    if per_event:
        out = out.withColumn("__n", first("video_id", "event_id")).where(F.col("event_id").isNull() | (F.col("__n") <= per_event))
    if per_video:
        out = out.withColumn("__n", first("video_id")).where(F.col("__n") <= per_video)
    return out.withColumn("rank", first()).drop("__g", "__n")


def absorbed(ranked: DataFrame, scope: str) -> DataFrame:
    """(query_id, doc_id, absorbed): how many others each first of a group stands for."""
    w = Window.partitionBy("query_id", "__g")
    marked = ranked.withColumn("__g", group_key(scope)).withColumn("absorbed", F.count(F.lit(1)).over(w) - 1).withColumn("__n", F.row_number().over(w.orderBy("rank", "doc_id")))
    return marked.where("__n = 1").select("query_id", "doc_id", "absorbed")


def absorbed_ids(ranked: DataFrame, scope: str) -> DataFrame:
    """(query_id, doc_id, dropped): the first of each group with the ids of the others, in order of rank."""
    items = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    out = ranked.withColumn("__g", group_key(scope)).groupBy("query_id", "__g").agg(F.transform(items, lambda x: x["doc_id"]).alias("ids"))
    return out.select("query_id", F.get("ids", F.lit(0)).alias("doc_id"), F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(1))).alias("dropped"))


def rerank(ranked: DataFrame, model_score: str, head: int, keep: int | None = None) -> DataFrame:
    """The first ``head`` by model score, the first ``keep`` of them before the rest in their old order; rows without score stay last of the head."""
    by = Window.partitionBy("query_id")
    inside = F.col("rank") <= head
    order = F.row_number().over(Window.partitionBy("query_id", inside).orderBy(F.desc_nulls_last(model_score), "rank"))
    out = ranked.withColumn("__o", F.when(inside, order))
    chosen = F.col("__o") <= (keep or head)
    return out.withColumn("rank", F.row_number().over(by.orderBy(F.when(chosen, 0).when(inside, 1).otherwise(2), F.when(chosen, F.col("__o")).otherwise(F.col("rank")), "doc_id"))).drop("__o")


def display(hits: DataFrame, sort_by: str = "final_score", least: float | None = None, limit: int = 100) -> DataFrame:
    """Filter, sort (by score, by 'time', or by the column of a component) and cut a result list per query."""
    if least is not None:
        hits = hits.where(F.col("score") >= least)
    order = {"final_score": [F.desc("score"), F.col("doc_id")], "time": [F.col("video_id"), F.col("start_frame"), F.col("doc_id")]}.get(sort_by, [F.desc_nulls_last(sort_by), F.col("doc_id")])
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)


def rerank_text(captions: Column, ocr: Column, asr: Column, objects: Column, actions: Column, most: int = 2000) -> Column:
    """The evidence of a scene as text: captions, OCR, ASR, up to 20 objects and 10 actions, one line each."""

    def line(name: str, items: Column, sep: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{name}: "), F.array_join(items, sep)))

    return F.left(
        F.concat_ws("\n", line("Caption", captions, " "), line("OCR", ocr, " "), line("ASR", asr, " "), line("Objects", F.slice(F.array_sort(F.array_distinct(objects)), 1, 20), ", "), line("Actions", F.slice(actions, 1, 10), ", ")),
        F.lit(most),
    )


def even_sample(items: Column, n: int) -> Column:
    """n items at even distances, the first and the last among them; all if there are no more than n."""
    size = F.size(items)
    at = lambda i: F.floor(i * (size - 1) / max(n - 1, 1)).cast("int")
    return F.when(size <= n, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(items, at(i))))


# Fixed values of the score of frames that are safe to submit.
SEMANTIC, QUALITY, CENTRALITY, BOUNDARY, BLUR = 0.45, 0.20, 0.15, 0.15, 0.20
SHARP_FLOOR, SHARP_CEILING, MARGIN = 40.0, 300.0, 12.0


def safe_frame_parts(frame: Column, start: Column, end_exclusive: Column, sharpness: Column, duplicate: Column, semantic: Column) -> dict[str, Column]:
    """Parts of the safe-frame score, each in 0..1."""
    sharp = F.least(F.greatest((sharpness - SHARP_FLOOR) / (SHARP_CEILING - SHARP_FLOOR), F.lit(0.0)), F.lit(1.0))
    signals = F.array_compact(F.array(sharp, F.lit(1.0) - duplicate))
    quality = F.when(F.size(signals) > 0, F.aggregate(signals, F.lit(0.0), lambda s, x: s + x) / F.size(signals)).otherwise(0.5)
    half = F.greatest((end_exclusive - start) / 2, F.lit(1.0))
    centrality = F.greatest(F.lit(0.0), 1 - F.abs(frame - (start + end_exclusive - 1) / 2) / half)
    edge = F.least(frame - start, end_exclusive - 1 - frame)
    boundary = F.when(edge >= MARGIN, 0.0).otherwise(1 - F.greatest(edge, F.lit(0)) / MARGIN)
    blur = F.when(sharpness < SHARP_FLOOR, 1 - sharpness / SHARP_FLOOR).otherwise(0.0)
    return {"quality": quality, "centrality": centrality, "boundary": boundary, "blur": blur, "total": SEMANTIC * semantic + QUALITY * quality + CENTRALITY * centrality - BOUNDARY * boundary - BLUR * blur}
