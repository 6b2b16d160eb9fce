"""Task processors over ranked candidates joined with scene documents and query plans: known items, ad-hoc search, questions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T

# Weights of the known-item score.
RETRIEVAL, MUST, RARE, NICE, AGREEMENT, SAFE, CONTRADICTION = 1.0, 0.6, 0.25, 0.1, 0.15, 0.3, 0.8
# Shares of grade and retrieval in ad-hoc relevance; balance of relevance and novelty; likeness of one cluster; most per video.
GRADE_SHARE, RETRIEVAL_SHARE, MMR, SAME_CLUSTER, PER_VIDEO = 0.7, 0.3, 0.7, 0.6, 3
# Confidence of a verified answer.
VERIFIED = {"SUPPORTED": 1.0, "PARTIAL": 0.6, "INSUFFICIENT": 0.25, "CONTRADICTED": 0.0}


def term_hits(terms: Column, text: Column) -> Column:
    """The terms that a normalized text holds: single words as words, phrases anywhere. Terms are normalized first."""
    words = T.words_of(text)
    bare = F.filter(F.transform(terms, T.normalize), lambda t: t != "")
    return F.filter(bare, lambda t: F.when(F.contains(t, F.lit(" ")), F.contains(text, t)).otherwise(F.array_contains(words, t)))


def known_item_score(score: Column, best: Column, must: Column, rare: Column, nice: Column, negative: Column, text: Column, branches: Column, most_branches: Column, safe: Column) -> Column:
    """The score of one candidate; ``text`` is its normalized evidence, the lists come from the query's signature."""
    share = lambda terms, empty: F.when(F.size(terms) > 0, F.size(term_hits(terms, text)) / F.size(terms)).otherwise(empty)
    rare_hits = F.size(F.filter(F.transform(rare, T.normalize), lambda t: F.contains(text, t)))
    rare_share = F.when(F.size(rare) > 0, F.least(rare_hits / F.size(rare), F.lit(1.0))).otherwise(0.0)
    return (
        RETRIEVAL * score / F.when(best == 0, 1.0).otherwise(best)
        + MUST * share(must, 1.0) + RARE * rare_share + NICE * share(nice, 0.0)
        + AGREEMENT * branches / most_branches + SAFE * F.coalesce(safe, F.lit(0.0))
        - F.when(F.size(term_hits(negative, text)) > 0, CONTRADICTION).otherwise(0.0)
    )


def grade(groups: Column, exclusions: Column, text: Column) -> Column:
    """0..3: how many of the groups a normalized text meets, each by any option; 0 if it holds an exclusion."""
    met = F.size(F.filter(groups, lambda options: F.size(term_hits(options, text)) > 0))
    share = met / F.size(groups)
    return F.when((text == "") | (F.size(groups) == 0) | (F.size(term_hits(exclusions, text)) > 0), 0).when(share >= 0.999, 3).when(share >= 0.6, 2).when(share > 0, 1).otherwise(0)


def relevance(grade_: Column, score: Column, best: Column) -> Column:
    return GRADE_SHARE * grade_ / 3 + RETRIEVAL_SHARE * score / F.when(best == 0, 1.0).otherwise(best)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def select_diverse(graded: DataFrame, most: int = 100, balance: float = MMR, per_video: int = PER_VIDEO, same: float = SAME_CLUSTER) -> DataFrame:
    """(query_id, doc_id, rank, cluster) from (query_id, doc_id, video_id, relevance, words): maximal marginal relevance and leader clusters.

    Both are folds over the ranked list of a query, which must have been cut to a stated length before; each
    query is one group.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["relevance"], r["doc_id"]))
        words = [frozenset(r["words"] or ()) for r in rows]
        like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        leaders: list[frozenset] = []
        cluster = []
        for w in words:
            at = next((i for i, x in enumerate(leaders) if like(w, x) >= same), len(leaders))
            if at == len(leaders):
                leaders.append(w)
            cluster.append(at)
        left, taken, videos, near = list(range(len(rows))), [], {}, [0.0] * len(rows)
        while left and len(taken) < most:
            open_ = [i for i in left if videos.get(rows[i]["video_id"], 0) < per_video]
            if not open_:
                break
            at = max(open_, key=lambda i: (balance * rows[i]["relevance"] - (1 - balance) * near[i], -i))
            left.remove(at)
            taken.append(at)
            videos[rows[at]["video_id"]] = videos.get(rows[at]["video_id"], 0) + 1
            for i in left:
                near[i] = max(near[i], like(words[i], words[at]))
        return pa.table({"query_id": pa.array([rows[i]["query_id"] for i in taken], pa.string()), "doc_id": pa.array([rows[i]["doc_id"] for i in taken], pa.string()), "rank": pa.array(range(1, len(taken) + 1), pa.int32()), "cluster": pa.array([cluster[i] for i in taken], pa.int32())})

    rows = graded.select(F.col("query_id").cast("string"), F.col("doc_id").cast("string"), "video_id", "relevance", "words")
    return rows.groupBy("query_id").applyInArrow(run, "query_id string, doc_id string, rank int, cluster int")


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\b[0-9][0-9.,]*)"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]+$", ""))


def count_answers(cand: DataFrame) -> DataFrame:
    """Numbers in the evidence texts of candidates (query_id, doc_id, target, texts) that share a word with the question's target."""
    each = cand.select("query_id", "doc_id", "target", F.explode("texts").alias("t"))
    related = F.arrays_overlap(T.words_of(T.normalize(F.col("target"))), T.words_of(T.normalize(F.col("t"))))
    return each.where(related).select("query_id", "doc_id", F.explode(numbers(F.col("t"))).alias("answer"), F.lit(0.72).alias("confidence"), F.lit("count").alias("answer_type")).distinct()


def label_answers(cand: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent labels of candidates (query_id, doc_id, labels), as entities; ties by first appearance."""
    each = cand.select("query_id", "doc_id", F.posexplode("labels").alias("pos", "answer")).groupBy("query_id", "doc_id", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("n"), "pos")
    ranked = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return ranked.select("query_id", "doc_id", "answer", F.least(0.35 + 0.1 * F.col("n"), F.lit(0.7)).alias("confidence"), F.lit("entity").alias("answer_type"))


def written_answers(cand: DataFrame, most: int = 3) -> DataFrame:
    """The longest written texts of candidates (query_id, doc_id, ocr_texts)."""
    each = cand.select("query_id", "doc_id", F.explode(F.array_distinct(F.transform("ocr_texts", lambda t: F.trim(t)))).alias("answer")).where("answer <> ''")
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc(F.length("answer")), "answer")
    ranked = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return ranked.select("query_id", "doc_id", "answer", F.when(F.col("r") == 1, 0.75).otherwise(0.45).alias("confidence"), F.lit("ocr_text").alias("answer_type"))


def spoken_answers(cand: DataFrame) -> DataFrame:
    """What is said in candidates (query_id, doc_id, spoken), up to 200 characters."""
    return cand.where("trim(spoken) <> ''").select("query_id", "doc_id", F.left(F.trim("spoken"), F.lit(200)).alias("answer"), F.lit(0.55).alias("confidence"), F.lit("asr_text").alias("answer_type"))


def yes_no_answers(cand: DataFrame) -> DataFrame:
    """Yes if the evidence (normalized) holds at least 0.6 of the longer words of the target (normalized), also inside words."""
    wanted = F.array_distinct(F.filter(T.words_of(F.col("target")), lambda w: F.length(w) >= 3))
    share = F.size(F.filter(wanted, lambda w: F.contains(F.col("evidence"), w))) / F.size(wanted)
    rows = cand.where(F.size(wanted) > 0).withColumn("share", share)
    return rows.select("query_id", "doc_id", F.when(F.col("share") >= 0.6, "có").otherwise("không").alias("answer"), F.least(0.4 + F.abs(F.col("share") - 0.5), F.lit(0.85)).alias("confidence"), F.lit("yes_no").alias("answer_type"))


def temporal_answers(cand: DataFrame) -> DataFrame:
    """When a candidate starts, in whole seconds."""
    return cand.select("query_id", "doc_id", F.concat(F.bround("start_sec", 0).cast("long"), F.lit("s")).alias("answer"), F.lit(0.4).alias("confidence"), F.lit("temporal").alias("answer_type"))


def verify(answer: Column, answer_type: Column, evidence_text: Column) -> Column:
    """SUPPORTED if the evidence holds the answer, else what can be said for its type."""
    text, said = T.normalize(evidence_text), T.normalize(answer)
    held = numbers(evidence_text)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "INSUFFICIENT")
        .when((said != "") & F.contains(text, said), "SUPPORTED")
        .when(answer_type.isin("yes_no", "temporal"), "PARTIAL")
        .when((answer_type == "count") & (F.size(held) > 0) & ~F.array_contains(held, answer), "CONTRADICTED")
        .otherwise("INSUFFICIENT")
    )


def rank_answers(answers: DataFrame, most: int = 100) -> DataFrame:
    """Joint rank of (query_id, video_id, frame_idx, answer, score, confidence, status): distinct answers of a frame, best first."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    weight = F.lit(0.0)
    for status, w in VERIFIED.items():
        weight = F.when(F.col("status") == status, w).otherwise(weight)
    joint = F.round(F.greatest(F.col("score") / best, F.lit(0.05)) * F.col("confidence") * weight, 6)
    rows = answers.withColumn("joint", joint).where("joint > 0").withColumn("said", T.normalize(F.col("answer")))
    first = Window.partitionBy("query_id", "video_id", "frame_idx", "said").orderBy(F.desc("joint"), "answer")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("joint"), "video_id", "frame_idx", "said"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("__n", "said")


def evidence_answers(hits: DataFrame) -> DataFrame:
    """(query_id, answer): the evidence of the hits (query_id, rank, scene_id, text) as lines, without any model."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("scene_id"), F.lit("] "), F.left("text", F.lit(500))).alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("answer"))


def score_with(model, column: str, out: str = "model_score"):
    """A function that adds the scores of ``model`` (list of texts -> list of numbers) to a table by Arrow batches: the hook for external models."""

    def apply(df: DataFrame) -> DataFrame:
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                scores = model([t or "" for t in b.column(names.index(column)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*names, out])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))

    return apply
