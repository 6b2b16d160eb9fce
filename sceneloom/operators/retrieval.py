"""Retrieval branches: each gives scored candidates (query_id, doc_id, score) for a whole batch of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..runtime import checkpoint
from . import pruned

K1, B = 1.5, 0.75
DIGITS = 6


def top_k(scored: DataFrame, k: int | None, keys: list[str] | None = None, score: str = "score", tie: str = "doc_id", out: str = "rank") -> DataFrame:
    """Ranks from 1 by score, ties by id; the first k of each query, if k is given."""
    w = Window.partitionBy(*(keys or ["query_id"])).orderBy(F.desc(score), tie)
    ranked = scored.withColumn(out, F.row_number().over(w))
    return ranked.where(F.col(out) <= k) if k else ranked


def postings(docs: DataFrame, doc_id: str, words: Column) -> DataFrame:
    """(doc_id, token, tf): the inverted index of a table, to be written once and read by many searches."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(words).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, doc_id: str, words: Column, queries: DataFrame, query_words: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score): documents that share a word with the query.

    Documents without words count in the number of documents. A word that a query repeats counts as often.
    Only postings of words that some query has meet the queries; lengths travel with the postings.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), words.alias("w")).withColumn("len", F.size("w"))
    n, total = sized.agg(F.count(F.lit(1)), F.sum("len")).first()
    mean = F.lit(max((total or 0) / max(n, 1), 1e-9))
    index = sized.select("doc_id", "len", F.explode("w").alias("token")).groupBy("doc_id", "len", "token").agg(F.count(F.lit(1)).alias("tf"))
    asked = queries.select("query_id", F.explode(query_words).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    index = index.join(asked.select("token").distinct(), "token", "left_semi")
    df = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.join(asked, "token").select("query_id", "token", (idf * F.col("times")).alias("w"))
    tf = F.col("tf")
    part = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))
    return index.join(weighted, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score")).where("score > 0")


#: Bytes of a block of query vectors.
BLOCK_BYTES = 64 << 20


class _Lists:
    """The best k of each query from parts that come in any order; ties at the border stay, so that a merge can order them by id."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.held, self.pruned = k, [], 0, 0

    def add(self, q, d: pa.Array, s) -> None:
        self.parts.append((q, d, s))
        self.held += len(q)
        if self.held > 100_000 + 4 * self.pruned:
            self.prune()
            self.pruned = self.held

    def prune(self):
        import numpy as np

        if not self.parts:
            return None
        q, s = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        d = pa.concat_arrays([p[1] for p in self.parts])
        order = np.lexsort((-s, q))
        q, s = q[order], s[order]
        first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, int)
        size = np.diff(np.append(first, len(q)))
        border = s[np.minimum(first + self.k, first + size) - 1]
        keep = s >= np.repeat(border, size)
        self.parts, self.held = [(q[keep], d.take(pa.array(order[keep])), s[keep])], int(keep.sum())
        return self.parts[0]


def bm25_top(docs: DataFrame, doc_id: str, words: Column, queries: DataFrame, query_words: Column, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank): the first k documents of each query by ``bm25``, without its pairs (see ``pruned.best``).

    ``docs`` is written once, as counts and scores both read it.
    """
    asked = queries.select(F.col("query_id").alias("query_id"), F.explode(query_words).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times")).withColumn("n", F.lit(1))
    sized = checkpoint(docs.select(F.col(doc_id).alias("doc_id"), words.alias("w")))
    n, total = sized.agg(F.count(F.lit(1)), F.sum(F.size("w"))).first()
    return pruned.best(sized, asked, k, *bm25_parts(n, (total or 0) / max(n, 1), k1, b)).select("query_id", "doc_id", "score", "rank")


def bm25_parts(n: int, mean: float, k1: float = K1, b: float = B):
    """What a word counts by its number of documents, and what a document gains by a word's frequency and its own length."""
    mean = max(mean, 1e-9)

    def weight(df):
        import numpy as np

        return np.log1p((n - df + 0.5) / (df + 0.5))

    return weight, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def cosine_search(queries: DataFrame, vectors: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine of a stated query set (query_id, vector) against all rows (doc_id, vector).

    The queries are cut into blocks of a bounded size, each of which is sent to the rows. A batch of rows meets a
    block as one matrix product; a task passes on its best k per query.
    """
    cut = checkpoint(queries.select("query_id", V.unit(F.col("vector")).alias("qv")).where("qv is not null"))
    rows = vectors.select("doc_id", V.unit(F.col("vector")).alias("v")).where("v is not null")
    size = cut.agg(F.sum(F.size("qv") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    qtype, dtype = cut.schema["query_id"].dataType, rows.schema["doc_id"].dataType
    schema = f"query_id {qtype.simpleString()}, doc_id {dtype.simpleString()}, score double"

    def against(block: int) -> DataFrame:
        sent = cut.sparkSession.sparkContext.broadcast(cut.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            asked = sent.value
            if not asked.num_rows:
                return
            ids = asked["query_id"].combine_chunks()
            q = pa.compute.list_flatten(asked["qv"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(asked.num_rows, -1)
            best = _Lists(k)
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    use = np.flatnonzero(pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False) == q.shape[1])
                    if not len(use):
                        continue
                    part = part.take(pa.array(use))
                    s = np.round(q @ pa.compute.list_flatten(part.column(1)).to_numpy(zero_copy_only=False).reshape(len(use), -1).T, DIGITS)
                    few = min(k, len(use))
                    x, y = np.nonzero(s >= -np.partition(-s, few - 1, axis=1)[:, few - 1 : few])
                    best.add(x, part.column(0).take(pa.array(y)), s[x, y])
            if (out := best.prune()) is not None:
                x, d, s = out
                yield pa.record_batch([ids.take(pa.array(x)), d, pa.array(s)], names=["query_id", "doc_id", "score"])

        return rows.mapInArrow(run, schema)

    return top_k(reduce(DataFrame.unionByName, map(against, range(blocks))), k)


def tag_overlap(queries: DataFrame, docs: DataFrame, doc_id: str = "doc_id", tags: str = "tags") -> DataFrame:
    """(query_id, doc_id, score): share of the query's tags that the document has; queries without tags give nothing."""
    asked = queries.select("query_id", F.size(tags).alias("n"), F.explode(F.array_distinct(tags)).alias("tag"))
    held = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(tags)).alias("tag"))
    return asked.join(held, "tag").groupBy("query_id", "doc_id").agg(F.round(F.count(F.lit(1)) / F.max("n"), DIGITS).alias("score"))


def trigram_overlap(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): share of the query's trigrams that the document has, both texts normalized (column ``text``).

    An equi-join on trigrams: only pairs that share one meet.
    """
    asked = queries.select("query_id", T.trigrams(F.col("text")).alias("g")).select("query_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    held = docs.select("doc_id", F.explode(T.trigrams(F.col("text"))).alias("gram"))
    return asked.join(held, "gram").groupBy("query_id", "doc_id").agg(F.round(F.count(F.lit(1)) / F.max("n"), DIGITS).alias("score"))


def trigram_top(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the first k of ``trigram_overlap``, without its pairs (see ``pruned.best``)."""
    grams = T.trigrams(F.col("text"))
    return _shared_top(queries.select("query_id", F.size(grams).alias("n"), grams.alias("w")), docs.select("doc_id", T.trigrams(F.col("text")).alias("w")), k)


def tag_overlap_top(queries: DataFrame, docs: DataFrame, k: int, doc_id: str = "doc_id", tags: str = "tags") -> DataFrame:
    """(query_id, doc_id, score, rank): the first k of ``tag_overlap``, without its pairs."""
    return _shared_top(queries.select("query_id", F.size(tags).alias("n"), F.array_distinct(tags).alias("w")), docs.select(F.col(doc_id).alias("doc_id"), F.array_distinct(tags).alias("w")), k)


def _shared_top(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    asked = queries.select("query_id", "n", F.explode("w").alias("token"), F.lit(1).alias("times"))
    return pruned.best(checkpoint(docs), asked, k).select("query_id", "doc_id", "score", "rank")


def fuzzy_search(queries: DataFrame, docs: DataFrame, shortlist: int, k: int, least: float = 0.35) -> DataFrame:
    """(query_id, doc_id, score, rank): the shortlist by trigrams, reordered by sequence matching of normalized texts.

    Queries and documents of the same text are one: the best texts, ties by the least id of their documents, hold all documents of
    the shortlist. Texts travel in the ids of the search, so that its lists are scored where they are merged.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    w = Window.partitionBy("text").orderBy("doc_id")
    held = checkpoint(docs.select("doc_id", "text").withColumn("place", F.row_number().over(w)).where(F.col("place") <= shortlist))
    texts = held.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).cast("string").alias("n"))
    texts = texts.repartition(parts, "text").select(F.concat_ws("\0", "doc_id", "n", "text").alias("doc_id"), T.trigrams(F.col("text")).alias("w"))
    # a table, so that trigrams are taken once a text and not once a trigram
    asked = checkpoint(queries.select("text").distinct().repartition(parts, "text").select(F.col("text").alias("query_id"), T.trigrams(F.col("text")).alias("w")))
    asked = asked.select("query_id", F.size("w").alias("n"), F.explode("w").alias("token"), F.lit(1).alias("times"))
    hits = pruned.best(checkpoint(texts), asked, shortlist, then=(_fuzzy_hits(shortlist, least), "q string, text string, level double, room long, score double"))
    level = Window.partitionBy("q", "level").orderBy("doc_id")
    short = hits.join(held, "text").where("place <= room").withColumn("at", F.row_number().over(level)).where("at <= room")
    scored = short.select("q", "doc_id", F.round("score", DIGITS).alias("score")).where(F.col("score") >= least)
    found = scored.join(queries.select("query_id", F.col("text").alias("q")), "q").select("query_id", "doc_id", "score")
    return top_k(found, k)


def _fuzzy_hits(shortlist: int, least: float):
    """What is needed of the best texts of some queries: those that reach ``least``, and all texts of the same trigram score where not all of their documents are in the shortlist; how many of them are (``room``)."""

    def run(t: pa.Table) -> pa.Table:
        import numpy as np

        from ..functions.likeness import fuzzy_scores

        asked, held = (t[c].combine_chunks().dictionary_encode() for c in ("query_id", "doc_id"))
        q, d = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (asked, held))
        keys = [x.split("\0", 2) for x in held.dictionary.to_pylist()]
        texts = [x[2] for x in keys]
        size, level = np.array([int(x[1]) for x in keys], np.int64)[d], t["score"].to_numpy()
        order = np.lexsort((-level, q))
        q, d, size, level = q[order], d[order], size[order], level[order]
        score = fuzzy_scores(asked.dictionary.to_pylist(), texts, q, d, least)
        good = score >= least - 1e-6
        # documents of better levels of the query, and of the level itself
        new = np.append(True, (q[1:] != q[:-1]) | (level[1:] != level[:-1]))[: len(q)]
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.cumsum(size) - size
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        room = shortlist - (total[first] - total[begin][np.searchsorted(begin, first, "right") - 1])
        whole = np.bincount(of, size, len(first)) <= room
        wanted = np.bincount(of[good], minlength=len(first)) > 0
        keep = np.flatnonzero((good | (wanted & ~whole)[of]) & (room > 0)[of])
        names = pa.array(texts, pa.string())
        return pa.table({"q": asked.dictionary.take(pa.array(q[keep])), "text": names.take(pa.array(d[keep])), "level": pa.array(level[keep]), "room": pa.array(room[of[keep]]), "score": pa.array(np.where(good, score, 0.0)[keep])})

    return run


def event_fan_out(events: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Ranked events (query_id, event_id, score, rank) as their scenes (event_id, scene_ids), in order, up to k per query."""
    spread = events.join(members, "event_id").select("query_id", "event_id", "score", "rank", F.posexplode("scene_ids").alias("pos", "scene_id"))
    w = Window.partitionBy("query_id").orderBy("rank", "pos")
    return spread.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "event_id", "scene_id", "score", F.col("r").alias("rank"))


def union_branches(branches: dict[str, DataFrame]) -> DataFrame:
    """One candidate relation (query_id, branch, doc_id, score, rank); a branch that isn't wanted is left out of the plan."""
    return reduce(DataFrame.unionByName, [df.select("query_id", F.lit(name).alias("branch"), "doc_id", "score", "rank") for name, df in branches.items()])


def branch_status(candidates: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch, state, candidates) of every registered branch (branch, enabled): success, empty or disabled."""
    n = candidates.groupBy("branch").agg(F.count(F.lit(1)).alias("candidates"))
    state = F.when(~F.col("enabled"), "disabled").when(F.col("candidates") > 0, "success").otherwise("empty")
    return branches.join(n, "branch", "left").select("branch", state.alias("state"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


#: States of a branch, from the best to the worst.
SEVERITY = ("disabled", "empty", "success", "unavailable", "timeout", "failed")


def merge_status(rows: DataFrame, by: list[str]) -> DataFrame:
    """The states (by, state, below) of several searches as one: the worst state, and all results below a threshold."""
    return rows.groupBy(*by).agg(F.max_by("state", F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("state"))).alias("state"), F.sum("below").alias("below"))


def search_filter(df: DataFrame, video_ids: list[str] | None = None, scene_ids: list[str] | None = None, has_ocr: bool | None = None, has_asr: bool | None = None, start_sec_gte: float | None = None, end_sec_lte: float | None = None) -> DataFrame:
    """The conjunction of the given conditions; an empty list is no condition."""
    if start_sec_gte is not None and end_sec_lte is not None and end_sec_lte < start_sec_gte:
        raise ValueError("the time range is reversed")
    for name, value in (("video_id", video_ids), ("scene_id", scene_ids)):
        if value:
            df = df.where(F.col(name).isin(*value))
    for name, flag in (("has_ocr", has_ocr), ("has_asr", has_asr)):
        if flag is not None:
            df = df.where(F.col(name) == flag)
    if start_sec_gte is not None:
        df = df.where(F.col("start_sec") >= start_sec_gte)
    return df.where(F.col("end_sec") <= end_sec_lte) if end_sec_lte is not None else df
