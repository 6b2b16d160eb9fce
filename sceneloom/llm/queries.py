"""Queries of the problems on text and vectors (2, 3, 6, 7, 8), and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import charmap, knn, leakage, normalize, packing, readability


def _captions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "keyframes").select("keyframe_id", F.explode("captions.text").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "kis_queries").select("query_id", F.col("query").alias("text"))
    return normalize.same_look(queries, "query_id", _captions(spark, d), "keyframe_id")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text of both fields in its one form."""
    queries = table(spark, d, "kis_queries").select(F.lit("kis_queries.query").alias("field"), F.col("query_id").alias("key"), F.col("query").alias("text"))
    captions = _captions(spark, d).select(F.lit("keyframes.captions.text").alias("field"), F.col("keyframe_id").alias("key"), "text")
    return normalize.with_form(queries.unionByName(captions).distinct(), "text", "form").select("field", "key", "form", (F.col("form") != F.col("text")).alias("changed")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, with the number of documents that hold them."""
    found = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return found.join(table(spark, d, "eval_items").select("item_id", "task"), "item_id").select("item_id", "task", "documents")


QUERIES = {f.__name__: f for f in (p2_found, p2_forms, p7_found, p7_items)}

def _forms_sql() -> str:
    """The forms once more, in another way than the operator's: texts as rows of characters, joined with the table of characters."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    chars = ", ".join(f"({quoted(c)}, {quoted(to)})" for c, to in charmap.table().items())
    return f"""
WITH m(c, becomes) AS (VALUES {chars}),
src AS (SELECT DISTINCT 'q' AS side, query_id AS k, query AS text FROM kis_queries WHERE query IS NOT NULL UNION SELECT 'c', keyframe_id, text FROM (SELECT keyframe_id, unnest(captions).text AS text FROM keyframes) WHERE text IS NOT NULL),
texts AS (SELECT DISTINCT text FROM src),
letters AS (SELECT text, unnest(range(1, length(text) + 1)) AS i, unnest(regexp_extract_all(text, '(?s).')) AS c FROM texts),
formed AS (SELECT text, nfc_normalize(string_agg(coalesce(becomes, c), '' ORDER BY i)) AS form FROM letters LEFT JOIN m USING (c) GROUP BY 1),
f AS (SELECT side, k, text, coalesce(form, '') AS form FROM src LEFT JOIN formed USING (text)),
q AS (SELECT k AS query_id, text, form FROM f WHERE side = 'q'), c AS (SELECT k AS keyframe_id, text, form FROM f WHERE side = 'c')
"""


_FORMS = _forms_sql()
_WORDS_P7 = r"list_filter(string_split(trim(regexp_replace(replace(replace(lower(strip_accents(nfc_normalize(form))), 'đ', 'd'), 'ß', 'ss'), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' '), lambda x: x <> '')"

ORACLE = {
    "p2_found": _FORMS + "SELECT DISTINCT query_id, keyframe_id FROM q JOIN c USING (form) WHERE q.text <> c.text AND form <> ''",
    "p2_forms": _FORMS
    + "SELECT DISTINCT 'kis_queries.query' AS field, query_id AS key, form, form <> text AS changed FROM q UNION SELECT 'keyframes.captions.text', keyframe_id, form, form <> text FROM c",
}


def _leaks_sql() -> str:
    """Every run of ten words of every document, against those of the items."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    chars = ", ".join(f"({quoted(c)}, {quoted(to)})" for c, to in charmap.table().items())
    following = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, 10))
    return f"""
WITH m(c, becomes) AS (VALUES {chars}),
src AS (SELECT 'd' AS side, doc_id AS k, text FROM documents WHERE text IS NOT NULL UNION SELECT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL),
odd AS (SELECT side, k, string_split(text, ' ') AS p FROM src),
words AS (SELECT DISTINCT w FROM (SELECT unnest(p) AS w FROM odd) WHERE regexp_matches(w, '[^ -~]')),
mapped AS (SELECT w, string_agg(coalesce(becomes, c), '' ORDER BY i) AS f FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i, unnest(regexp_extract_all(w, '(?s).')) AS c FROM words) LEFT JOIN m USING (c) GROUP BY 1),
parts AS (SELECT side, k, unnest(p) AS w, unnest(range(len(p))) AS n FROM odd),
texts AS (SELECT side, k, string_agg(coalesce(f, w), ' ' ORDER BY n) AS form FROM parts LEFT JOIN mapped USING (w) GROUP BY 1, 2),
tokens AS (SELECT side, k, unnest(ws) AS w, unnest(range(len(ws))) AS n FROM (SELECT side, k, {_WORDS_P7} AS ws FROM texts)),
runs AS (SELECT side, k, hash(w, {following}) AS run, lead(w, 9) OVER o AS last FROM tokens WINDOW o AS (PARTITION BY side, k ORDER BY n)),
d AS (SELECT k, run FROM runs WHERE side = 'd' AND last IS NOT NULL), i AS (SELECT DISTINCT k, run FROM runs WHERE side = 'i' AND last IS NOT NULL),
found AS (SELECT DISTINCT d.k AS doc_id, i.k AS item_id FROM d JOIN i USING (run))
"""


ORACLE["p7_found"] = _leaks_sql() + "SELECT doc_id, item_id FROM found"
ORACLE["p7_items"] = _leaks_sql() + "SELECT item_id, task, count(*) AS documents FROM found JOIN (SELECT DISTINCT item_id, task FROM eval_items) USING (item_id) GROUP BY 1, 2"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scene_index").select(F.col("payload.scene_id").alias("scene_id"), "vector", "loaded_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = knn.similar_vectors(_vectors(spark, d), "scene_id", "vector", 10, 0.90, loaded_at="loaded_at")
    return near.select(F.least("id", "neighbour").alias("scene_id_a"), F.greatest("id", "neighbour").alias("scene_id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar scenes, whatever their similarity, of every scene whose index is divisible by 50, against all rows."""
    near = knn.similar_vectors(_vectors(spark, d), "scene_id", "vector", 10, loaded_at="loaded_at", asks="try_cast(regexp_extract(id, '(\\\\d+)$', 1) AS bigint) % 50 = 0")
    return near.select(F.col("id").alias("scene_id"), "neighbour", F.col("rank").cast("long").alias("rank"), F.round("similarity", 3).alias("similarity"))


QUERIES |= {f.__name__: f for f in (p3_found, p3_neighbours)}

_UNIT = """
WITH latest AS (SELECT payload.scene_id AS id, arg_max(CAST(vector AS DOUBLE[]), loaded_at) AS v FROM scene_index WHERE vector IS NOT NULL AND len(vector) = 64 GROUP BY 1),
u AS (SELECT id, CAST(v AS DOUBLE[64]) AS v FROM latest WHERE list_sum(list_transform(v, lambda x: x * x)) > 0)
"""
ORACLE["p3_found"] = (
    _UNIT
    + """, s AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= 0.90)
SELECT DISTINCT least(a, b) AS scene_id_a, greatest(a, b) AS scene_id_b FROM r WHERE r <= 10"""
)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each kind, how full they are, how many plain best fit of the shards takes, and how many there must be at least."""

    def used(rows: DataFrame) -> DataFrame:
        return rows.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"))

    plain = used(packing.fill_containers(table(spark, d, "documents"), table(spark, d, "container_sizes"), plain=True)).groupBy("container_kind").agg(F.count(F.lit(1)).alias("best_fit"))
    sizes = table(spark, d, "container_sizes").groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    return (
        used(p6_containers(spark, d)).groupBy("container_kind")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .join(sizes, "container_kind").join(plain, "container_kind")
        .select("container_kind", "capacity", "containers", "best_fit", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), F.round(F.col("tokens") / F.col("containers") / F.col("capacity"), 4).alias("filled"))
    )


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).withColumn("grade", F.round("grade", 3))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by level, source and language of the text."""
    levels = readability.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    named = levels.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return named.groupBy("level", "source", "language").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.round(F.avg("grade"), 2).alias("mean_grade"))


QUERIES |= {f.__name__: f for f in (p6_containers, p6_summary, p8_levels, p8_profile)}
