"""What the queries share: current tables, ranked lists, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval
from ..runtime import checkpoint, table
from ..sources import tables

TOP = 20


def scenes(spark: SparkSession, d: str) -> DataFrame:
    return tables.current(table(spark, d, "scenes"), "scene_id")


def keyframes(spark: SparkSession, d: str) -> DataFrame:
    return tables.current(table(spark, d, "keyframes"), "keyframe_id")


def kis(spark: SparkSession, d: str) -> DataFrame:
    return tables.current(table(spark, d, "kis_queries"), "query_id")


def videos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "videos").select("video_id", "fps", "frame_count", "duration_sec").distinct()


def documents(spark: SparkSession, d: str) -> DataFrame:
    return tables.scene_documents(scenes(spark, d), keyframes(spark, d))


def speech(spark: SparkSession, d: str) -> DataFrame:
    """(video_id, scene_id, segment_id, seg_start, seg_end, text) of all current scenes."""
    each = scenes(spark, d).select("video_id", "scene_id", F.explode("asr_segments").alias("a"))
    return each.select("video_id", "scene_id", "a.segment_id", F.col("a.start_sec").alias("seg_start"), F.col("a.end_sec").alias("seg_end"), "a.text")


FIELDS = {"caption": "captions", "asr": "asr_texts", "keyword": "keywords"}


def lexical(spark: SparkSession, d: str, branch: str, k: int | None = TOP, docs: DataFrame | None = None) -> DataFrame:
    """The BM25 list of one field for all known-item queries."""
    queries = kis(spark, d).select("query_id", "query")
    docs = tables.scene_texts(table(spark, d, "scenes"), table(spark, d, "keyframes"), FIELDS[branch]) if docs is None else docs
    found = (docs, "scene_id", T.tokens(F.array_join(FIELDS[branch], " ")), queries, T.tokens(F.col("query")))
    return retrieval.bm25_top(*found, k) if k else retrieval.top_k(retrieval.bm25(*found), None)


def branches(spark: SparkSession, d: str) -> DataFrame:
    """The lists of all fields, from one table of documents."""
    docs = checkpoint(documents(spark, d).select("scene_id", *FIELDS.values()))
    return retrieval.union_branches({b: lexical(spark, d, b, docs=docs) for b in FIELDS})


def event_lists(spark: SparkSession, d: str) -> DataFrame:
    """The events table as ranked lists: one per user and kind, scored by value."""
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("branch"), F.col("event_id").alias("doc_id"), F.round("value", 6).alias("score"))
    return retrieval.top_k(e, None, ["query_id", "branch"])


def event_results(spark: SparkSession, d: str) -> DataFrame:
    """The events table as one result list per kind of event: users are videos, hours are scenes, the number in props an event."""
    e = table(spark, d, "events")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    out = e.select(
        F.col("event_type").alias("query_id"), F.format_string("%08d", "event_id").alias("doc_id"), F.concat(F.lit("v"), "user_id").alias("video_id"),
        F.concat_ws("_", F.lit("s"), "user_id", F.date_format("ts", "yyyyMMddHH")).alias("scene_id"), F.concat_ws("_", F.lit("e"), "user_id", F.get_json_object("props", "$.k")).alias("event_id"),
        F.floor(sec * 25).cast("long").alias("frame_idx"), sec.alias("timestamp_sec"), F.round("value", 6).alias("score"),
    )
    return retrieval.top_k(out, None)


# --- SQL ---

TOKENS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


def normalize_sql(c: str) -> str:
    bare = f"replace(replace(strip_accents({c}), 'đ', 'd'), 'Đ', 'D')"
    return rf"trim(regexp_replace(regexp_replace(replace(lower({bare}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def current_sql(name: str, source: str, key: str) -> str:
    return f"{name} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC NULLS LAST) AS r FROM {source} WHERE {key} IS NOT NULL) WHERE r = 1)"


CURRENT = "WITH " + ",\n".join([current_sql("sc", "scenes", "scene_id"), current_sql("kf", "keyframes", "keyframe_id"), current_sql("qy", "kis_queries", "query_id")])
SPEECH = "sp AS (SELECT video_id, scene_id, a.segment_id AS segment_id, a.start_sec AS seg_start, a.end_sec AS seg_end, a.text AS text FROM (SELECT video_id, scene_id, unnest(asr_segments) AS a FROM sc))"
TEXTS = {
    "caption": "SELECT scene_id, c.text AS t FROM (SELECT scene_id, unnest(captions) AS c FROM sc) WHERE trim(c.text) <> '' UNION ALL SELECT scene_id, c.text FROM (SELECT scene_id, unnest(captions) AS c FROM kf WHERE scene_id IN (SELECT scene_id FROM sc)) WHERE trim(c.text) <> ''",
    "asr": "SELECT scene_id, t FROM (SELECT scene_id, coalesce(a.normalized_text, a.text) AS t FROM (SELECT scene_id, unnest(asr_segments) AS a FROM sc)) WHERE trim(t) <> ''",
    "keyword": "SELECT scene_id, t FROM (SELECT scene_id, coalesce(k.normalized_text, k.text) AS t FROM (SELECT scene_id, unnest(keywords) AS k FROM sc)) WHERE trim(t) <> ''",
    "ocr": "SELECT scene_id, o.text AS t FROM (SELECT scene_id, unnest(ocr_instances) AS o FROM kf WHERE scene_id IN (SELECT scene_id FROM sc)) WHERE trim(o.text) <> ''",
}


def bm25_sql(branch: str, k: int | None = TOP) -> str:
    """CTEs (after CURRENT) ending in l_{branch}(query_id, doc_id, score, rank)."""
    b = branch
    top = f" WHERE rank <= {k}" if k else ""
    return f""",
tf_{b} AS (SELECT scene_id AS d, tok, count(*) AS tf FROM (SELECT scene_id, unnest({tokens_sql("t")}) AS tok FROM ({TEXTS[b]})) GROUP BY 1, 2),
ln_{b} AS (SELECT d, sum(tf) AS len FROM tf_{b} GROUP BY 1),
df_{b} AS (SELECT tok, count(*) AS df FROM tf_{b} GROUP BY 1),
st_{b} AS (SELECT (SELECT count(*) FROM sc) AS n, greatest(CAST((SELECT sum(len) FROM ln_{b}) AS DOUBLE) / (SELECT count(*) FROM sc), 1e-9) AS mean),
qt_{b} AS (SELECT query_id, tok, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql("query")}) AS tok FROM qy) GROUP BY 1, 2),
s_{b} AS (SELECT query_id, d AS doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM qt_{b} JOIN tf_{b} USING (tok) JOIN ln_{b} USING (d) JOIN df_{b} USING (tok), st_{b} GROUP BY 1, 2),
l_{b} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s_{b} WHERE score > 0){top})"""


BRANCHES = CURRENT + "".join(map(bm25_sql, FIELDS)) + ",\nlists AS (" + " UNION ALL ".join(f"SELECT query_id, '{b}' AS branch, doc_id, score, rank FROM l_{b}" for b in FIELDS) + ")\n"
EVENT_LISTS = "WITH l AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, doc_id) AS rank FROM (SELECT user_id AS query_id, event_type AS branch, event_id AS doc_id, round(value, 6) AS score FROM events))\n"
EVENT_RESULTS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT event_type AS query_id, printf('%08d', event_id) AS doc_id, 'v' || user_id AS video_id, 's_' || user_id || '_' || strftime(ts, '%Y%m%d%H') AS scene_id,
    'e_' || user_id || '_' || (props->>'$.k') AS event_id, CAST(floor(epoch_us(ts) / 1e6 * 25) AS BIGINT) AS frame_idx, epoch_us(ts) / 1e6 AS timestamp_sec, round(value, 6) AS score FROM events))
"""
