"""Queries of joins over media time, windows, quality checks, metrics, tasks, ordered steps and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest, joins, media, metrics, quality, retrieval, sequences, tasks
from ..runtime import shared_dir, table
from ..streaming import windows
from . import common as C

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- joins ---


@query(C.CURRENT + "SELECT keyframe_id, in_scene FROM (SELECT keyframe_id, s.scene_id AS in_scene, row_number() OVER (PARTITION BY keyframe_id ORDER BY start_frame, s.scene_id) AS r FROM kf k JOIN sc s ON k.video_id = s.video_id AND frame_idx >= start_frame AND frame_idx < end_frame_exclusive) WHERE r = 1")
def keyframe_scenes(spark: SparkSession, d: str) -> DataFrame:
    return joins.keyframes_in_scenes(C.keyframes(spark, d), C.scenes(spark, d))[0].select("keyframe_id", "in_scene")


@query(C.CURRENT + "SELECT keyframe_id, video_id, frame_idx FROM kf k WHERE NOT EXISTS (SELECT 1 FROM sc s WHERE k.video_id = s.video_id AND frame_idx >= start_frame AND frame_idx < end_frame_exclusive)")
def keyframe_leftovers(spark: SparkSession, d: str) -> DataFrame:
    return joins.keyframes_in_scenes(C.keyframes(spark, d), C.scenes(spark, d))[1]


_SPEECH = C.CURRENT + ",\n" + C.SPEECH


@query(
    _SPEECH
    + """SELECT scene_id, segment_id, round(a, 6) AS clip_start, round(b, 6) AS clip_end, row_number() OVER (PARTITION BY scene_id ORDER BY a, b, segment_id) - 1 AS number FROM (
SELECT s.scene_id, segment_id, greatest(seg_start, start_sec) AS a, least(seg_end, end_sec) AS b FROM sp JOIN sc s ON sp.video_id = s.video_id AND greatest(seg_start, start_sec) < least(seg_end, end_sec) WHERE trim(text) <> '')"""
)
def speech_clips(spark: SparkSession, d: str) -> DataFrame:
    clips = joins.clip_overlaps(C.speech(spark, d).drop("scene_id"), C.scenes(spark, d).select("video_id", "scene_id", "start_sec", "end_sec"))
    return clips.select("scene_id", "segment_id", F.round("clip_start", 6).alias("clip_start"), F.round("clip_end", 6).alias("clip_end"), F.col("number").cast("long").alias("number"))


@query(
    _SPEECH
    + """, m AS (SELECT segment_id, s.scene_id FROM sp JOIN sc s ON sp.video_id = s.video_id AND least(seg_end, end_sec) - greatest(seg_start, start_sec) >= least(0.75, greatest(0.05, 0.1 * (seg_end - seg_start))) AND greatest(seg_start, start_sec) < least(seg_end, end_sec)),
f AS (SELECT segment_id, s.scene_id, row_number() OVER (PARTITION BY segment_id ORDER BY start_sec, s.scene_id) AS r FROM sp JOIN sc s ON sp.video_id = s.video_id AND (seg_start + seg_end) / 2 >= start_sec AND (seg_start + seg_end) / 2 < end_sec WHERE segment_id NOT IN (SELECT segment_id FROM m))
SELECT segment_id, scene_id, 'overlap' AS how FROM m UNION ALL SELECT segment_id, scene_id, 'middle' FROM f WHERE r = 1"""
)
def speech_aligned(spark: SparkSession, d: str) -> DataFrame:
    return joins.aligned(C.speech(spark, d).drop("scene_id"), C.scenes(spark, d).select("video_id", "scene_id", "start_sec", "end_sec"))


@query(
    C.CURRENT
    + """SELECT left_id, keyframe_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, keyframe_id) AS r FROM (
SELECT s.scene_id AS left_id, k.keyframe_id, round(abs((start_sec + end_sec) / 2 - timestamp_sec), 6) AS gap FROM sc s JOIN kf k ON s.video_id = k.video_id) WHERE gap <= 6) WHERE r = 1"""
)
def nearest_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """The keyframe of the same video nearest to the middle of each scene, at most six seconds away."""
    left = C.scenes(spark, d).select(F.col("scene_id").alias("left_id"), "video_id", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("at"))
    right = C.keyframes(spark, d).select("video_id", "keyframe_id", "timestamp_sec")
    return joins.nearest(left, right, "video_id", "at", "timestamp_sec", 6.0, "keyframe_id").select("left_id", "keyframe_id", F.round("gap", 6).alias("gap"))


@query(
    C.CURRENT
    + "SELECT s.scene_id, a.scene_id AS previous_scene_id, b.scene_id AS next_scene_id FROM sc s LEFT JOIN sc a ON a.video_id = s.video_id AND a.scene_idx = s.scene_idx - 1 LEFT JOIN sc b ON b.video_id = s.video_id AND b.scene_idx = s.scene_idx + 1"
)
def neighbour_scenes(spark: SparkSession, d: str) -> DataFrame:
    return joins.neighbours(C.scenes(spark, d).select("video_id", "scene_idx", "scene_id"), ["scene_id"]).select("scene_id", "previous_scene_id", "next_scene_id")


@query(C.CURRENT + "SELECT query_id, count(*) AS frames FROM qy q JOIN kf k ON k.video_id = q.video_id AND timestamp_sec BETWEEN start_sec AND end_sec GROUP BY 1")
def gold_frames(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes within the closed window of each query."""
    gold = C.kis(spark, d).where("start_sec is not null and end_sec >= start_sec").select("query_id", "video_id", "start_sec", "end_sec")
    met = joins.point_in_interval(C.keyframes(spark, d).select("keyframe_id", "video_id", "timestamp_sec"), gold, "video_id", "timestamp_sec", "start_sec", "end_sec", 60.0, closed=True)
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("frames"))


# --- media time ---

_CLIPS = """, n AS (SELECT scene_id, start_sec AS a, end_sec AS b, greatest(1, CAST(ceil(round((end_sec - start_sec - 4.0) / 2.0, 9)) AS INT) + 1) AS n FROM sc WHERE end_sec > start_sec),
e AS (SELECT *, unnest(range(n)) AS number, n > 1 AND b - (a + (n - 1) * 2.0) < 1.0 AS merged FROM n),
clips AS (SELECT scene_id, number, round(a + number * 2.0, 6) AS start_sec, round(CASE WHEN number = n - 1 - CAST(merged AS INT) THEN b ELSE least(a + number * 2.0 + 4.0, b) END, 6) AS end_sec FROM e WHERE NOT (merged AND number = n - 1))
"""


@query(C.CURRENT + _CLIPS + "SELECT * FROM clips")
def clip_windows(spark: SparkSession, d: str) -> DataFrame:
    return media.clip_windows(C.scenes(spark, d)).select("scene_id", F.col("number").cast("long").alias("number"), "start_sec", "end_sec")


@query(
    C.CURRENT
    + _CLIPS
    + """, m AS (SELECT c.scene_id, number, keyframe_id, timestamp_sec AS t, timestamp_sec >= c.start_sec AND timestamp_sec < c.end_sec AS inside, round(abs(timestamp_sec - (c.start_sec + c.end_sec) / 2), 6) AS gap FROM clips c JOIN kf USING (scene_id)),
w AS (SELECT *, bool_or(inside) OVER (PARTITION BY scene_id, number) AS hit, row_number() OVER (PARTITION BY scene_id, number, inside ORDER BY t, keyframe_id) AS r, row_number() OVER (PARTITION BY scene_id, number ORDER BY gap, t, keyframe_id) AS g FROM m)
SELECT scene_id, number, keyframe_id, 'window' AS how, CAST(0 AS DOUBLE) AS gap FROM w WHERE inside AND r <= 4 UNION ALL SELECT scene_id, number, keyframe_id, 'nearest', gap FROM w WHERE NOT hit AND g = 1 AND gap <= 6"""
)
def clip_frames(spark: SparkSession, d: str) -> DataFrame:
    return media.clip_frames(media.clip_windows(C.scenes(spark, d)), C.keyframes(spark, d)).withColumn("number", F.col("number").cast("long"))


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 600 THEN 0 ELSE 1 END AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS "group" FROM g"""
)
def session_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return media.session_groups(e, "user_id", "t", "t", 600.0, ["t", "event_id"]).select("user_id", "event_id", "group")


_GROUPS = """, o AS (SELECT video_id, scene_id, scene_idx, start_sec AS s, end_sec AS e, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, scene_idx, scene_id) AS i FROM sc),
fold AS (SELECT video_id, scene_id, i, s AS first, e AS last, 0 AS g FROM o WHERE i = 1
 UNION ALL SELECT o.video_id, o.scene_id, o.i, CASE WHEN o.s - f.last > 2 OR o.e - f.first > 60 THEN o.s ELSE f.first END, o.e, f.g + CASE WHEN o.s - f.last > 2 OR o.e - f.first > 60 THEN 1 ELSE 0 END FROM fold f JOIN o ON o.video_id = f.video_id AND o.i = f.i + 1)
"""


@query(C.CURRENT.replace("WITH", "WITH RECURSIVE", 1) + _GROUPS + "SELECT video_id, scene_id, g AS event_idx FROM fold")
def event_groups(spark: SparkSession, d: str) -> DataFrame:
    return media.event_groups(C.scenes(spark, d)).select("video_id", "scene_id", "event_idx")


@query(
    C.CURRENT.replace("WITH", "WITH RECURSIVE", 1)
    + _GROUPS
    + """, ev AS (SELECT video_id, g, count(*) AS scenes, min(first) AS start_sec, max(last) AS end_sec FROM fold GROUP BY 1, 2)
SELECT printf('%s_E%04d', video_id, g) AS event_id, scenes, start_sec, end_sec, CASE WHEN g > 0 THEN printf('%s_E%04d', video_id, g - 1) END AS previous_event_id, lead(printf('%s_E%04d', video_id, g)) OVER (PARTITION BY video_id ORDER BY g) AS next_event_id FROM ev"""
)
def event_table(spark: SparkSession, d: str) -> DataFrame:
    return media.event_table(media.event_groups(C.scenes(spark, d))).select("event_id", F.size("scene_ids").cast("long").alias("scenes"), "start_sec", "end_sec", "previous_event_id", "next_event_id")


@query("SELECT video_id, number, CAST(number * 8 AS DOUBLE) AS start_sec, round(least(CAST((number + 1) * 8 AS DOUBLE), duration_sec), 6) AS end_sec FROM (SELECT video_id, duration_sec, unnest(range(CAST(ceil(round(duration_sec / 8.0, 9)) AS BIGINT))) AS number FROM (SELECT DISTINCT video_id, duration_sec FROM videos))")
def uniform_scenes(spark: SparkSession, d: str) -> DataFrame:
    return media.uniform_scenes(C.videos(spark, d)).withColumn("number", F.col("number").cast("long"))


# --- quality ---


@query(
    C.CURRENT
    + """, len AS (SELECT video_id, max(frame_count) AS n FROM videos GROUP BY 1),
c AS (SELECT *, lag(end_frame_exclusive) OVER (PARTITION BY video_id ORDER BY start_frame, scene_idx, scene_id) AS b FROM sc)
SELECT "check", 'scenes' AS "table", scene_id AS key FROM (
SELECT 'frame_interval' AS "check", scene_id FROM sc WHERE end_frame_exclusive <= start_frame UNION ALL SELECT 'time_interval', scene_id FROM sc WHERE end_sec <= start_sec
UNION ALL SELECT 'derived_id', scene_id FROM sc WHERE scene_id <> printf('%s_S%04d', video_id, scene_idx) UNION ALL SELECT 'overlap', scene_id FROM c WHERE start_frame < b UNION ALL SELECT 'gap', scene_id FROM c WHERE start_frame > b
UNION ALL SELECT 'beyond_video', scene_id FROM sc JOIN len USING (video_id) WHERE end_frame_exclusive > n UNION ALL SELECT 'unknown_video', scene_id FROM sc WHERE video_id NOT IN (SELECT video_id FROM len))"""
)
def scene_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.scene_checks(C.scenes(spark, d), C.videos(spark, d))


@query(
    C.CURRENT
    + """, m AS (SELECT kf.*, sc.start_frame AS a, sc.end_frame_exclusive AS b FROM kf LEFT JOIN sc USING (scene_id))
SELECT 'outside_scene' AS "check", 'keyframes' AS "table", keyframe_id AS key FROM m WHERE frame_idx < a OR frame_idx >= b UNION ALL SELECT 'unknown_scene', 'keyframes', keyframe_id FROM m WHERE a IS NULL
UNION ALL SELECT 'degenerate_box', 'keyframes', keyframe_id FROM kf WHERE len(list_filter(objects, lambda o: o.bbox.x2 <= o.bbox.x1 OR o.bbox.y2 <= o.bbox.y1)) > 0"""
)
def keyframe_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.keyframe_checks(C.keyframes(spark, d), C.scenes(spark, d))


@query(
    """SELECT 'duplicate_key' AS "check", 'scenes' AS "table", scene_id AS key FROM scenes GROUP BY 3 HAVING count(*) > 1 UNION ALL SELECT 'duplicate_key', 'keyframes', keyframe_id FROM keyframes GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'duration', 'videos', video_id FROM (SELECT DISTINCT video_id, fps, frame_count, duration_sec FROM videos) WHERE fps <= 0 OR abs(duration_sec - frame_count / fps) > greatest(0.1, 2 / fps)
UNION ALL SELECT 'id_format', 'scenes', scene_id FROM scenes WHERE NOT regexp_matches(scene_id, '^L\\d{2}_V\\d{3}_S\\d{4,}$')""".replace("\\\\", "\\")
)
def key_quality(spark: SparkSession, d: str) -> DataFrame:
    sc, kf = table(spark, d, "scenes"), table(spark, d, "keyframes")
    return reduce(DataFrame.unionByName, [quality.duplicate_keys(sc, "scenes", "scene_id"), quality.duplicate_keys(kf, "keyframes", "keyframe_id"), quality.video_checks(C.videos(spark, d)), quality.id_format(sc, "scenes", "scene_id")])


@query(_SPEECH + """, m AS (SELECT sp.*, start_sec AS a, end_sec AS b FROM sp JOIN sc USING (scene_id)) SELECT 'speech_interval' AS "check", 'asr_segments' AS "table", segment_id AS key FROM m WHERE seg_end <= seg_start UNION ALL SELECT 'speech_outside_scene', 'asr_segments', segment_id FROM m WHERE seg_start < a OR seg_end > b""")
def speech_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.speech_checks(C.speech(spark, d).join(C.scenes(spark, d).select("scene_id", "start_sec", "end_sec"), "scene_id"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN payload.start_sec IS NULL OR payload.end_sec IS NULL THEN 'no interval' WHEN payload.end_sec <= payload.start_sec THEN 'reversed' WHEN vector IS NULL THEN 'no vector' WHEN len(vector) <> 64 THEN 'short vector' ELSE 'good' END AS reason FROM scene_index) GROUP BY 1")
def quarantined(spark: SparkSession, d: str) -> DataFrame:
    good, bad = quality.quarantine(
        table(spark, d, "scene_index"),
        {"no interval": F.col("payload.start_sec").isNull() | F.col("payload.end_sec").isNull(), "reversed": F.col("payload.end_sec") <= F.col("payload.start_sec"), "no vector": F.col("vector").isNull(), "short vector": F.size("vector") != 64},
    )
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH v AS (SELECT video_id, max(fps) AS fps, max(frame_count) AS n FROM videos GROUP BY 1), r AS (SELECT scenes.video_id, scene_idx AS i, start_frame AS a, end_frame_exclusive - 1 AS b FROM scenes),
m AS (SELECT r.video_id, row_number() OVER (PARTITION BY r.video_id ORDER BY a, i) - 1 AS idx, a, least(b + 1, n) AS e, fps FROM r LEFT JOIN v USING (video_id))
SELECT video_id, count(*) AS scenes, CAST(sum(idx) AS BIGINT) AS numbers, CAST(sum(e - greatest(a, 0)) AS BIGINT) AS frames, round(sum(e / fps), 3) AS ends FROM m WHERE fps IS NOT NULL AND e > greatest(a, 0) GROUP BY 1"""
)
def assembled_scenes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scenes").select("video_id", F.col("scene_idx").alias("scene_index"), "start_frame", (F.col("end_frame_exclusive") - 1).alias("end_frame"))
    out = ingest.assemble_scenes(rows, C.videos(spark, d))[0]
    return out.groupBy("video_id").agg(F.count(F.lit(1)).alias("scenes"), F.sum("scene_idx").alias("numbers"), F.sum(F.col("end_frame_exclusive") - F.col("start_frame")).alias("frames"), F.round(F.sum("end_sec"), 3).alias("ends"))


# --- metrics ---

_HITS = C.CURRENT + C.bm25_sql("caption", 100) + """, gold AS (SELECT DISTINCT query_id, g AS doc_id FROM (SELECT query_id, upper(trim(unnest(scene_ids))) AS g FROM qy) WHERE g <> ''),
graded AS (SELECT l.query_id, l.rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS grade FROM l_caption l LEFT JOIN gold g USING (query_id, doc_id))
"""


def _graded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    queries = C.kis(spark, d)
    gold = queries.select("query_id", F.explode("scene_ids").alias("g")).select("query_id", F.upper(F.trim("g")).alias("doc_id")).where("doc_id <> ''").distinct()
    ranked = C.lexical(spark, d, "caption", 100).join(gold.withColumn("grade", F.lit(1)), ["query_id", "doc_id"], "left")
    return ranked.select("query_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade")), gold


_RECALL = ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in metrics.CUTS)


@query(_HITS + f", f AS (SELECT q.query_id, min(CASE WHEN grade > 0 THEN rank END) AS first_rank FROM qy q LEFT JOIN graded g USING (query_id) GROUP BY 1) SELECT count(*) AS queries, {_RECALL}, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr FROM f")
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recall_mrr(metrics.first_hits(_graded(spark, d)[0], F.col("grade") > 0, C.kis(spark, d)))


@query(
    _HITS
    + """, dcg AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS x FROM graded WHERE rank <= 10 GROUP BY 1), i AS (SELECT query_id, sum(1 / log2(p + 1)) AS y FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS p FROM gold) WHERE p <= 10 GROUP BY 1)
SELECT query_id, round(CASE WHEN y > 0 THEN coalesce(x, 0) / y ELSE 0 END, 6) AS ndcg FROM i LEFT JOIN dcg USING (query_id)"""
)
def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    graded, gold = _graded(spark, d)
    return metrics.ndcg(graded, gold.select("query_id", F.lit(1).alias("grade")), 10)


@query(_HITS + "SELECT query_id, round(sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) / CAST(greatest(least(10, count(*)), 1) AS DOUBLE), 6) AS precision FROM graded WHERE rank <= 10 GROUP BY 1")
def precision_at_10(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision(_graded(spark, d)[0], 10)


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latencies(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latencies(table(spark, d, "events"), "value", ["event_type"])


@query(C.EVENT_LISTS + "SELECT CASE WHEN rank <= 1 THEN 'top1' WHEN rank <= 5 THEN 'top5' WHEN rank <= 20 THEN 'top20' WHEN rank <= 50 THEN 'top50' WHEN rank <= 100 THEN 'top100' ELSE 'beyond' END AS zone, count(*) AS n FROM l GROUP BY 1")
def rank_zones(spark: SparkSession, d: str) -> DataFrame:
    return C.event_lists(spark, d).groupBy(metrics.zone().alias("zone")).agg(F.count(F.lit(1)).alias("n"))


_SUB = C.CURRENT + ", s AS (SELECT scene_id AS query_id, video_id, frame_idx, CASE WHEN length(image_path) % 7 = 0 THEN '' END AS answer, row_number() OVER (PARTITION BY scene_id ORDER BY frame_idx, keyframe_id) AS rank FROM keyframes), v AS (SELECT video_id, max(frame_count) AS n FROM videos GROUP BY 1), m AS (SELECT s.*, n, row_number() OVER (PARTITION BY query_id, video_id, frame_idx, answer ORDER BY rank) AS t FROM s LEFT JOIN v USING (video_id))"


@query(
    _SUB
    + """SELECT query_id, rank, 'unknown_video' AS issue FROM m WHERE n IS NULL UNION ALL SELECT query_id, rank, 'too_many' FROM m WHERE rank > 100 UNION ALL SELECT query_id, rank, 'beyond_video' FROM m WHERE frame_idx >= n
UNION ALL SELECT query_id, rank, 'duplicate' FROM m WHERE t > 1 UNION ALL SELECT query_id, rank, 'empty_answer' FROM m WHERE answer = ''"""
)
def submission_issues(spark: SparkSession, d: str) -> DataFrame:
    """All keyframe rows as if they were submitted, a scene being a query."""
    kf = table(spark, d, "keyframes").select(F.col("scene_id").alias("query_id"), "video_id", "frame_idx", "keyframe_id", F.when(F.length("image_path") % 7 == 0, "").alias("answer"), (-F.col("frame_idx")).alias("score"))
    return metrics.submission_issues(retrieval.top_k(kf, None, tie="keyframe_id"), C.videos(spark, d))


# --- tasks, on candidates that SQL can express ---

_GROUPS_AVS = [["thuyền", "boat", "ferry"], ["người", "people", "man"]]
_DOCS = C.CURRENT + f""", t AS (SELECT scene_id AS doc_id, {C.normalize_sql("string_agg(t, ' ' ORDER BY t)")} AS t FROM ({C.TEXTS['caption']}) GROUP BY 1)"""


def _scene_texts(spark: SparkSession, d: str) -> DataFrame:
    return C.documents(spark, d).where("size(captions) > 0").select(F.col("scene_id").alias("doc_id"), "video_id", T.normalize(F.array_join(F.array_sort("captions"), " ")).alias("t"))


def _any_sql(options: list[str]) -> str:
    return "(" + " OR ".join(f"list_contains(string_split(t, ' '), '{T.plain_normalize(o)}')" for o in options) + ")"


@query(_DOCS + f", m AS (SELECT doc_id, (CAST({_any_sql(_GROUPS_AVS[0])} AS INT) + CAST({_any_sql(_GROUPS_AVS[1])} AS INT)) / 2.0 AS share, list_contains(string_split(t, ' '), 'mua') AS bad FROM t) SELECT doc_id, CASE WHEN bad THEN 0 WHEN share >= 0.999 THEN 3 WHEN share >= 0.6 THEN 2 WHEN share > 0 THEN 1 ELSE 0 END AS grade FROM m")
def avs_grades(spark: SparkSession, d: str) -> DataFrame:
    groups = F.array(*[F.array(*map(F.lit, g)) for g in _GROUPS_AVS])
    return _scene_texts(spark, d).select("doc_id", tasks.grade(groups, F.array(F.lit("mưa")), F.col("t")).alias("grade"))


@query()
def avs_selection(spark: SparkSession, d: str) -> DataFrame:
    """Diverse scenes for each query, from its first hundred candidates."""
    lists = C.lexical(spark, d, "caption", 100).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    # words are taken once per scene, before candidates meet them
    words = _scene_texts(spark, d).select("doc_id", "video_id", F.array_distinct(F.filter(T.words_of(F.col("t")), lambda w: F.length(w) >= 3)).alias("words"))
    graded = lists.join(words, "doc_id").select("query_id", "doc_id", "video_id", F.round(tasks.relevance(F.lit(2), F.col("score"), F.col("best")), 6).alias("relevance"), "words")
    return tasks.select_diverse(graded, 20)


@query(
    C.CURRENT
    + C.bm25_sql("caption")
    + f""", t AS (SELECT scene_id AS doc_id, {C.normalize_sql("string_agg(t, ' ' ORDER BY t)")} AS t FROM ({C.TEXTS['caption']}) GROUP BY 1),
m AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) + 0.6 * (CAST({_any_sql(['thuyền'])} AS INT) + CAST({_any_sql(['người'])} AS INT)) / 2.0 + 0.1 * CAST({_any_sql(['street'])} AS INT) + 0.15 - 0.8 * CAST({_any_sql(['mưa'])} AS INT) AS total FROM l_caption JOIN t USING (doc_id))
SELECT query_id, doc_id, round(total, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, doc_id) AS rank FROM m"""
)
def kis_rank(spark: SparkSession, d: str) -> DataFrame:
    """Known-item scores with one signature for all queries."""
    lists = C.lexical(spark, d, "caption").join(_scene_texts(spark, d), "doc_id")
    best = F.max("score").over(Window.partitionBy("query_id"))
    none = F.array().cast("array<string>")
    total = tasks.known_item_score(F.col("score"), F.col("best"), F.array(F.lit("thuyền"), F.lit("người")), none, F.array(F.lit("street")), F.array(F.lit("mưa")), F.col("t"), F.lit(1), F.lit(1), F.lit(0.0))
    return retrieval.top_k(lists.withColumn("best", best).select("query_id", "doc_id", F.round(total, 6).alias("score")), None)


_LABELS = C.CURRENT + ", o AS (SELECT scene_id AS doc_id, label, row_number() OVER (PARTITION BY scene_id ORDER BY frame_idx, keyframe_id, i) AS pos FROM (SELECT kf.scene_id, frame_idx, keyframe_id, unnest(objects).label AS label, unnest(range(len(objects))) AS i FROM kf JOIN sc USING (scene_id)))"


@query(_LABELS + ", n AS (SELECT doc_id, label AS answer, count(*) AS n, min(pos) AS p FROM o GROUP BY 1, 2) SELECT doc_id, answer, round(CAST(least(0.35 + 0.1 * n, 0.7) AS DOUBLE), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS r FROM n) WHERE r <= 3")
def qa_entities(spark: SparkSession, d: str) -> DataFrame:
    cand = C.documents(spark, d).select(F.lit("q").alias("query_id"), F.col("scene_id").alias("doc_id"), F.col("object_mentions").alias("labels"))
    return tasks.label_answers(cand).select("doc_id", "answer", F.round("confidence", 6).alias("confidence"))


@query(C.CURRENT + f", o AS (SELECT DISTINCT scene_id AS doc_id, trim(t) AS answer FROM ({C.TEXTS['ocr']})) SELECT doc_id, answer, CAST(CASE WHEN r = 1 THEN 0.75 ELSE 0.45 END AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(answer) DESC, answer) AS r FROM o) WHERE r <= 3")
def qa_written(spark: SparkSession, d: str) -> DataFrame:
    cand = C.documents(spark, d).select(F.lit("q").alias("query_id"), F.col("scene_id").alias("doc_id"), "ocr_texts")
    return tasks.written_answers(cand).select("doc_id", "answer", "confidence")


@query(C.CURRENT + "SELECT scene_id AS doc_id, CAST(round_even(start_sec, 0) AS BIGINT) || 's' AS answer, CAST(0.4 AS DOUBLE) AS confidence FROM sc")
def qa_temporal(spark: SparkSession, d: str) -> DataFrame:
    return tasks.temporal_answers(C.documents(spark, d).select(F.lit("q").alias("query_id"), F.col("scene_id").alias("doc_id"), "start_sec")).select("doc_id", "answer", "confidence")


@query(_DOCS + ", m AS (SELECT doc_id, (CAST(contains(t, 'thuyen') AS INT) + CAST(contains(t, 'nguoi') AS INT) + CAST(contains(t, 'pho') AS INT)) / 3.0 AS s FROM t) SELECT doc_id, CASE WHEN s >= 0.6 THEN 'có' ELSE 'không' END AS answer, round(least(0.4 + abs(s - 0.5), 0.85), 6) AS confidence FROM m")
def qa_yes_no(spark: SparkSession, d: str) -> DataFrame:
    cand = _scene_texts(spark, d).select(F.lit("q").alias("query_id"), "doc_id", F.lit("thuyen nguoi pho").alias("target"), F.col("t").alias("evidence"))
    return tasks.yes_no_answers(cand).select("doc_id", "answer", F.round("confidence", 6).alias("confidence"))


@query()
def qa_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in captions that share a word with the question, verified against the captions."""
    cand = C.documents(spark, d).select(F.lit("q").alias("query_id"), F.col("scene_id").alias("doc_id"), F.lit("có bao nhiêu người").alias("target"), F.col("captions").alias("texts"))
    found = tasks.count_answers(cand).join(cand.select("doc_id", F.array_join("texts", " ").alias("evidence")), "doc_id")
    return found.select("doc_id", "answer", "confidence", tasks.verify(F.col("answer"), F.col("answer_type"), F.col("evidence")).alias("status"))


# --- ordered steps: labels of objects as the steps of one query ---



def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes as hits of the steps of one query: step k asks for the k-th most frequent label (ties by name)."""
    kf = C.keyframes(spark, d).select("video_id", "scene_id", "frame_idx", "timestamp_sec", F.explode("objects").alias("o")).select("video_id", "scene_id", "frame_idx", "timestamp_sec", F.col("o.label").alias("label"), F.round("o.confidence", 6).alias("score"))
    names = kf.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(3)
    steps = retrieval.top_k(names.select(F.lit("q").alias("query_id"), F.col("label").alias("doc_id"), F.col("n").alias("score")), 3).select(F.col("doc_id").alias("label"), (F.col("rank") - 1).alias("step"))
    best = kf.join(steps, "label").groupBy("video_id", "scene_id", "frame_idx", "timestamp_sec", "step").agg(F.max("score").alias("score"))
    return best.withColumn("query_id", F.lit("q"))


_HIT = C.CURRENT + """, o AS (SELECT video_id, scene_id, frame_idx, timestamp_sec, o.label AS label, round(o.confidence, 6) AS score FROM (SELECT video_id, scene_id, frame_idx, timestamp_sec, unnest(objects) AS o FROM kf)),
names AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS step FROM o GROUP BY 1),
h AS (SELECT video_id, scene_id, frame_idx AS f, timestamp_sec AS t, step, max(score) AS s FROM o JOIN names USING (label) WHERE step < 3 GROUP BY ALL)
"""


@query(
    _HIT
    + """, b AS (SELECT video_id, step, arg_max((f, scene_id), (s, -f, scene_id)) AS x, max(s) AS s FROM h GROUP BY 1, 2),
n AS (SELECT video_id, step, x[1] AS f, x[2] AS sc, s FROM b),
p AS (SELECT a.video_id, count(*) AS rising FROM n a JOIN n b ON a.video_id = b.video_id AND b.step = a.step + 1 AND b.f > a.f GROUP BY 1),
v AS (SELECT video_id, round(count(*) / 3.0, 6) AS coverage, round(coalesce(max(rising), 0) / 2.0, 6) AS ordered, avg(s) / (SELECT max(s) FROM h) AS context, 1 - count(DISTINCT sc) / CAST(count(*) AS DOUBLE) AS shared FROM n LEFT JOIN p USING (video_id) GROUP BY 1),
r AS (SELECT *, round(coverage + 0.6 * ordered + 0.4 * context - 0.5 * shared, 6) AS score, coverage < 0.5 AS below FROM v),
k AS (SELECT * FROM r WHERE NOT below UNION ALL SELECT * FROM (SELECT * FROM r ORDER BY score DESC, video_id DESC LIMIT 1) WHERE (SELECT bool_and(below) FROM r))
SELECT video_id, coverage, ordered, score, below, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, video_id) AS rank FROM k) WHERE rank <= 5"""
)
def trake_videos(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rank_videos(_labelled(spark, d), 3).select("video_id", "coverage", "ordered", "score", "below", "rank")


@query(
    _HIT
    + """, b0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frames) AS r FROM (SELECT video_id, [f] AS frames, f AS last, t, round(s, 6) AS score FROM h WHERE step = 0 UNION ALL SELECT video_id, [-1], NULL, NULL, -0.5 FROM (SELECT DISTINCT video_id FROM h))) WHERE r <= 50)
""" + "".join(f""", b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frames) AS r FROM (
 SELECT b.video_id, list_append(frames, h.f) AS frames, h.f AS last, h.t, round(score + s - CASE WHEN last IS NULL THEN 0.0 ELSE 0.002 * (h.t - b.t) END, 6) AS score FROM b{k - 1} b JOIN h ON h.video_id = b.video_id AND step = {k} AND (last IS NULL OR (h.f > last AND h.t - b.t <= 300))
 UNION ALL SELECT video_id, list_append(frames, -1), last, t, round(score - 0.5, 6) FROM b{k - 1})) WHERE r <= 50)""" for k in (1, 2))
    + " SELECT video_id, array_to_string(frames, ',') AS frames, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frames) AS rank FROM b2 WHERE last IS NOT NULL"
)
def trake_beam(spark: SparkSession, d: str) -> DataFrame:
    return sequences.beam_search(_labelled(spark, d), 3).select("video_id", F.array_join("frames", ",").alias("frames"), "score", "rank")


@query()
def trake_variants(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.beam_search(_labelled(spark, d), 3).withColumn("frames", sequences.increasing(F.col("frames")))
    return sequences.variants(found.where("rank = 1").select("video_id", "frames")).withColumn("frames", F.array_join("frames", ","))


@query(
    _HIT
    + """, g AS (SELECT h.video_id, scene_idx AS idx, start_sec AS t, step, max(s) AS s FROM h JOIN sc USING (scene_id) GROUP BY ALL),
a0 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, video_id, scenes) AS r FROM (SELECT video_id, [idx] AS scenes, t, round(s, 6) AS score FROM g WHERE step = 0)) WHERE r <= 100)
""" + "".join(f""", a{k} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, video_id, scenes) AS r FROM (SELECT a.video_id, list_append(scenes, g.idx) AS scenes, g.t, round(score + s - 0.002 * greatest(0.0, g.t - a.t), 6) AS score FROM a{k - 1} a JOIN g ON g.video_id = a.video_id AND step = {k} AND g.idx > scenes[-1])) WHERE r <= 100)""" for k in (1, 2))
    + " SELECT video_id, array_to_string(scenes, ',') AS scenes, score, r AS rank FROM a2"
)
def sequence_links(spark: SparkSession, d: str) -> DataFrame:
    hits = _labelled(spark, d).join(C.scenes(spark, d).select("scene_id", "scene_idx", "start_sec"), "scene_id").groupBy("query_id", "video_id", "step", "scene_idx", "start_sec").agg(F.max("score").alias("score"))
    return sequences.link_steps(hits, 3).select("video_id", F.array_join("scenes", ",").alias("scenes"), "score", "rank")


# --- streams ---


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The events table read as a stream until its end, counted per hour."""
    out = windows.tumbling(windows.read_events(spark, f"{d}/events.parque[t]"), "1 hour")
    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    sink = lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/counts")
    running = out.writeStream.foreachBatch(sink).option("checkpointLocation", f"{place}/state").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{place}/counts").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
