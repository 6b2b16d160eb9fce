"""Queries of the second kind of search, of evidence, refined sequences and results against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evaluation, evidence, fields, ingest, media, retrieval, selection, sequences, tasks
from ..runtime import checkpoint, table
from ..sources import tables
from . import common as C
from . import media as M

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(f"'{T.plain_strip(w)}'" for w in fields.STOPWORDS)


def _words_sql(c: str) -> str:
    bare = f"replace(replace(strip_accents(coalesce({c}, '')), 'đ', 'd'), 'Đ', 'D')"
    return rf"list_filter(regexp_extract_all(replace(lower({bare}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({_STOP}) AND (length(w) >= 2 OR regexp_full_match(w, '\p{{Nd}}+')))"


def _terms_sql(c: str) -> str:
    """The different terms in order of appearance."""
    return f"list_transform(list_filter(list_zip({_words_sql(c)}, range(1, len({_words_sql(c)}) + 1)), lambda x: list_position({_words_sql(c)}, x[1]) = x[2]), lambda x: x[1])"


# --- the second kind of search ---


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS terms FROM (SELECT doc_id, list_distinct({_words_sql('text')}) AS t FROM documents)")
def content_terms(spark: SparkSession, d: str) -> DataFrame:
    t = fields.query_terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(t), " ")).alias("terms"))


@query(C.CURRENT + f"""SELECT query_id, array_to_string(list_transform({_terms_sql('query')}, lambda t: '"' || t || '"'), ' OR ') AS expression FROM qy""")
def match_expressions(spark: SparkSession, d: str) -> DataFrame:
    return C.kis(spark, d).select("query_id", fields.match_expression(fields.query_terms(F.col("query"))).alias("expression"))


#: Fields of each branch with their weights: where they come from in this data set.
_FIELDS = {"semantic": {"captions": 2.0, "keywords": 1.2}, "tags": {"keywords": 1.5, "object_labels": 1.4, "action_tags": 1.4}}


def _field_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = C.documents(spark, d)
    return docs.select(F.col("scene_id").alias("doc_id"), *[F.array_join(c, " ").alias(c) for c in ("captions", "keywords", "object_labels", "action_tags", "ocr_texts")])


_FIELD_TEXTS = f"""
texts AS (SELECT scene_id, 'captions' AS field, t FROM ({C.TEXTS['caption']}) UNION ALL SELECT scene_id, 'keywords', t FROM ({C.TEXTS['keyword']})
  UNION ALL SELECT DISTINCT scene_id, 'object_labels', o.label FROM (SELECT scene_id, unnest(objects) AS o FROM kf WHERE scene_id IN (SELECT scene_id FROM sc)) WHERE o.label IS NOT NULL
  UNION ALL SELECT DISTINCT scene_id, 'action_tags', a FROM (SELECT scene_id, unnest(action_tags) AS a FROM sc UNION ALL SELECT scene_id, unnest(action_tags) FROM kf WHERE scene_id IN (SELECT scene_id FROM sc)) WHERE a IS NOT NULL)"""


def _field_sql(branch: str) -> str:
    weights = " ".join(f"WHEN '{f}' THEN {w}" for f, w in _FIELDS[branch].items())
    names = ", ".join(f"'{f}'" for f in _FIELDS[branch])
    return C.CURRENT + "," + _FIELD_TEXTS + f""",
tk AS (SELECT scene_id AS doc_id, CASE field {weights} END AS x, unnest({_words_sql('t')}) AS tok FROM texts WHERE field IN ({names})),
ln AS (SELECT doc_id, sum(x) AS len FROM tk GROUP BY 1), tf AS (SELECT doc_id, tok, sum(x) AS tf FROM tk GROUP BY 1, 2), dfs AS (SELECT tok, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM sc) AS n, (SELECT sum(len) FROM ln) / (SELECT count(*) FROM sc) AS mean),
qt AS (SELECT query_id, list_distinct({_words_sql('query')}) AS terms FROM qy), qe AS (SELECT query_id, len(terms) AS k, unnest(terms) AS tok FROM qt),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score, count(*) AS met, max(k) AS k FROM qe JOIN tf USING (tok) JOIN ln USING (doc_id) JOIN dfs USING (tok), st GROUP BY 1, 2),
r AS (SELECT query_id, doc_id, score, round(met / CAST(k AS DOUBLE), 6) AS coverage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE met >= least(2, k) AND met / CAST(k AS DOUBLE) + 1e-12 >= 0.34)
SELECT * FROM r WHERE rank <= {C.TOP}"""


def _field_query(branch: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        queries = C.kis(spark, d).select("query_id", fields.query_terms(F.col("query")).alias("terms"))
        return fields.field_branch(checkpoint(_field_docs(spark, d)), _FIELDS[branch], queries, C.TOP)

    f.__name__ = f"field_{branch}"
    query(_field_sql(branch))(f)


for _b in _FIELDS:
    _field_query(_b)


@query("SELECT DISTINCT payload.scene_id AS scene_id FROM scene_index WHERE payload.end_sec >= 60 AND payload.start_sec <= 900 AND coalesce(payload.end_sec > payload.start_sec, false)")
def overlap_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scene_index").select("payload.*")
    return fields.overlapping(rows, 60.0, 900.0, invalid=~F.coalesce(F.col("end_sec") > F.col("start_sec"), F.lit(False))).select("scene_id").distinct()


def _has_sql(hints: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{h}')" for h in hints) + ")"


@query(
    C.CURRENT
    + rf""", p AS (SELECT query_id, ' ' || replace(lower(query), 'ß', 'ss') || ' ' AS low, query FROM qy),
h AS (SELECT query_id, {_has_sql(fields.WRITTEN)} OR regexp_matches(query, '(^|[^\p{{L}}\p{{N}}_])\p{{Nd}}{{2,}}($|[^\p{{L}}\p{{N}}_])') AS w, {_has_sql(fields.SPOKEN)} AS s, {_has_sql(fields.TEMPORAL)} AS t, {_has_sql(fields.ACTION)} AS a FROM p WHERE query IS NOT NULL)
SELECT query_id, CAST(CASE WHEN w THEN 1.8 ELSE 1.0 END AS DOUBLE) AS ocr, CAST(CASE WHEN s THEN 1.8 ELSE 1.0 END AS DOUBLE) AS speech, round(0.9 * CAST(CASE WHEN t THEN 1.8 ELSE 1 END AS DOUBLE) * CASE WHEN a THEN 1.25 ELSE 1 END, 6) AS event,
  round(1.1 * CAST(CASE WHEN t THEN 1.25 ELSE 1 END AS DOUBLE) * CASE WHEN a THEN 1.45 ELSE 1 END, 6) AS tags, round(CAST(1.35 AS DOUBLE) * 1.2, 6) AS semantic FROM h"""
)
def hinted_weights(spark: SparkSession, d: str) -> DataFrame:
    w = fields.branch_weights(F.col("query"), "qa")
    return C.kis(spark, d).where("query is not null").select("query_id", *[F.round(w[b], 6).alias(b) for b in ("ocr", "speech", "event", "tags", "semantic")])


@query(
    C.CURRENT
    + r"""SELECT query_id, array_to_string(list_filter(list_transform(regexp_split_to_array(query, '(?i)[\s\p{Z}]+(?:sau đó|tiếp theo|rồi|trước khi|then|next|after that|before)[\s\p{Z}]+'), lambda p: regexp_replace(p, '^[ ,.;]+|[ ,.;]+$', '', 'g')), lambda p: p <> ''), ' | ') AS steps FROM qy WHERE query IS NOT NULL"""
)
def query_steps(spark: SparkSession, d: str) -> DataFrame:
    return C.kis(spark, d).where("query is not null").select("query_id", F.array_join(fields.temporal_steps(F.col("query")), " | ").alias("steps"))


_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_VEC = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round({_COS.format('q.v', 'e.v')}, 6) AS score FROM e q, e WHERE q.vec_id % 50 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
"""


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set (ids divisible by 50) and all rows."""
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@query(_VEC + "k AS (SELECT query_id, doc_id, score FROM f WHERE rank <= 40 AND score >= 0.2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k) WHERE rank <= 20")
def vector_scenes(spark: SparkSession, d: str) -> DataFrame:
    return fields.vector_branch(*_embeddings(spark, d), C.TOP)


@query(
    _VEC
    + """k AS (SELECT query_id, doc_id, score, f.rank, label FROM f JOIN e ON e.vec_id = doc_id WHERE f.rank <= 100 AND score >= 0.2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS r FROM k)
SELECT * FROM (SELECT query_id, label, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM b WHERE r = 1) WHERE rank <= 20"""
)
def vector_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames by vectors, the best of each group only; a label stands for a scene."""
    asked, rows = _embeddings(spark, d)
    found = retrieval.cosine_search(asked, rows, 5 * C.TOP).where(F.col("score") >= fields.LEAST_SIMILARITY)
    labelled = found.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return fields.first_per_scene(labelled, "label", C.TOP).select("query_id", "label", "doc_id", "score", "rank")


@query(
    C.BRANCHES
    + f""", p AS (SELECT query_id, ' ' || replace(lower(query), 'ß', 'ss') || ' ' AS low FROM qy), h AS (SELECT query_id, {_has_sql(fields.SPOKEN)} AS s, {_has_sql(fields.TEMPORAL)} AS t, {_has_sql(fields.ACTION)} AS a FROM p),
w AS (SELECT query_id, 'caption' AS branch, 1.35 AS weight FROM h UNION ALL SELECT query_id, 'asr', CASE WHEN s THEN 1.8 ELSE 1.0 END FROM h UNION ALL SELECT query_id, 'keyword', 1.1 * CASE WHEN t THEN 1.25 ELSE 1 END * CASE WHEN a THEN 1.45 ELSE 1 END FROM h),
pen AS (SELECT scene_id AS doc_id, CASE WHEN boundary_confidence_in < 0.2 THEN 0.75 ELSE 1.0 END AS penalty FROM sc),
f AS (SELECT query_id, doc_id, round(sum(weight * coalesce(penalty, 1.0) / (60 + rank)), 9) AS score FROM lists JOIN w USING (query_id, branch) LEFT JOIN pen USING (doc_id) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= {C.TOP}"""
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lists of three fields with each query's own weights; scenes to be reviewed (here: of an unsure start) count less."""
    w = fields.branch_weights(F.col("query"))
    named = F.array(*[F.struct(F.lit(b).alias("branch"), w[x].alias("weight")) for b, x in (("caption", "semantic"), ("asr", "speech"), ("keyword", "tags"))])
    weights = C.kis(spark, d).where("query is not null").select("query_id", F.explode(named).alias("w")).select("query_id", "w.*")
    penalties = C.scenes(spark, d).select(F.col("scene_id").alias("doc_id"), F.when(F.col("boundary_confidence_in") < 0.2, fields.REVIEW_PENALTY).otherwise(1.0).alias("penalty"))
    return fields.fused(C.branches(spark, d), weights, penalties, C.TOP)


@query(C.CURRENT + "SELECT scene_id, CASE WHEN bad THEN 'invalid' WHEN doubt THEN 'needs_review' ELSE 'passed' END AS state FROM (SELECT scene_id, coalesce(end_sec <= start_sec, false) AS bad, len(captions) = 0 OR coalesce(boundary_confidence_in < 0.2, false) AS doubt FROM sc)")
def quality_states(spark: SparkSession, d: str) -> DataFrame:
    s = C.scenes(spark, d)
    statuses = F.array(F.when(F.col("end_sec") <= F.col("start_sec"), "invalid").otherwise("passed"), F.when(F.size("captions") == 0, "needs_review").otherwise("passed"))
    problems = F.array_compact(F.array(F.when(F.col("boundary_confidence_in") < 0.2, "unsure start")))
    return s.select("scene_id", fields.quality_state(statuses, problems).alias("state"))


@query(
    C.CURRENT
    + """SELECT scene_id, keyframe_id FROM (SELECT scene_id, keyframe_id, row_number() OVER (PARTITION BY scene_id ORDER BY CASE WHEN keyframe_id = named THEN 0 ELSE 1 END, coalesce(selection_score, '-Infinity'::DOUBLE) DESC, round(abs(timestamp_sec - (start_sec + end_sec) / 2), 6), keyframe_id) AS r
FROM kf JOIN (SELECT scene_id, start_sec, end_sec, captions[1].evidence_keyframe_ids[1] AS named FROM sc) USING (scene_id)) WHERE r = 1"""
)
def representative_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frame of each scene: the first one its caption names, else by quality, else the middle."""
    named = F.get(F.get("captions", F.lit(0))["evidence_keyframe_ids"], F.lit(0))
    met = C.keyframes(spark, d).select("scene_id", "keyframe_id", "selection_score", "timestamp_sec").join(C.scenes(spark, d).select("scene_id", "start_sec", "end_sec", named.alias("named")), "scene_id")
    return fields.representative_frame(met, F.col("named"), F.col("selection_score"), F.col("timestamp_sec"), F.col("start_sec"), F.col("end_sec"))


@query(
    M._HIT
    + """, g AS (SELECT h.video_id, scene_idx AS no, start_sec AS t, step, min(h.f) AS e, max(s) AS s FROM h JOIN sc USING (scene_id) GROUP BY ALL),
c0 AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, video_id, scenes) AS r FROM (SELECT video_id, [no] AS scenes, no, t, e, round(s, 6) AS score FROM g WHERE step = 0)) WHERE r <= 200)
""" + "".join(f""", c{k} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, video_id, scenes) AS r FROM (SELECT c.video_id, list_append(scenes, g.no) AS scenes, g.no, g.t, g.e, round(score + s - 0.0001 * greatest(0.0, g.t - c.t), 6) AS score FROM c{k - 1} c JOIN g ON g.video_id = c.video_id AND step = {k} AND (g.no > c.no OR (g.no = c.no AND g.e > c.e)) AND greatest(0.0, g.t - c.t) <= 120)) WHERE r <= 200)""" for k in (1, 2))
    + " SELECT video_id, array_to_string(scenes, ',') AS scenes, score, r AS rank FROM c2"
)
def event_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of labels over scenes; the first frame with a label stands for the order of events within a scene."""
    hits = M._labelled(spark, d).join(C.scenes(spark, d).select("scene_id", F.col("scene_idx").alias("scene_no"), F.col("start_sec").alias("at_sec")), "scene_id")
    hits = hits.groupBy("query_id", "video_id", "step", "scene_no", "at_sec").agg(F.min("frame_idx").alias("event_order"), F.max("score").alias("score"))
    return fields.event_chains(hits, 3).select("video_id", F.array_join("scenes", ",").alias("scenes"), "score", "rank")


# --- evidence and frames ---

_JOINED = "nullif(left(string_agg(t, ' '), {0}), '')"


@query(
    C.CURRENT
    + C.bm25_sql("caption")
    + f""", cp AS (SELECT scene_id, left(t, 2000) AS caption, left(t, 500) AS brief FROM (SELECT scene_id, string_agg(t, ' ' ORDER BY t) AS t FROM ({C.TEXTS['caption']}) GROUP BY 1)),
a AS (SELECT scene_id, left(string_agg(t, ' ' ORDER BY t), 2000) AS asr FROM ({C.TEXTS['asr']}) GROUP BY 1), o AS (SELECT scene_id, left(string_agg(t, ' ' ORDER BY t), 2000) AS ocr FROM ({C.TEXTS['ocr']}) GROUP BY 1),
n AS (SELECT video_id, scene_idx, min(scene_id) AS id, arg_min(brief, scene_id) AS brief FROM sc LEFT JOIN cp USING (scene_id) GROUP BY 1, 2)
SELECT query_id, doc_id, rank, md5(coalesce(caption, '')) AS caption, md5(coalesce(ocr, '')) AS ocr, md5(coalesce(asr, '')) AS asr, p.id AS previous_id, md5(coalesce(p.brief, '')) AS previous_caption, x.id AS next_id, md5(coalesce(x.brief, '')) AS next_caption
FROM l_caption l JOIN sc ON sc.scene_id = doc_id LEFT JOIN cp USING (scene_id) LEFT JOIN a USING (scene_id) LEFT JOIN o USING (scene_id)
LEFT JOIN n p ON p.video_id = sc.video_id AND p.scene_idx = sc.scene_idx - 1 LEFT JOIN n x ON x.video_id = sc.video_id AND x.scene_idx = sc.scene_idx + 1"""
)
def evidence_packs(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the caption candidates; texts in alphabetical order, as digests."""
    docs = C.documents(spark, d).withColumns({c: F.array_sort(c) for c in ("captions", "ocr_texts", "asr_texts")})
    return evidence.evidence_packs(C.lexical(spark, d, "caption"), docs, lambda c: F.md5(F.coalesce(c, F.lit(""))))


@query(
    C.CURRENT
    + """, f AS (SELECT scene_id, list_sort(list(DISTINCT frame_idx)) AS fs, arg_max(frame_idx, (coalesce(selection_score, -1.0), -frame_idx)) AS best FROM kf GROUP BY 1),
r AS (SELECT scene_id, best, list_filter(fs, lambda x: x <> best) AS rest FROM f)
SELECT scene_id, array_to_string(list_concat([best], CASE WHEN len(rest) <= 2 THEN rest ELSE list_transform([0, 1], lambda i: rest[least(CAST(floor(i * (len(rest) / 2.0)) AS INT), len(rest) - 1) + 1]) END), ',') AS frames FROM r"""
)
def shown_frames(spark: SparkSession, d: str) -> DataFrame:
    per = C.keyframes(spark, d).groupBy("scene_id").agg(F.array_sort(F.collect_set("frame_idx")).alias("fs"), F.max_by("frame_idx", F.struct(F.coalesce("selection_score", F.lit(-1.0)).alias("s"), (-F.col("frame_idx")).alias("f"))).alias("best"))
    return per.select("scene_id", F.array_join(evidence.shown_frames(F.col("fs"), F.col("best")), ",").alias("frames"))


@query(C.CURRENT + "SELECT query_id AS request_id, place, sc.scene_id, start_sec FROM (SELECT query_id, unnest(scene_ids) AS k, unnest(range(len(scene_ids))) AS place FROM qy) JOIN sc ON sc.scene_id = k")
def records_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The scenes that queries name, in their order."""
    asked = C.kis(spark, d).select(F.col("query_id").alias("request_id"), F.col("scene_ids").alias("keys"))
    return evidence.multi_get(asked, C.scenes(spark, d).select("scene_id", "start_sec"), "scene_id").withColumn("place", F.col("place").cast("long"))


_FRAMES = """fr AS (SELECT kf.scene_id, kf.frame_idx AS f, sc.start_frame AS a, sc.end_frame_exclusive AS b, kf.quality.sharpness AS sh, kf.quality.duplicate_score AS du FROM kf JOIN sc USING (scene_id)),
pp AS (SELECT *, list_filter([least(greatest((sh - 40) / 260.0, 0.0), 1.0), 1.0 - du], lambda x: x IS NOT NULL) AS sig, least(f - a, b - 1 - f) AS edge, greatest((b - a) / 2.0, 1.0) AS half FROM fr),
tt AS (SELECT scene_id, f, round(0.45 * 0.5 + 0.20 * CASE WHEN len(sig) > 0 THEN list_sum(sig) / len(sig) ELSE 0.5 END + 0.15 * greatest(0.0, 1 - abs(f - (a + b - 1) / 2.0) / half)
  - 0.15 * CASE WHEN edge >= 12 THEN 0.0 ELSE 1 - greatest(edge, 0) / 12.0 END - 0.20 * CASE WHEN sh < 40 THEN 1 - sh / 40.0 ELSE 0.0 END, 6) AS total FROM pp)"""


@query(
    C.CURRENT
    + ", "
    + _FRAMES
    + """, an AS (SELECT scene_id, video_id, start_frame + 10 AS anchor FROM sc), m AS (SELECT an.*, f, total, row_number() OVER (PARTITION BY an.scene_id ORDER BY total DESC, f) AS r FROM an LEFT JOIN tt ON tt.scene_id = an.scene_id AND abs(f - anchor) <= 45)
SELECT scene_id, coalesce(f, anchor) AS frame_idx, CASE WHEN f IS NULL THEN 0.2 ELSE least(greatest(total, 0.0), 1.0) END AS confidence FROM m WHERE r = 1"""
)
def refined_steps(spark: SparkSession, d: str) -> DataFrame:
    """The tenth frame of each scene as an anchor, moved to the safest frame near it."""
    sc = C.scenes(spark, d)
    frames = C.keyframes(spark, d).select("scene_id", "frame_idx", "quality.sharpness", "quality.duplicate_score").join(sc.select("scene_id", "start_frame", "end_frame_exclusive"), "scene_id")
    anchors = sc.select(F.lit("q").alias("query_id"), "video_id", F.lit(0).alias("step"), "scene_id", (F.col("start_frame") + 10).alias("anchor"))
    return evidence.refine_steps(anchors, frames).select("scene_id", "frame_idx", "confidence")


@query(
    "WITH bm AS (" + M.ORACLE["trake_beam"] + "), vd AS (" + M.ORACLE["trake_videos"] + """),
m AS (SELECT bm.video_id, list_transform(string_split(frames, ','), lambda x: CAST(x AS INT)) AS fr, round(bm.score + vd.score, 6) AS score, below, row_number() OVER (ORDER BY vd.rank, bm.rank) AS rank FROM bm JOIN vd USING (video_id))
SELECT video_id, array_to_string(list_filter(fr, lambda f: f >= 0), ',') AS frames, array_to_string(list_filter([1, 2, 3], lambda i: fr[i] < 0), ',') AS missing, score, below AS degraded, rank FROM m WHERE rank <= 100"""
)
def trake_results(spark: SparkSession, d: str) -> DataFrame:
    hits = checkpoint(M._labelled(spark, d))
    out = evidence.assemble_sequences(sequences.beam_search(hits, 3), sequences.rank_videos(hits, 3))
    return out.select("video_id", F.array_join("frames", ",").alias("frames"), F.array_join("missing", ",").alias("missing"), "score", "degraded", "rank")


@query(
    f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY 1, 2) GROUP BY 1)
SELECT label, vec_id, similarity FROM (SELECT label, vec_id, round({_COS.format('v', 'c')}, 6) AS similarity, row_number() OVER (PARTITION BY label ORDER BY round({_COS.format('v', 'c')}, 6) DESC, vec_id) AS r FROM e JOIN m USING (label)) WHERE r = 1"""
)
def representative_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector of each group that is nearest to the pooled one."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    pooled = V.mean_pool(e, ["label"], "embedding")
    near = e.join(F.broadcast(pooled) if pooled.limit(100_001).count() <= 100_000 else pooled, "label").withColumn("similarity", F.round(V.cosine(F.col("embedding"), F.col("vector")), 6))
    return near.groupBy("label").agg(F.max_by(F.struct("vec_id", "similarity"), F.struct("similarity", (-F.col("vec_id")).alias("i"))).alias("b")).select("label", "b.vec_id", "b.similarity")


# --- gold ---

_GOLD = """, gold AS (SELECT query_id, video_id, CASE WHEN end_sec > start_sec THEN start_sec END AS gs, CASE WHEN end_sec > start_sec THEN end_sec END AS ge,
  list_sort(list_distinct(list_filter(list_transform(coalesce(scene_ids, []), lambda x: upper(trim(x))), lambda x: x IS NOT NULL AND x <> ''))) AS ids FROM qy)"""


@query(C.CURRENT + _GOLD + " SELECT query_id, video_id, gs AS start_sec, ge AS end_sec, array_to_string(ids, ',') AS scene_ids FROM gold")
def gold_windows(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gold_intervals(C.kis(spark, d)).withColumn("scene_ids", F.array_join("scene_ids", ","))


@query(
    C.CURRENT
    + C.bm25_sql("caption", 100)
    + _GOLD
    + """, m AS (SELECT l.query_id, rank, list_contains(ids, sc.scene_id) OR (sc.video_id = g.video_id AND (gs IS NULL OR (sc.start_sec < ge AND sc.end_sec > gs))) AS hit, sc.video_id = g.video_id AS same FROM l_caption l JOIN sc ON sc.scene_id = doc_id JOIN gold g ON g.query_id = l.query_id)
SELECT query_id, first_hit, first_video FROM gold LEFT JOIN (SELECT query_id, min(rank) FILTER (hit) AS first_hit, min(rank) FILTER (same) AS first_video FROM m GROUP BY 1) USING (query_id)"""
)
def first_hits_in_time(spark: SparkSession, d: str) -> DataFrame:
    found = C.lexical(spark, d, "caption", 100).join(C.scenes(spark, d).select(F.col("scene_id").alias("doc_id"), "video_id", "start_sec", "end_sec"), "doc_id").withColumn("scene_id", F.col("doc_id"))
    return evaluation.first_ranks(found, evaluation.gold_intervals(C.kis(spark, d)))


@query(
    C.CURRENT
    + C.bm25_sql("caption", 100)
    + f""", t AS (SELECT scene_id, string_agg(t, ' ' ORDER BY t) AS answer FROM ({C.TEXTS['caption']}) GROUP BY 1), g AS (SELECT query_id, video_id, CAST(floor(coalesce(start_sec, 0) * 25) AS BIGINT) AS low, CAST(floor(coalesce(end_sec, 0) * 25) AS BIGINT) AS high, list_slice(string_split(query, ' '), 1, 3) AS acc FROM qy WHERE query IS NOT NULL),
m AS (SELECT g.query_id, l.rank, sc.video_id = g.video_id AND CAST(floor(sc.start_sec * 25) AS BIGINT) BETWEEN low AND high AS place, answer, acc FROM g LEFT JOIN l_caption l USING (query_id) LEFT JOIN sc ON sc.scene_id = doc_id LEFT JOIN t ON t.scene_id = doc_id),
r AS (SELECT query_id, min(rank) FILTER (place) AS evidence_rank, coalesce(bool_or(place AND len(list_filter(acc, lambda a: contains({C.normalize_sql('answer')}, {C.normalize_sql('a')}))) > 0), false) AS answered FROM m GROUP BY 1)
SELECT query_id, evidence_rank, answered, answered AND coalesce(evidence_rank, 0) = 1 AS joint FROM r"""
)
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Captions as answers: right in the gold window if they hold one of the first three words of the query."""
    frame = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) * 25).cast("long")
    docs = C.scenes(spark, d).select(F.col("scene_id").alias("doc_id"), "video_id", frame(F.col("start_sec")).alias("frame_idx"))
    answers = C.documents(spark, d).select(F.col("scene_id").alias("doc_id"), F.array_join(F.array_sort("captions"), " ").alias("answer"))
    gold = C.kis(spark, d).where("query is not null").select("query_id", "video_id", frame(F.col("start_sec")).alias("low"), frame(F.col("end_sec")).alias("high"), F.slice(F.split("query", " "), 1, 3).alias("accepted"))
    return evaluation.answer_scores(C.lexical(spark, d, "caption", 100).join(docs, "doc_id"), gold, answers)


@query(
    C.CURRENT
    + C.bm25_sql("caption", 100)
    + """, ev AS (SELECT scene_id, extensions['event_id'] AS event_id FROM sc), g AS (SELECT DISTINCT query_id, event_id FROM (SELECT query_id, upper(trim(unnest(scene_ids))) AS k FROM qy) JOIN ev ON ev.scene_id = k WHERE event_id IS NOT NULL),
h AS (SELECT DISTINCT query_id, event_id FROM l_caption JOIN ev ON ev.scene_id = doc_id WHERE event_id IS NOT NULL)
SELECT g.query_id, round(count(h.event_id) / CAST(count(*) AS DOUBLE), 6) AS covered FROM g LEFT JOIN h ON h.query_id = g.query_id AND h.event_id = g.event_id GROUP BY 1"""
)
def event_coverage(spark: SparkSession, d: str) -> DataFrame:
    ev = C.scenes(spark, d).select("scene_id", F.col("extensions")["event_id"].alias("event_id"))
    gold = C.kis(spark, d).select("query_id", F.explode("scene_ids").alias("k")).select("query_id", F.upper(F.trim("k")).alias("scene_id")).join(ev, "scene_id").where("event_id is not null")
    found = C.lexical(spark, d, "caption", 100).join(ev.withColumnRenamed("scene_id", "doc_id"), "doc_id")
    return evaluation.event_coverage(found, gold)


@query(
    C.CURRENT
    + """SELECT a.*, coalesce(keyframes, 0) AS keyframes, coalesce(captions, 0) AS captions, coalesce(written, 0) AS written FROM (SELECT video_id, count(*) AS scenes, round(avg(end_sec - start_sec), 6) AS mean_sec, count(*) FILTER (len(asr_segments) > 0) AS spoken FROM sc GROUP BY 1) a
LEFT JOIN (SELECT video_id, count(*) AS keyframes, CAST(sum(coalesce(len(captions), 0)) AS BIGINT) AS captions, CAST(sum(coalesce(len(ocr_instances), 0)) AS BIGINT) AS written FROM kf GROUP BY 1) b USING (video_id)"""
)
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.dataset_stats(C.scenes(spark, d), C.keyframes(spark, d))


# --- parts of others that stand alone ---


@query(C.CURRENT + "SELECT keyframe_id, least(frame_idx - start_frame, end_frame_exclusive - 1 - frame_idx) AS distance FROM kf JOIN sc USING (scene_id)")
def boundary_distances(spark: SparkSession, d: str) -> DataFrame:
    met = C.keyframes(spark, d).select("scene_id", "keyframe_id", "frame_idx").join(C.scenes(spark, d).select("scene_id", "start_frame", "end_frame_exclusive"), "scene_id")
    return met.select("keyframe_id", tables.boundary_distance(F.col("frame_idx"), F.col("start_frame"), F.col("end_frame_exclusive")).alias("distance"))


@query(C.CURRENT + ", v AS (SELECT video_id, max(fps) AS fps FROM videos GROUP BY 1) SELECT scene_id, CAST(round_even(start_sec * fps, 0) AS BIGINT) AS first_frame, CAST(round_even(end_sec * fps, 0) AS BIGINT) AS end_frame FROM sc JOIN v USING (video_id)")
def scene_frames(spark: SparkSession, d: str) -> DataFrame:
    met = C.scenes(spark, d).join(C.videos(spark, d).groupBy("video_id").agg(F.max("fps").alias("fps")), "video_id")
    return met.select("scene_id", media.seconds_to_frame(F.col("start_sec"), F.col("fps")).alias("first_frame"), media.seconds_to_frame(F.col("end_sec"), F.col("fps")).alias("end_frame"))


@query(C.CURRENT + f", s AS (SELECT scene_id AS doc_id, trim(string_agg(t, ' ' ORDER BY t)) AS t FROM ({C.TEXTS['asr']}) GROUP BY 1) SELECT doc_id, md5(left(t, 200)) AS answer, CAST(0.55 AS DOUBLE) AS confidence FROM s WHERE t <> ''")
def qa_spoken(spark: SparkSession, d: str) -> DataFrame:
    cand = C.documents(spark, d).select(F.lit("q").alias("query_id"), F.col("scene_id").alias("doc_id"), F.array_join(F.array_sort("asr_texts"), " ").alias("spoken"))
    return tasks.spoken_answers(cand).select("doc_id", F.md5("answer").alias("answer"), "confidence")


@query(
    C.CURRENT
    + f""", w AS (SELECT scene_id, list_distinct(list_filter(string_split({C.normalize_sql("string_agg(t, ' ' ORDER BY t)")}, ' '), lambda x: length(x) >= 3)) AS ws FROM ({C.TEXTS['caption']}) GROUP BY 1),
n AS (SELECT video_id, scene_id, ws, lead(scene_id) OVER o AS other, lead(ws) OVER o AS ws2 FROM sc JOIN w USING (scene_id) WINDOW o AS (PARTITION BY video_id ORDER BY scene_idx, scene_id))
SELECT scene_id, other, round(CASE WHEN len(ws) > 0 AND len(ws2) > 0 THEN len(list_intersect(ws, ws2)) / CAST(len(list_distinct(list_concat(ws, ws2))) AS DOUBLE) ELSE 0 END, 6) AS likeness FROM n WHERE other IS NOT NULL"""
)
def caption_likeness(spark: SparkSession, d: str) -> DataFrame:
    """How alike the captions of successive scenes are."""
    from pyspark.sql import Window

    texts = M._scene_texts(spark, d).select(F.col("doc_id").alias("scene_id"), F.array_distinct(F.filter(T.words_of(F.col("t")), lambda x: F.length(x) >= 3)).alias("ws"))
    w = Window.partitionBy("video_id").orderBy("scene_idx", "scene_id")
    met = C.scenes(spark, d).select("scene_id", "video_id", "scene_idx").join(texts, "scene_id").withColumns({"other": F.lead("scene_id").over(w), "ws2": F.lead("ws").over(w)})
    return met.where("other is not null").select("scene_id", "other", F.round(tasks.jaccard(F.col("ws"), F.col("ws2")), 6).alias("likeness"))


@query(
    C.CURRENT
    + f""", c AS (SELECT scene_id, string_agg(t, ' ' ORDER BY t) AS t FROM ({C.TEXTS['caption']}) GROUP BY 1), l AS (SELECT scene_id, list_sort(list_distinct(list(o.label))) AS labels FROM (SELECT scene_id, unnest(objects) AS o FROM kf) WHERE o.label IS NOT NULL GROUP BY 1)
SELECT scene_id, md5(left(concat_ws(chr(10), 'Caption: ' || c.t, CASE WHEN len(labels) > 0 THEN 'Objects: ' || array_to_string(labels[1:20], ', ') END), 2000)) AS text FROM sc LEFT JOIN c USING (scene_id) LEFT JOIN l USING (scene_id)"""
)
def rerank_texts(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return C.documents(spark, d).select("scene_id", F.md5(selection.rerank_text(F.array_sort("captions"), none, none, F.col("object_labels"), none)).alias("text"))


@query(C.CURRENT + r"SELECT scene_id, regexp_extract(scene_id, '^(.*)_S(\d+)$', 1) AS video, CAST(nullif(regexp_extract(scene_id, '^(.*)_S(\d+)$', 2), '') AS BIGINT) AS number FROM sc")
def scene_id_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.regexp_extract("scene_id", r"^(.*)_S(\d+)$", i)
    return C.scenes(spark, d).select("scene_id", part(1).alias("video"), F.nullif(part(2), F.lit("")).cast("bigint").alias("number"))


@query(
    C.CURRENT
    + """, e AS (SELECT *, extensions['event_id'] AS event_id FROM sc WHERE extensions['event_id'] IS NOT NULL)
SELECT event_id, min(video_id) AS video_id, count(*) AS scenes, min(start_frame) AS start_frame, max(end_frame_exclusive) AS end_frame_exclusive,
  md5(coalesce(array_to_string(list_sort(list_distinct(flatten(list(list_transform(captions, lambda c: c.text))))), ' '), '')) AS caption,
  array_to_string(list_sort(list_distinct(list_filter(flatten(list(list_transform(keywords, lambda k: k.normalized_text))), lambda x: x IS NOT NULL))), ',') AS keywords,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(action_tags, []))))), ',') AS actions FROM e GROUP BY 1"""
)
def event_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Events as the data name them, with the captions, keywords and actions of their scenes."""
    e = C.scenes(spark, d).withColumn("event_id", F.col("extensions")["event_id"]).where("event_id is not null")
    gathered = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(c)), lambda x: x.isNotNull())))
    return e.groupBy("event_id").agg(
        F.min("video_id").alias("video_id"), F.count(F.lit(1)).alias("scenes"), F.min("start_frame").alias("start_frame"), F.max("end_frame_exclusive").alias("end_frame_exclusive"),
        F.md5(F.array_join(gathered(F.col("captions.text")), " ")).alias("caption"), F.array_join(gathered(F.col("keywords.normalized_text")), ",").alias("keywords"), F.array_join(gathered(F.col("action_tags")), ",").alias("actions"),
    )


# --- ingest ---


@query(
    C.CURRENT
    + """, v AS (SELECT video_id, max(fps) AS fps FROM videos GROUP BY 1), k AS (SELECT DISTINCT video_id, frame_idx FROM keyframes),
p AS (SELECT k.video_id, frame_idx, s.scene_id, row_number() OVER (PARTITION BY k.video_id, frame_idx ORDER BY start_frame, s.scene_id) AS r FROM k JOIN sc s ON k.video_id = s.video_id AND frame_idx >= start_frame AND frame_idx < end_frame_exclusive)
SELECT scene_id || '_F' || lpad(CAST(frame_idx AS VARCHAR), CAST(greatest(6, length(CAST(frame_idx AS VARCHAR))) AS INTEGER), '0') AS keyframe_id, round(frame_idx / fps, 6) AS timestamp_sec FROM p JOIN v USING (video_id) WHERE r = 1"""
)
def placed_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Frames as they come, placed in scenes and timed."""
    rows = table(spark, d, "keyframes").select("video_id", "frame_idx").distinct()
    return ingest.assemble_keyframes(rows, C.scenes(spark, d), C.videos(spark, d), {})[0].select("keyframe_id", "timestamp_sec")


@query(
    C.CURRENT
    + """, c AS (SELECT scene_id, c.text AS text FROM (SELECT scene_id, unnest(captions) AS c FROM keyframes)), i AS (SELECT scene_id, list_sort(list_distinct(list(text))) AS ts FROM c WHERE text IS NOT NULL GROUP BY 1)
SELECT scene_id, coalesce(len(ts), 0) AS n, md5(coalesce(array_to_string(ts, ' | '), '')) AS imported FROM sc LEFT JOIN i USING (scene_id) UNION ALL SELECT 'unknown', count(*), '' FROM c WHERE scene_id IS NOT NULL AND scene_id NOT IN (SELECT scene_id FROM sc)"""
)
def imported_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of frames as captions of their scenes; those of unknown scenes are counted."""
    captions = table(spark, d, "keyframes").where("scene_id is not null").select("scene_id", F.explode("captions").alias("c")).select("scene_id", "c.text", "c.language")
    merged, unknown = ingest.merge_captions(C.scenes(spark, d).select("scene_id"), captions)
    known = merged.select("scene_id", F.size("imported").cast("long").alias("n"), F.md5(F.array_join("imported", " | ")).alias("imported"))
    return known.unionByName(unknown.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown").alias("scene_id"), "n", F.lit("").alias("imported")))


@query("SELECT DISTINCT scene_id, lower(trim(o.label)) AS keyword FROM (SELECT scene_id, unnest(objects) AS o FROM keyframes) WHERE trim(o.label) <> ''")
def label_keywords(spark: SparkSession, d: str) -> DataFrame:
    return ingest.scene_keywords(table(spark, d, "keyframes").select("scene_id", F.explode("objects").alias("o")).select("scene_id", "o.label"))


@query(
    C.CURRENT
    + """, a AS (SELECT scene_id, start_sec FROM sc), b AS (SELECT payload.scene_id AS scene_id, min(payload.start_sec) AS start_sec FROM scene_index WHERE payload.scene_id IS NOT NULL GROUP BY 1)
SELECT scene_id, start_sec FROM a UNION ALL SELECT scene_id, start_sec FROM b WHERE scene_id NOT IN (SELECT scene_id FROM a)"""
)
def first_sources(spark: SparkSession, d: str) -> DataFrame:
    """When scenes start: by the scenes' own table, else by the index."""
    index = table(spark, d, "scene_index").select("payload.scene_id", "payload.start_sec").where("scene_id is not null").groupBy("scene_id").agg(F.min("start_sec").alias("start_sec"))
    return ingest.first_source([C.scenes(spark, d).select("scene_id", "start_sec"), index], "scene_id")


@query("SELECT doc_id, sha256(concat_ws(chr(31), text, source)) AS content_hash FROM documents WHERE sha256(concat_ws(chr(31), text, source)) NOT IN (SELECT sha256(concat_ws(chr(31), text, source)) FROM documents WHERE doc_id % 2 = 0)")
def enrich_todo(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which no equal one has an even id, as if those had been done."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    done = docs.where("doc_id % 2 = 0").select(F.sha2(F.concat_ws("\x1f", "text", "source"), 256).alias("content_hash"))
    return ingest.to_enrich(docs, done, ["text", "source"]).select("doc_id", "content_hash")


@query(C.EVENT_RESULTS + "SELECT query_id, arg_min(doc_id, rank) AS doc_id, array_to_string(list(doc_id ORDER BY rank)[2:], ',') AS dropped FROM r GROUP BY query_id, scene_id HAVING count(*) > 1")
def dropped_ids(spark: SparkSession, d: str) -> DataFrame:
    """What the first of each scene stands for, as ids."""
    return selection.absorbed_ids(C.event_results(spark, d), "scene").where("size(dropped) > 0").select("query_id", "doc_id", F.array_join("dropped", ",").alias("dropped"))


_STATES = "CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN CASE WHEN value < 20 THEN 'timeout' ELSE 'empty' END ELSE CASE WHEN value < 5 THEN 'failed' ELSE 'success' END END"


@query(f"SELECT user_id, event_type AS branch, arg_max(s, list_position(['disabled', 'empty', 'success', 'unavailable', 'timeout', 'failed'], s)) AS state, count(*) FILTER (value < 10) AS below FROM (SELECT *, {_STATES} AS s FROM events) GROUP BY 1, 2")
def merged_states(spark: SparkSession, d: str) -> DataFrame:
    """States of branches over several searches (here: made up from events): the worst one counts, and how many results a threshold met."""
    e = table(spark, d, "events")
    rows = e.select("user_id", F.col("event_type").alias("branch"), F.expr(_STATES).alias("state"), (F.col("value") < 10).cast("long").alias("below"))
    return retrieval.merge_status(rows, ["user_id", "branch"])


@query("SELECT file_id, line_no, json_extract_string(regexp_extract('Here: ```json ' || raw_json || ' ``` done', '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1), '$.created_at') AS created FROM export_lines WHERE json_valid(raw_json) AND raw_json LIKE '{%'")
def fenced_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects read out of a text with a fence around them."""
    lines = table(spark, d, "export_lines").where("try_parse_json(raw_json) is not null and raw_json like '{%'")
    found = T.json_object(F.concat(F.lit("Here: ```json "), "raw_json", F.lit(" ``` done")))
    return lines.select("file_id", "line_no", F.get_json_object(found, "$.created_at").alias("created"))


@query(
    C.CURRENT
    + C.bm25_sql("caption", 3)
    + f""", t AS (SELECT scene_id AS doc_id, string_agg(t, ' ' ORDER BY t) AS t FROM ({C.TEXTS['caption']}) GROUP BY 1) SELECT query_id, md5(string_agg('[' || doc_id || '] ' || left(t, 500), chr(10) ORDER BY rank)) AS answer FROM l_caption JOIN t USING (doc_id) GROUP BY 1"""
)
def evidence_answers(spark: SparkSession, d: str) -> DataFrame:
    docs = C.documents(spark, d).where("size(captions) > 0").select(F.col("scene_id").alias("doc_id"), F.array_join(F.array_sort("captions"), " ").alias("text"))
    hits = C.lexical(spark, d, "caption", 3).join(docs, "doc_id").withColumnRenamed("doc_id", "scene_id")
    return tasks.evidence_answers(hits).withColumn("answer", F.md5("answer"))
