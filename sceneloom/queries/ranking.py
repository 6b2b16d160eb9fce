"""Queries of text functions, retrieval branches, scoring, fusion and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval, scoring, selection, tasks
from ..plans import engine, planner
from ..runtime import table
from . import common as C

WEIGHTS = {"caption": 1.0, "asr": 0.25, "keyword": 0.65}
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _tags_sql(c: str, lexicon: T.Lexicon) -> str:
    one = lambda f: f"list_contains(tk, '{f}')" if " " not in f else f"contains(low, '{f}')"
    each = ", ".join(f"CASE WHEN {' OR '.join(map(one, forms))} THEN '{name}' END" for name, forms in sorted(lexicon.items()))
    return f"(SELECT array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',') FROM (SELECT replace(lower({c}), 'ß', 'ss') AS low, {C.tokens_sql(c)} AS tk))"


# --- text functions over whole documents ---


@query(f"SELECT doc_id, len({C.tokens_sql('text')}) AS n_tokens, md5(array_to_string({C.tokens_sql('text')}, ' ')) AS tokens FROM documents")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    tk = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tk).cast("long").alias("n_tokens"), F.md5(F.array_join(tk, " ")).alias("tokens"))


@query(f"SELECT doc_id, md5({C.normalize_sql('text')}) AS form, length({C.normalize_sql('text')}) AS n FROM documents")
def text_normalized(spark: SparkSession, d: str) -> DataFrame:
    form = T.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(form).alias("form"), F.length(form).cast("long").alias("n"))


@query(f"SELECT doc_id, {_tags_sql('text', T.COLORS)} AS colors, {_tags_sql('text', T.ACTIONS)} AS actions FROM documents")
def text_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = lambda x: F.array_join(T.lexicon_tags(F.col("text"), x), ",")
    return table(spark, d, "documents").select("doc_id", tags(T.COLORS).alias("colors"), tags(T.ACTIONS).alias("actions"))


_HINTS = ", ".join(f"'{h}'" for h in planner.SPEECH_HINTS)


@query(f"SELECT doc_id, len(list_filter([{_HINTS}], lambda h: contains(replace(lower(text), 'ß', 'ss'), h))) > 0 AS spoken FROM documents")
def text_hints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.contains_hint(F.col("text"), planner.SPEECH_HINTS).alias("spoken"))


# words between marks, as the regular expressions of SQL know no words of other alphabets
_WORDS = r"regexp_replace({0}, '([\p{{L}}\p{{N}}_]+)', '‹\1›', 'g')"
_BARE = "replace(replace({0}, '‹', ''), '›', '')"
_QUOTE = '["“”]([^"“”]{2,})["“”]'
_STEPS = "(?i)‹(?:sau› ‹đó|tiếp› ‹theo|kế› ‹tiếp|cuối› ‹cùng|rồi(?:› ‹thì)?|then|next|finally)›"
_NOT = r"(?i)‹(?:không› ‹có|không|chẳng› ‹có|chẳng|without|not)›\s+([^,.;:!?\n]+)"


def _clean_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"


def _pieces_sql(c: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '{pattern}'), lambda x: {_clean_sql(_BARE.format('x'))}), lambda x: x <> '')"


def _holds_sql(c: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in marks) + ")"


_KIND = "CASE " + " ".join(f"WHEN {_holds_sql('low', marks)} THEN '{kind}'" for kind, marks in planner.ANSWER_MARKERS) + " ELSE 'other' END"
_PLANS = C.CURRENT + rf""",
n AS (SELECT query_id, nullif(trim(regexp_replace(nfc_normalize(query), '[\s\p{{Z}}]+', ' ', 'g')), '') AS q FROM qy),
w AS (SELECT *, {_WORDS.format('q')} AS w, replace(lower(q), 'ß', 'ss') AS low, list_transform(regexp_extract_all(q, '{_QUOTE}', 1), lambda x: trim(x)) AS phrases FROM n WHERE q IS NOT NULL),
e AS (SELECT *, list_filter(list_transform(list_slice(regexp_split_to_array(q, '\(\d+\)\s*'), 2, 1000000), lambda x: {_clean_sql('x')}), lambda x: x <> '') AS listed, {_pieces_sql('w', _STEPS)} AS parts,
  list_filter(list_transform(regexp_extract_all(w, '{_NOT}', 1), lambda x: {C.normalize_sql(_BARE.format('x'))}), lambda x: x <> '') AS negatives,
  {_pieces_sql(_WORDS.format(_clean_sql(f"regexp_replace(q, '{_QUOTE}', ' ', 'g')")), _STEPS)} AS aims,
  list_filter(list_transform(string_split(regexp_replace(q, '([.?!])\s+', '\1‡', 'g'), '‡'), lambda x: trim(x)), lambda x: x <> '') AS told FROM w),
a AS (SELECT *, coalesce(list_max(list_filter(range(1, len(told) + 1), lambda i: contains(told[i], '?'))), len(told)) AS place FROM e)
SELECT query_id, q AS normalized, array_to_string(CASE WHEN len(listed) >= 2 THEN listed WHEN len(parts) >= 2 THEN parts ELSE [q] END, ' | ') AS events, array_to_string(phrases, ' | ') AS phrases, array_to_string(negatives, ' | ') AS negatives,
  CASE WHEN len(aims) > 0 THEN aims[-1] ELSE coalesce(nullif(array_to_string(phrases, ' '), ''), q) END AS target, CASE WHEN len(aims) > 1 THEN array_to_string(aims[:-2], ' ') ELSE '' END AS context,
  {_KIND} AS answer_type, CASE WHEN len(told) < 2 THEN q ELSE array_to_string(list_transform(list_filter(range(1, len(told) + 1), lambda i: i <> place), lambda i: told[i]), ' ') END AS event_query, CASE WHEN len(told) < 2 THEN q ELSE told[place] END AS question_target,
  CAST(CASE WHEN len(phrases) > 0 OR {_holds_sql('low', planner.TEXT_HINTS)} THEN 2.0 ELSE 0.35 END AS DOUBLE) AS ocr_weight, CAST(CASE WHEN {_holds_sql('low', planner.SPEECH_HINTS)} THEN 1.7 ELSE 0.25 END AS DOUBLE) AS asr_weight FROM a"""


@query(_PLANS)
def query_plans(spark: SparkSession, d: str) -> DataFrame:
    """Plans of all known-item queries; lists as text."""
    plans = planner.plan_queries(C.kis(spark, d))
    lists = ("events", "phrases", "negatives")
    return plans.select(
        "query_id", "normalized", *[F.array_join(c, " | ").alias(c) for c in lists], "target", "context", "answer_type", "event_query", "question_target", "ocr_weight", "asr_weight"
    )


_KIS_STOP, _AVS_STOP = (", ".join(f"'{w}'" for w in sorted(x)) for x in (planner.STOPWORDS_KIS, planner.STOPWORDS_AVS))
_CAPS = "[A-ZĐÀ-Ỹ][a-zà-ỹA-ZĐÀ-Ỹ]+"


def _content_sql(c: str, stop: str) -> str:
    """The words of a text with content, as (bare, word)."""
    words = rf"list_transform(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda x: {{'bare': {C.normalize_sql('x')}, 'word': x}})"
    return f"list_filter({words}, lambda x: length(x.bare) >= 3 AND x.bare NOT IN ({stop}) AND NOT list_contains(banned, x.bare))"


# e of the plans with what is negated as words, then the parts of the signature and the groups
_SIGNATURES = _PLANS[: _PLANS.index("\na AS (")] + rf"""
b AS (SELECT *, flatten(list_transform(negatives, lambda x: string_split(x, ' '))) AS banned, list_filter(phrases, lambda x: x <> '') AS shown FROM e),
g AS (SELECT *, {_content_sql(f"regexp_replace(q, '{_QUOTE}', ' ', 'g')", _KIS_STOP)} AS content,
  regexp_extract_all(regexp_replace(q, '([^\p{{L}}\p{{N}}_.,])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Nd}}(?:[\p{{Nd}}.,]*\p{{Nd}})?)(?:$|[^\p{{L}}\p{{N}}_])', 1) AS nums,
  list_transform(regexp_extract_all('¤' || regexp_replace(q, '([.!?]\s)', '\1¤', 'g'), '[^\p{{L}}\p{{N}}_¤]({_CAPS}(?:\s+{_CAPS})*)', 1), lambda x: trim(x)) AS names FROM b),
u AS (SELECT *, list_transform(list_filter(range(1, len(content) + 1), lambda i: list_position(list_transform(content, lambda x: x.bare), content[i].bare) = i), lambda i: content[i].word) AS ws, list_concat(shown, nums, names) AS odd FROM g),
sg AS (SELECT *, list_concat(shown, list_filter(ws[1:3], lambda x: NOT list_contains(shown, x))) AS must, list_transform(list_filter(range(1, len(odd) + 1), lambda i: list_position(odd, odd[i]) = i), lambda i: odd[i]) AS rare FROM u),
sig AS (SELECT *, list_filter(ws[4:], lambda x: NOT list_contains(must, x)) AS nice,
  list_filter(list_transform(regexp_split_to_array({_BARE.format(f"regexp_replace(w, '{_NOT}', ' ', 'g')")}, '(?i)[,;]|[\s\p{{Z}}]+(?:và|and)[\s\p{{Z}}]+'), lambda p: list_filter(list_transform(regexp_split_to_array(p, '(?i)[\s\p{{Z}}]+(?:hoặc|hay|or)[\s\p{{Z}}]+'),
    lambda o: array_to_string(list_transform({_content_sql('o', _AVS_STOP)}, lambda x: x.word), ' ')), lambda o: o <> '')), lambda p: len(p) > 0) AS groups FROM sg)
"""


@query(_SIGNATURES + "SELECT query_id, array_to_string(must, ' | ') AS must, array_to_string(rare, ' | ') AS rare, array_to_string(nice, ' | ') AS nice, array_to_string(list_transform(groups, lambda p: array_to_string(p, ' / ')), ' | ') AS groups FROM sig")
def query_signatures(spark: SparkSession, d: str) -> DataFrame:
    """What known-item queries must show, what is rare about them, and the groups that must be met; lists as text."""
    plans = planner.plan_queries(C.kis(spark, d))
    return plans.select("query_id", *[F.array_join(c, " | ").alias(c) for c in ("must", "rare", "nice")], F.array_join(F.transform("groups", lambda p: F.array_join(p, " / ")), " | ").alias("groups"))


@query()
def query_expansions(spark: SparkSession, d: str) -> DataFrame:
    """What known-item queries are expanded by, and the colours they name."""
    plans = planner.plan_queries(C.kis(spark, d))
    return plans.select("query_id", F.array_join("terms", " | ").alias("terms"), F.array_join("colors", " | ").alias("colors"))


def _bare_sql(terms: str) -> str:
    return f"list_filter(list_transform({terms}, lambda x: {C.normalize_sql('x')}), lambda x: x <> '')"


def _hits_sql(terms: str) -> str:
    """How many of the normalized terms a text t has: words among its words, phrases anywhere."""
    return f"len(list_filter({terms}, lambda x: CASE WHEN contains(x, ' ') THEN contains(t, x) ELSE list_contains(string_split(t, ' '), x) END))"


_OWN = _SIGNATURES.rstrip() + f""",
nb AS (SELECT query_id, len(must) AS nm, len(rare) AS nr, len(nice) AS nn, {_bare_sql('must')} AS bm, list_transform(rare, lambda x: {C.normalize_sql('x')}) AS br, {_bare_sql('nice')} AS bn, {_bare_sql('negatives')} AS bx, list_transform(groups, lambda p: {_bare_sql('p')}) AS bg FROM sig)""" + C.bm25_sql("caption") + f""",
t AS (SELECT scene_id AS doc_id, {C.normalize_sql("string_agg(t, ' ' ORDER BY t)")} AS t FROM ({C.TEXTS['caption']}) GROUP BY 1)
"""


@query(
    _OWN
    + f""", m AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) + 0.6 * CASE WHEN nm > 0 THEN {_hits_sql('bm')} / CAST(nm AS DOUBLE) ELSE 1 END + 0.25 * CASE WHEN nr > 0 THEN least(len(list_filter(br, lambda x: contains(t, x))) / CAST(nr AS DOUBLE), 1.0) ELSE 0 END
  + 0.1 * CASE WHEN nn > 0 THEN {_hits_sql('bn')} / CAST(nn AS DOUBLE) ELSE 0 END + 0.15 - CASE WHEN {_hits_sql('bx')} > 0 THEN 0.8 ELSE 0 END AS total FROM l_caption JOIN t USING (doc_id) JOIN nb USING (query_id))
SELECT query_id, doc_id, round(total, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, doc_id) AS rank FROM m"""
)
def known_items(spark: SparkSession, d: str) -> DataFrame:
    """Known-item scores of the caption candidates by each query's own signature."""
    plans = planner.plan_queries(C.kis(spark, d)).select("query_id", "must", "rare", "nice", "negatives")
    texts = C.documents(spark, d).where("size(captions) > 0").select(F.col("scene_id").alias("doc_id"), T.normalize(F.array_join(F.array_sort("captions"), " ")).alias("t"))
    met = C.lexical(spark, d, "caption").join(texts, "doc_id").join(plans, "query_id").withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    total = tasks.known_item_score(F.col("score"), F.col("best"), F.col("must"), F.col("rare"), F.col("nice"), F.col("negatives"), F.col("t"), F.lit(1), F.lit(1), F.lit(0.0))
    return retrieval.top_k(met.select("query_id", "doc_id", F.round(total, 6).alias("score")), None)


@query(
    _OWN
    + f""", m AS (SELECT query_id, doc_id, t, bx, len(bg) AS n, len(list_filter(bg, lambda p: {_hits_sql('p')} > 0)) / CAST(len(bg) AS DOUBLE) AS share FROM l_caption JOIN t USING (doc_id) JOIN nb USING (query_id))
SELECT query_id, doc_id, CASE WHEN t = '' OR n = 0 OR {_hits_sql('bx')} > 0 THEN 0 WHEN share >= 0.999 THEN 3 WHEN share >= 0.6 THEN 2 WHEN share > 0 THEN 1 ELSE 0 END AS grade FROM m"""
)
def group_grades(spark: SparkSession, d: str) -> DataFrame:
    """Grades of the caption candidates by each query's own groups and negations."""
    plans = planner.plan_queries(C.kis(spark, d)).select("query_id", "groups", "negatives")
    texts = C.documents(spark, d).where("size(captions) > 0").select(F.col("scene_id").alias("doc_id"), T.normalize(F.array_join(F.array_sort("captions"), " ")).alias("t"))
    met = C.lexical(spark, d, "caption").join(texts, "doc_id").join(plans, "query_id")
    return met.select("query_id", "doc_id", tasks.grade(F.col("groups"), F.col("negatives"), F.col("t")).alias("grade"))


# --- branches ---


def _bm25(branch: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return C.lexical(spark, d, branch)

    f.__name__ = f"bm25_{branch}"
    query(C.CURRENT + C.bm25_sql(branch) + f"\nSELECT query_id, doc_id, score, rank FROM l_{branch}")(f)


for _b in C.FIELDS:
    _bm25(_b)

_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


@query(
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round({_COS.format('q.v', 'e.v')}, 6) AS score FROM e q, e WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {C.TOP}"""
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of a search: vectors whose id is divisible by 50, against all rows."""
    e = table(spark, d, "embeddings")
    return retrieval.cosine_search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), C.TOP)


_SCENE_TAGS = C.CURRENT + f""", ct AS (SELECT scene_id, string_agg(t, ' ') AS t FROM ({C.TEXTS['caption']}) GROUP BY 1),
dt AS (SELECT scene_id AS doc_id, unnest(string_split({_tags_sql('t', T.ACTIONS)}, ',')) AS tag FROM ct),
qt AS (SELECT query_id, string_split(tags, ',') AS tags FROM (SELECT query_id, {_tags_sql('query', T.ACTIONS)} AS tags FROM qy) WHERE tags <> '')
"""


@query(
    _SCENE_TAGS
    + f""", s AS (SELECT query_id, doc_id, round(count(*) / max(n), 6) AS score FROM (SELECT query_id, len(tags) AS n, unnest(tags) AS tag FROM qt) JOIN dt USING (tag) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {C.TOP}"""
)
def tag_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    """Scenes by the actions that their captions and the queries name."""
    queries = C.kis(spark, d).select("query_id", T.lexicon_tags(F.col("query"), T.ACTIONS).alias("tags"))
    docs = C.documents(spark, d).select(F.col("scene_id").alias("doc_id"), T.lexicon_tags(F.array_join("captions", " "), T.ACTIONS).alias("tags"))
    return retrieval.tag_overlap_top(queries, docs, C.TOP)


def _ocr(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    queries = C.kis(spark, d).select("query_id", T.normalize(F.col("query")).alias("text")).where("text <> ''")
    docs = C.documents(spark, d).select(F.col("scene_id").alias("doc_id"), T.normalize(F.array_join(F.array_sort("ocr_texts"), " ")).alias("text")).where("text <> ''")
    return queries, docs


def _grams_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length('  ' || {c} || ' ') - 1), lambda i: substr('  ' || {c} || ' ', i, 3)))"


@query(
    C.CURRENT
    + f""", od AS (SELECT doc_id, {C.normalize_sql('t')} AS t FROM (SELECT scene_id AS doc_id, string_agg(t, ' ' ORDER BY t) AS t FROM ({C.TEXTS['ocr']}) GROUP BY 1)),
oq AS (SELECT query_id, {C.normalize_sql('query')} AS t FROM qy),
dg AS (SELECT doc_id, unnest({_grams_sql('t')}) AS g FROM od WHERE t <> ''),
qg AS (SELECT query_id, len(gs) AS n, unnest(gs) AS g FROM (SELECT query_id, {_grams_sql('t')} AS gs FROM oq WHERE t <> '')),
s AS (SELECT query_id, doc_id, round(count(*) / max(n), 6) AS score FROM qg JOIN dg USING (g) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {C.TOP}"""
)
def trigram_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.trigram_top(*_ocr(spark, d), C.TOP)


@query()
def fuzzy_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Scenes by sequence matching; ten times as many as are kept are verified."""
    queries, docs = _ocr(spark, d)
    return retrieval.fuzzy_search(queries, docs, 10 * 10, 10)


@query(
    C.BRANCHES
    + f""", ev AS (SELECT scene_id, video_id, scene_idx, extensions['event_id'] AS event_id FROM sc),
es AS (SELECT query_id, event_id, max(score) AS score FROM l_caption JOIN ev ON ev.scene_id = doc_id WHERE event_id IS NOT NULL GROUP BY 1, 2),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rank FROM es),
fan AS (SELECT query_id, event_id, ev.scene_id, score, row_number() OVER (PARTITION BY query_id ORDER BY er.rank, scene_idx, ev.scene_id) AS rank FROM er JOIN ev USING (event_id))
SELECT * FROM fan WHERE rank <= {C.TOP}"""
)
def event_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Events scored by their best scene, spread over their scenes in order."""
    sc = C.scenes(spark, d).select("scene_id", "scene_idx", F.col("extensions")["event_id"].alias("event_id")).where("event_id is not null")
    best = C.lexical(spark, d, "caption").join(sc.select(F.col("scene_id").alias("doc_id"), "event_id"), "doc_id").groupBy("query_id", "event_id").agg(F.max("score").alias("score"))
    ranked = retrieval.top_k(best, None, tie="event_id")
    members = sc.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("scene_idx", "scene_id"))), lambda s: s["scene_id"]).alias("scene_ids"))
    return retrieval.event_fan_out(ranked, members, C.TOP)


@query(C.BRANCHES + "SELECT branch, 'success' AS state, count(*) AS candidates FROM lists GROUP BY 1 UNION ALL SELECT 'ocr', 'disabled', 0")
def branch_states(spark: SparkSession, d: str) -> DataFrame:
    registered = spark.createDataFrame([("caption", True), ("asr", True), ("keyword", True), ("ocr", False)], "branch string, enabled boolean")
    return retrieval.branch_status(C.branches(spark, d), registered)


@query("SELECT id AS scene_id FROM scene_index WHERE payload.has_asr AND payload.start_sec >= 60 AND payload.end_sec <= 900 GROUP BY 1")
def search_filters(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_filter(table(spark, d, "scene_index").select("payload.*"), has_asr=True, start_sec_gte=60.0, end_sec_lte=900.0, video_ids=[]).select("scene_id").distinct()


@query()
def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hash vectors of the captions of all scenes: length and largest number."""
    docs = C.documents(spark, d).select("scene_id", T.tokens(F.array_join("captions", " ")).alias("w"))
    v = V.with_hash_vector(docs, "w")
    return v.select("scene_id", F.round(V.norm(F.col("vector")), 6).alias("length"), F.round(F.array_max("vector"), 6).alias("most"))


@query("SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2)")
def mean_pooled(spark: SparkSession, d: str) -> DataFrame:
    pooled = V.mean_pool(table(spark, d, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("vector").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


# --- scores ---

_NORMS = {
    "percentile": (scoring.percentile, "CASE WHEN count(*) OVER p <= 1 THEN 1.0 ELSE (rank() OVER (PARTITION BY query_id, branch ORDER BY score) - 1 + (count(*) OVER (PARTITION BY query_id, branch, score) - 1) / 2.0) / (count(*) OVER p - 1) END"),
    "minmax": (scoring.minmax, "CASE WHEN max(score) OVER p <= min(score) OVER p THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END"),
    "sigmoid": (scoring.sigmoid, "1 / (1 + exp(-score))"),
}


def _norm(name: str):
    make, sql = _NORMS[name]

    def f(spark: SparkSession, d: str) -> DataFrame:
        return C.event_lists(spark, d).withColumn("value", F.round(make(), 6)).select("query_id", "branch", "doc_id", "value")

    f.__name__ = f"norm_{name}"
    query(C.EVENT_LISTS + f"SELECT query_id, branch, doc_id, round({sql}, 6) AS value FROM l WINDOW p AS (PARTITION BY query_id, branch)")(f)


for _n in _NORMS:
    _norm(_n)


@query(
    C.EVENT_LISTS
    + f"SELECT query_id, branch, doc_id, round(CASE WHEN branch = 'click' THEN least(greatest(score, 0.0), 1.0) WHEN branch = 'view' THEN least(greatest((score + 1) / 2, 0.0), 1.0) ELSE {_NORMS['percentile'][1]} END, 6) AS value FROM l WINDOW p AS (PARTITION BY query_id, branch)"
)
def norm_by_kind(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("branch") == "click", "confidence").when(F.col("branch") == "view", "cosine").otherwise("bm25")
    return C.event_lists(spark, d).withColumn("kind", kinds).withColumn("value", F.round(scoring.normalized("kind"), 6)).select("query_id", "branch", "doc_id", "value")


@query(C.EVENT_LISTS + "SELECT query_id, branch, doc_id, row_number() OVER (PARTITION BY query_id, branch ORDER BY rank) AS rank FROM l WHERE score >= 20")
def threshold_hard(spark: SparkSession, d: str) -> DataFrame:
    return scoring.threshold(C.event_lists(spark, d), "score", 20.0).select("query_id", "branch", "doc_id", "rank")


@query(C.EVENT_LISTS + "SELECT query_id, branch, doc_id, row_number() OVER (PARTITION BY query_id, branch ORDER BY CASE WHEN score < 20 THEN 1 ELSE 0 END, rank) AS rank FROM l")
def threshold_soft(spark: SparkSession, d: str) -> DataFrame:
    return scoring.threshold(C.event_lists(spark, d), "score", 20.0, hard=False).select("query_id", "branch", "doc_id", "rank")


_PART = "CASE branch WHEN 'caption' THEN 1.0 WHEN 'asr' THEN 0.25 ELSE 0.65 END / (60.0 + rank)"
_FUSED = "fused AS (SELECT query_id, doc_id, round({agg}({part}), 9) AS score, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches, min(rank) AS best_rank, count(DISTINCT branch) AS n FROM lists GROUP BY 1, 2)"


def _fusion(name: str, method: str, agg: str, having: str = ""):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return scoring.fuse(C.branches(spark, d), WEIGHTS, method, limit=100).select("query_id", "doc_id", "score", "branches", "rank")

    f.__name__ = name
    query(C.BRANCHES + "," + _FUSED.format(agg=agg, part=_PART) + f"\nSELECT query_id, doc_id, score, branches, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused {having}) WHERE rank <= 100")(f)


_fusion("fuse_rrf", "rrf", "sum")
_fusion("fuse_max", "max_score", "max")
_fusion("fuse_intersection", "intersection", "sum", "WHERE n >= 2")


@query(
    C.BRANCHES
    + ","
    + _FUSED.format(agg="sum", part=_PART + " * (1 + 0.1 * score)")
    + "\nSELECT query_id, doc_id, score, best_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM fused) WHERE rank <= 100"
)
def fuse_weighted_items(spark: SparkSession, d: str) -> DataFrame:
    """Fusion in which each row counts by a multiplier of its own."""
    return scoring.fuse(C.branches(spark, d), WEIGHTS, limit=100, multiplier=1 + 0.1 * F.col("score")).select("query_id", "doc_id", "score", "best_rank", "rank")


@query(C.BRANCHES + f"SELECT query_id, doc_id, branch, arg_max(score, rank) AS score, round(sum({_PART}), 9) AS contribution, min(branch) OVER (PARTITION BY query_id, doc_id) AS first_branch FROM lists GROUP BY 1, 2, 3")
def fusion_details(spark: SparkSession, d: str) -> DataFrame:
    return scoring.fusion_details(C.branches(spark, d), WEIGHTS)


@query(
    C.BRANCHES
    + f""", fr AS (SELECT l.query_id, kf.scene_id, kf.frame_idx, {_PART} AS p FROM lists l JOIN kf ON kf.scene_id = l.doc_id)
SELECT query_id, scene_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scene_id ORDER BY p DESC, frame_idx) AS r FROM fr) WHERE r = 1"""
)
def frame_hints(spark: SparkSession, d: str) -> DataFrame:
    frames = C.keyframes(spark, d).select(F.col("scene_id").alias("doc_id"), "frame_idx")
    return scoring.frame_hints(C.branches(spark, d).join(frames, "doc_id").withColumn("scene_id", F.col("doc_id")), WEIGHTS)


_N = C.normalize_sql
_EVIDENCE = C.CURRENT + C.bm25_sql("caption") + f""",
ocr AS (SELECT scene_id, {_N("string_agg(t, ' ' ORDER BY t)")} AS t FROM ({C.TEXTS['ocr']}) GROUP BY 1),
lab AS (SELECT scene_id, list_distinct(list(o.label)) AS labels FROM (SELECT scene_id, unnest(objects) AS o FROM kf) WHERE o.label IS NOT NULL GROUP BY 1),
kw AS (SELECT scene_id, list_distinct(list(t)) AS kws FROM ({C.TEXTS['keyword']}) GROUP BY 1),
m AS (SELECT l.*, {_N('q.query')} AS q, string_split({_N("'nguoi dan ong'")}, ' ') AS phrase, coalesce(ocr.t, '') AS o, coalesce(labels, []) AS labels, coalesce(kws, []) AS kws
  FROM l_caption l JOIN qy q USING (query_id) LEFT JOIN ocr ON ocr.scene_id = doc_id LEFT JOIN lab ON lab.scene_id = doc_id LEFT JOIN kw ON kw.scene_id = doc_id)
"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = C.documents(spark, d).withColumnRenamed("scene_id", "doc_id")
    return C.lexical(spark, d, "caption").join(docs, "doc_id").join(C.kis(spark, d).select("query_id", "query"), "query_id").withColumn("ocr", T.normalize(F.array_join(F.array_sort("ocr_texts"), " ")))


_LEVEL = """CASE WHEN contains(o, 'nguoi dan ong') THEN 'exact'
 WHEN len(list_filter(phrase, lambda w: list_contains(string_split(o, ' '), w))) / 3.0 >= 0.6 THEN 'partial'
 WHEN len(list_filter(phrase, lambda w: list_contains(string_split(o, ' '), w))) > 0 THEN 'hit' ELSE 'miss' END"""


@query(_EVIDENCE + f"SELECT query_id, doc_id, {_LEVEL} AS level FROM m")
def phrase_levels(spark: SparkSession, d: str) -> DataFrame:
    """How far the OCR of each candidate holds one phrase."""
    return _evidence(spark, d).select("query_id", "doc_id", T.phrase_level(F.lit("nguoi dan ong"), F.col("ocr")).alias("level"))


@query(
    _EVIDENCE
    + f""", a AS (SELECT query_id, doc_id, score
  + CASE {_LEVEL} WHEN 'exact' THEN 0.02 WHEN 'partial' THEN 0.01 WHEN 'miss' THEN -0.015 ELSE 0 END
  + least(0.012, 0.004 * len(list_filter(labels, lambda x: list_has_all(string_split(q, ' '), list_filter(string_split({_N('x')}, ' '), lambda w: w <> '')))))
  + least(0.009, 0.003 * len(list_filter(kws, lambda x: {_N('x')} <> '' AND contains(q, {_N('x')})))) AS score FROM m)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM a"""
)
def rule_bonus(spark: SparkSession, d: str) -> DataFrame:
    extra = scoring.rule_adjustment(F.array(F.lit("nguoi dan ong")), T.normalize(F.col("query")), F.col("ocr"), F.col("object_labels"), F.col("keywords"))
    adjusted = _evidence(spark, d).select("query_id", "doc_id", F.round(F.col("score") + extra, 6).alias("score"))
    return retrieval.top_k(adjusted, None)


@query(
    C.CURRENT
    + C.bm25_sql("caption")
    + f""", w AS (SELECT scene_id, list_distinct(flatten(list(string_split({_N('t')}, ' ')))) AS held FROM ({C.TEXTS['caption']}) GROUP BY 1),
bad AS (SELECT query_id, doc_id FROM l_caption JOIN w ON scene_id = doc_id WHERE list_has_all(held, ['duoi', 'mua']) OR list_has_all(held, ['children']))
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM l_caption WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM bad)"""
)
def negative_filter(spark: SparkSession, d: str) -> DataFrame:
    """Two negated phrases for every query."""
    lists = C.lexical(spark, d, "caption")
    words = C.documents(spark, d).select(F.col("scene_id").alias("doc_id"), F.array_distinct(T.words_of(T.normalize(F.array_join("captions", " ")))).alias("words"))
    phrases = C.kis(spark, d).select("query_id", F.explode(F.array(F.array(F.lit("duoi"), F.lit("mua")), F.array(F.lit("children")))).alias("words"))
    return scoring.drop_negated(lists, phrases, words).select("query_id", "doc_id", "rank")


# --- selection ---


def _dedup(scope: str, key: str, per_video: int | None, per_event: int | None):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return selection.deduplicate(C.event_results(spark, d), scope, per_video, per_event).select("query_id", "doc_id", "rank")

    f.__name__ = f"dedup_{scope}"
    cap_e = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, event_id ORDER BY rank) AS n FROM a) WHERE event_id IS NULL OR n <= " + str(per_event or 10**9)
    cap_v = "SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS n FROM b) WHERE n <= " + str(per_video or 10**9)
    query(
        C.EVENT_RESULTS
        + f", a AS (SELECT * EXCLUDE (g) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {key} ORDER BY rank) AS g FROM r) WHERE g = 1), b AS ({cap_e}), c AS ({cap_v})\nSELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM c"
    )(f)


_dedup("frame", "video_id, frame_idx", None, None)
_dedup("scene", "scene_id", None, 3)
_dedup("event", "event_id", 5, 1)
_dedup("video_window", "video_id, floor(timestamp_sec / 5)", 3, None)


@query(C.EVENT_RESULTS + "SELECT query_id, doc_id, n - 1 AS absorbed FROM (SELECT *, count(*) OVER (PARTITION BY query_id, scene_id) AS n, row_number() OVER (PARTITION BY query_id, scene_id ORDER BY rank) AS g FROM r) WHERE g = 1")
def dedup_absorbed(spark: SparkSession, d: str) -> DataFrame:
    return selection.absorbed(C.event_results(spark, d), "scene")


@query(
    C.BRANCHES
    + """, o AS (SELECT *, CASE WHEN rank <= 15 THEN row_number() OVER (PARTITION BY query_id, rank <= 15 ORDER BY length(doc_id) * 31 % 7 + CAST(right(doc_id, 2) AS INT) DESC, rank) END AS o FROM l_caption)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN o <= 10 THEN 0 WHEN rank <= 15 THEN 1 ELSE 2 END, CASE WHEN o <= 10 THEN o ELSE rank END, doc_id) AS rank FROM o"""
)
def rerank_head(spark: SparkSession, d: str) -> DataFrame:
    """The first 15 reordered by a made-up model score, of which 10 are kept in front."""
    score = F.length("doc_id") * 31 % 7 + F.right("doc_id", F.lit(2)).cast("int")
    return selection.rerank(C.lexical(spark, d, "caption").withColumn("model", score), "model", 15, 10).select("query_id", "doc_id", "rank")


@query(C.EVENT_RESULTS + "SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY video_id, frame_idx, doc_id) AS rank FROM r WHERE score >= 10) WHERE rank <= 100")
def display_by_time(spark: SparkSession, d: str) -> DataFrame:
    return selection.display(C.event_results(spark, d).withColumn("start_frame", F.col("frame_idx")), "time", 10.0).select("query_id", "doc_id", "rank")


_SAFE = """, s AS (SELECT kf.scene_id, kf.keyframe_id, kf.frame_idx AS f, sc.start_frame AS a, sc.end_frame_exclusive AS b, kf.quality.sharpness AS sh, kf.quality.duplicate_score AS du FROM kf JOIN sc USING (scene_id)),
p AS (SELECT *, list_filter([least(greatest((sh - 40) / 260.0, 0.0), 1.0), 1.0 - du], lambda x: x IS NOT NULL) AS sig, least(f - a, b - 1 - f) AS edge, greatest((b - a) / 2.0, 1.0) AS half FROM s),
t AS (SELECT scene_id, keyframe_id, f, round(0.45 * 0.5 + 0.20 * CASE WHEN len(sig) > 0 THEN list_sum(sig) / len(sig) ELSE 0.5 END + 0.15 * greatest(0.0, 1 - abs(f - (a + b - 1) / 2.0) / half)
  - 0.15 * CASE WHEN edge >= 12 THEN 0.0 ELSE 1 - greatest(edge, 0) / 12.0 END - 0.20 * CASE WHEN sh < 40 THEN 1 - sh / 40.0 ELSE 0.0 END, 6) AS total FROM p)
SELECT scene_id, keyframe_id, total FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY total DESC, f, keyframe_id) AS r FROM t) WHERE r = 1"""


@query(C.CURRENT + _SAFE)
def safe_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frame of each scene that is safest to submit."""
    met = C.keyframes(spark, d).select("scene_id", "keyframe_id", "frame_idx", "quality.sharpness", "quality.duplicate_score").join(C.scenes(spark, d).select("scene_id", "start_frame", "end_frame_exclusive"), "scene_id")
    parts = selection.safe_frame_parts(F.col("frame_idx"), F.col("start_frame"), F.col("end_frame_exclusive"), F.col("sharpness"), F.col("duplicate_score"), F.lit(0.5))
    scored = met.withColumn("total", F.round(parts["total"], 6))
    best = scored.groupBy("scene_id").agg(F.min(F.struct((-F.col("total")).alias("t"), "frame_idx", "keyframe_id", "total")).alias("b"))
    return best.select("scene_id", "b.keyframe_id", "b.total")


@query()
def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """The composed search for all known-item queries."""
    found = engine.MomentEngine.from_tables(table(spark, d, "scenes"), table(spark, d, "keyframes")).search(C.kis(spark, d).select("query_id", "query"), engine.Options(top_k=C.TOP, branch_k=50))
    return found.orderBy("query_id", "rank")


@query()
def expanded_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Queries with the English terms of their phrases appended."""
    plans = planner.plan_queries(C.kis(spark, d)).select("query_id", F.concat_ws(" ", "normalized", F.array_join("terms", " ")).alias("query"))
    return retrieval.bm25_top(C.documents(spark, d), "scene_id", T.tokens(F.array_join("captions", " ")), plans, T.tokens(F.col("query")), C.TOP)
