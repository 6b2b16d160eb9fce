"""Queries of the general problems (1, 4, 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, intervals, references
from ..runtime import table

#: Intervals at most so many milliseconds apart belong to one period.
TOLERANCE_MS = 40


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "export_lines"))


def _one_table(spark: SparkSession, d: str, entity: str) -> DataFrame:
    """The table of an entity; values without a place in their column as one text, in order of the columns."""
    rows = drift.unified_table(table(spark, d, "export_lines"), entity)
    items = F.transform(F.array_sort(F.map_entries("rest")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return rows.withColumn("rest", F.array_join(items, " | "))


def p1_scenes_table(spark: SparkSession, d: str) -> DataFrame:
    return _one_table(spark, d, "scenes")


def p1_manifest_table(spark: SparkSession, d: str) -> DataFrame:
    return _one_table(spark, d, "dataset_manifest")


def _index_intervals(spark: SparkSession, d: str) -> DataFrame:
    return intervals.intervals(table(spark, d, "scene_index"), F.col("payload.video_id"), intervals.millis("payload.start_sec"), intervals.millis("payload.end_sec"))


def _query_intervals(spark: SparkSession, d: str) -> DataFrame:
    return intervals.intervals(table(spark, d, "kis_queries"), F.col("video_id"), intervals.millis("start_sec"), intervals.millis("end_sec"), F.col("query_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    gaps = intervals.interval_gaps(_index_intervals(spark, d), TOLERANCE_MS)
    shared = intervals.period_members(_query_intervals(spark, d), "query_id", TOLERANCE_MS).where("several_members")
    return gaps.select(F.lit("scene_gap").alias("case_kind"), F.col("entity").alias("video_id"), F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms")).unionByName(
        shared.select(F.lit("query_period").alias("case_kind"), F.col("entity").alias("video_id"), F.col("period_start").alias("start_ms"), F.col("period_end").alias("end_ms"))
    )


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    def of(source: str, iv: DataFrame) -> DataFrame:
        return intervals.interval_periods(iv, TOLERANCE_MS).select(F.lit(source).alias("source"), F.col("entity").alias("video_id"), F.col("period_start").alias("start_ms"), F.col("period_end").alias("end_ms"))

    return of("scene_index", _index_intervals(spark, d)).unionByName(of("kis_queries", _query_intervals(spark, d)))


def _graph(spark: SparkSession, d: str) -> tuple[list[references.Record], list[references.ForeignKey]]:
    records = [
        references.Record("scenes", table(spark, d, "scenes"), "scene_id", "loaded_at", "deleted_at"),
        references.Record("keyframes", table(spark, d, "keyframes"), "keyframe_id", "loaded_at", "deleted_at"),
        references.Record("kis_queries", table(spark, d, "kis_queries"), "query_id", "loaded_at"),
    ]
    evidence = references.ForeignKey("scenes", F.flatten(F.transform("captions", lambda c: F.coalesce(c["evidence_keyframe_ids"], F.array().cast("array<string>")))), "keyframes")
    return records, [evidence, references.ForeignKey("kis_queries", F.col("scene_ids"), "scenes")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the cascade."""
    return references.orphan_cascade(*_graph(spark, d)).where("depth = 0").select("ref_table", "ref_key", "missing_key", "case_kind", "load_month")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Failing references per table, month and kind."""
    return p5_found(spark, d).groupBy("ref_table", "load_month", "case_kind").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("ref_key").alias("records"))


def p5_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orphaned records per table and month: direct, and inherited along scenes -> keyframes -> scenes and queries -> scenes."""
    records, keys = _graph(spark, d)
    keys = [*keys, references.ForeignKey("keyframes", F.array("scene_id"), "scenes")]
    came = None
    for r in records:
        one = references.arrivals(r).select(F.lit(r.name).alias("table"), "key", F.date_format("arrived", "yyyy-MM").alias("load_month"))
        came = one if came is None else came.unionByName(one)
    return (
        references.orphan_records(references.orphan_cascade(records, keys))
        .join(came, ["table", "key"])
        .groupBy("table", "load_month")
        .agg(F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("inherited"), F.max("depth").cast("long").alias("deepest"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_scenes_table, p1_manifest_table, p4_found, p4_periods, p5_found, p5_report, p5_cascade)}

_P4_PERIODS = """
WITH iv AS (
  SELECT 'scene_index' AS source, payload.video_id AS v, CAST(round(payload.start_sec * 1000) AS BIGINT) AS s, CAST(round(payload.end_sec * 1000) AS BIGINT) AS e, id AS member FROM scene_index
  UNION ALL
  SELECT 'kis_queries', video_id, CAST(round(start_sec * 1000) AS BIGINT), CAST(round(end_sec * 1000) AS BIGINT), query_id FROM kis_queries),
ok AS (SELECT DISTINCT source, v, s, e, member FROM iv WHERE v IS NOT NULL AND e > s),
far AS (SELECT *, max(e) OVER (PARTITION BY source, v ORDER BY s, e, member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
cut AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 40 THEN 1 ELSE 0 END) OVER (PARTITION BY source, v ORDER BY s, e, member ROWS UNBOUNDED PRECEDING) AS g FROM far),
per AS (SELECT source, v, g, min(s) AS s, max(e) AS e, count(DISTINCT member) AS members FROM cut GROUP BY 1, 2, 3)
"""

_P5_REFS = r"""
WITH RECURSIVE came AS (
  SELECT 'scenes' AS tab, upper(trim(scene_id, E' \t\n\r')) AS k, min(scene_id) AS raw, min(loaded_at) AS a, min(deleted_at) AS d FROM scenes GROUP BY 2
  UNION ALL SELECT 'keyframes', upper(trim(keyframe_id, E' \t\n\r')), min(keyframe_id), min(loaded_at), min(deleted_at) FROM keyframes GROUP BY 2
  UNION ALL SELECT 'kis_queries', upper(trim(query_id, E' \t\n\r')), min(query_id), min(loaded_at), NULL FROM kis_queries GROUP BY 2),
refs AS (
  SELECT DISTINCT 'scenes' AS tab, 'keyframes' AS ptab, upper(trim(scene_id, E' \t\n\r')) AS k, upper(trim(r, E' \t\n\r')) AS p
    FROM (SELECT scene_id, unnest(c.evidence_keyframe_ids) AS r FROM (SELECT scene_id, unnest(captions) AS c FROM scenes)) WHERE trim(r, E' \t\n\r') <> ''
  UNION SELECT DISTINCT 'kis_queries', 'scenes', upper(trim(query_id, E' \t\n\r')), upper(trim(r, E' \t\n\r'))
    FROM (SELECT query_id, unnest(scene_ids) AS r FROM kis_queries) WHERE trim(r, E' \t\n\r') <> ''),
found AS (
  SELECT refs.tab AS ref_table, c.raw AS ref_key, refs.p AS missing_key,
    CASE WHEN o.k IS NULL THEN 'missing' WHEN o.a > c.a THEN 'late' WHEN o.d <= c.a THEN 'deleted' END AS case_kind, strftime(c.a, '%Y-%m') AS load_month
  FROM refs JOIN came c ON c.tab = refs.tab AND c.k = refs.k LEFT JOIN came o ON o.tab = refs.ptab AND o.k = refs.p)
"""

_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'decimal' END"
# every line as fields, the files in their sequences, and the changes between neighbours, line by line and value by value
_P1 = rf"""
WITH RECURSIVE raw AS (SELECT file_id, dataset_id, entity, exported_at, line_no, CAST(raw_json AS JSON) AS j FROM export_lines WHERE CASE WHEN json_valid(raw_json) THEN json_type(raw_json) = 'OBJECT' ELSE false END),
top AS (SELECT file_id, dataset_id, entity, exported_at, line_no, json_extract_string(j, CASE entity WHEN 'scenes' THEN '$.scene_id' ELSE '$.build_id' END) AS rec, unnest(json_keys(j)) AS key, j FROM raw),
val AS (SELECT * EXCLUDE (j), json_extract(j, '$."' || key || '"') AS v FROM top),
leaf AS (SELECT file_id, dataset_id, entity, exported_at, line_no, rec, key AS path, v FROM val WHERE key <> 'extensions' AND NOT (key = 'provenance' AND json_type(v) = 'OBJECT')
  UNION ALL SELECT file_id, dataset_id, entity, exported_at, line_no, rec, 'provenance.' || k, json_extract(v, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(v)) AS k FROM val WHERE key = 'provenance' AND json_type(v) = 'OBJECT')),
typed AS (SELECT *, {_KIND.format('v')} AS kind, CAST(v AS VARCHAR) AS txt FROM leaf),
files AS (SELECT *, lag(file_id) OVER w AS prev, row_number() OVER w AS pos FROM (SELECT DISTINCT file_id, dataset_id, entity, exported_at FROM raw) WINDOW w AS (PARTITION BY dataset_id, entity ORDER BY exported_at, file_id)),
fields AS (SELECT file_id, path, array_to_string(list_sort(list_distinct(list(kind) FILTER (kind IS NOT NULL))), '|') AS kinds FROM typed GROUP BY 1, 2),
gone AS (SELECT f.file_id, f.prev, o.path FROM files f JOIN fields o ON o.file_id = f.prev WHERE NOT EXISTS (SELECT 1 FROM fields n WHERE n.file_id = f.file_id AND n.path = o.path)),
come AS (SELECT f.file_id, f.prev, n.path FROM files f JOIN fields n ON n.file_id = f.file_id WHERE f.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fields o WHERE o.file_id = f.prev AND o.path = n.path)),
rec AS (SELECT DISTINCT file_id, rec FROM typed WHERE rec <> ''),
cell AS (SELECT file_id, rec, path, min(kind || ' ' || txt) AS c FROM typed WHERE rec <> '' AND kind IS NOT NULL GROUP BY 1, 2, 3),
pairs AS (SELECT g.file_id, g.prev, g.path AS a, c.path AS b FROM gone g JOIN come c USING (file_id)),
same AS (SELECT p.file_id, a, b FROM pairs p JOIN rec r ON r.file_id = p.file_id JOIN rec s ON s.file_id = p.prev AND s.rec = r.rec
  LEFT JOIN cell x ON x.file_id = p.prev AND x.rec = r.rec AND x.path = a LEFT JOIN cell y ON y.file_id = p.file_id AND y.rec = r.rec AND y.path = b
  GROUP BY 1, 2, 3 HAVING bool_and(x.c IS NOT DISTINCT FROM y.c) AND count(x.c) > 0),
steps AS (SELECT file_id, 'renamed' AS op, a AS old, b AS new FROM same
  UNION ALL SELECT file_id, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.file_id = g.file_id AND s.a = g.path)
  UNION ALL SELECT file_id, 'added', '', path FROM come c WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.file_id = c.file_id AND s.b = c.path)),
walk AS (SELECT f.dataset_id, f.entity, f.pos, f.file_id, n.path, nullif(n.kinds, '') AS kind, CAST(NULL AS VARCHAR) AS before FROM files f JOIN fields n USING (file_id) WHERE f.pos = 1
  UNION ALL SELECT f.dataset_id, f.entity, f.pos, f.file_id, n.path, coalesce(nullif(n.kinds, ''), w.kind), w.kind FROM (SELECT DISTINCT dataset_id, entity, pos FROM walk) z
    JOIN files f ON f.dataset_id = z.dataset_id AND f.entity = z.entity AND f.pos = z.pos + 1 JOIN fields n ON n.file_id = f.file_id
    LEFT JOIN steps s ON s.file_id = f.file_id AND s.new = n.path LEFT JOIN walk w ON w.dataset_id = f.dataset_id AND w.entity = f.entity AND w.path = CASE WHEN s.op = 'renamed' THEN s.old WHEN s.op IS NULL THEN n.path END)
"""

# the columns of the tables at the scale at which the SQL is compared: type, and the names that renames link there
_SCENES = {
    "boundary_confidence_in": ("decimal", []), "created_at": ("string", ["created"]), "end_frame_exclusive": ("integer", ["endFrameExclusive", "stop_frame", "end_frame_excl"]), "end_sec": ("decimal", ["t_end"]),
    "frame_rate": ("decimal", []), "has_asr": ("boolean", []), "has_ocr": ("string", []), "provenance.model_name": ("string", []), "provenance.model_revision": ("string", []),
    "provenance.pipeline_version": ("string", ["provenance.pipeline"]), "quality_score": ("decimal", []), "review_state": ("string", []), "scene_clip_path": ("string", []), "scene_id": ("string", []),
    "scene_idx": ("integer", ["sceneIdx"]), "schema_version": ("string", ["schema", "contract_version"]), "start_frame": ("integer", ["begin_frame"]), "start_sec": ("decimal", ["startSec", "t_start"]),
    "transition_in": ("string", []), "video_id": ("string", []),
}
_MANIFEST = {
    "build_id": ("string", []), "clip_count": ("integer", []), "created_at": ("string", ["createdAt", "created"]), "dataset_id": ("string", []), "event_count": ("integer", []), "frame_rate": ("decimal", []),
    "keyframe_count": ("integer", []), "notes": ("string", []), "pipeline_version": ("string", ["pipeline", "build_pipeline", "pipelineVersion"]), "release_channel": ("string", []), "scene_count": ("integer", []),
    "schema_version": ("string", ["contract_version", "schema", "schemaVersion"]), "signed": ("boolean", []), "video_count": ("integer", []),
}
_CAST = {
    "string": "{0}",
    "integer": r"CASE WHEN regexp_full_match({0}, '-?\d{{1,18}}(\.0+)?') THEN CAST(regexp_extract({0}, '^(-?\d+)', 1) AS BIGINT) END",
    "decimal": r"CASE WHEN regexp_full_match({0}, '-?\d+(\.\d+)?([eE][-+]?\d+)?') THEN TRY_CAST({0} AS DOUBLE) END",
    "boolean": "CASE WHEN {0} IN ('true', '1') THEN true WHEN {0} IN ('false', '0') THEN false END",
}


def _table_sql(entity: str, fields: dict[str, tuple[str, list[str]]]) -> str:
    fields = fields | {"extensions": ("object", [])}
    column = lambda n: "dataset_id_2" if n == "dataset_id" else n.replace(".", "_")
    kinds = " ".join(f"WHEN '{p}' THEN '{n}'" for n, (_, others) in fields.items() for p in (n, *others))
    one = "max(CASE WHEN field = '{0}' THEN {1} END) AS {2}"
    out = [one.format(n, _CAST[k].format("t") if k in _CAST else "CASE WHEN json_type(v) = 'OBJECT' THEN txt END", column(n)) for n, (k, _) in fields.items()]
    fits = " ".join(f"WHEN '{n}' THEN {('(' + _CAST[k].format('t') + ')') if k in _CAST else 't2'} IS NULL" for n, (k, _) in fields.items())
    names = " ".join(f"WHEN '{n}' THEN '{column(n)}'" for n in fields)
    return _P1 + f""", every AS (SELECT file_id, dataset_id, exported_at, line_no, rec, path, v FROM leaf WHERE entity = '{entity}' AND rec <> ''
  UNION ALL SELECT file_id, dataset_id, exported_at, line_no, rec, key, v FROM val WHERE entity = '{entity}' AND rec <> '' AND key = 'extensions'),
named AS (SELECT *, CASE path {kinds} END AS field FROM every WHERE json_type(v) <> 'NULL'),
latest AS (SELECT dataset_id, rec, field, arg_max(v, (exported_at, file_id, -line_no)) AS v FROM named GROUP BY 1, 2, 3),
inside AS (SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN CASE WHEN json_array_length(v) = 1 THEN json_extract(v, '$[0]') END WHEN 'OBJECT' THEN json_extract(v, '$.value') ELSE v END AS x, CAST(json(v) AS VARCHAR) AS txt FROM latest),
texts AS (SELECT *, CASE WHEN json_type(x) NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN x->>'$' END AS t, CASE WHEN json_type(v) = 'OBJECT' THEN txt END AS t2 FROM inside),
left_over AS (SELECT dataset_id, rec, string_agg((CASE field {names} END) || '=' || txt, ' | ' ORDER BY CASE field {names} END) AS rest FROM texts WHERE CASE field {fits} END GROUP BY 1, 2),
wide AS (SELECT dataset_id, rec, {', '.join(out)} FROM texts GROUP BY 1, 2),
lasts AS (SELECT dataset_id, json_extract_string(j, '$.{"scene_id" if entity == "scenes" else "build_id"}') AS rec, arg_max(file_id, (exported_at, file_id)) AS file_id FROM raw WHERE entity = '{entity}' GROUP BY 1, 2)
SELECT file_id, rec AS record, wide.* EXCLUDE (rec), coalesce(rest, '') AS rest FROM wide JOIN lasts USING (dataset_id, rec) LEFT JOIN left_over USING (dataset_id, rec)"""


ORACLE = {
    "p1_found": _P1 + """SELECT file_id, op AS change_kind, old AS old_field, new AS new_field FROM steps
UNION ALL SELECT w.file_id, 'retyped', w.path, w.path FROM walk w JOIN fields n USING (file_id, path) WHERE n.kinds <> '' AND w.before <> n.kinds""",
    "p1_scenes_table": _table_sql("scenes", _SCENES),
    "p1_manifest_table": _table_sql("dataset_manifest", _MANIFEST),
    "p4_found": _P4_PERIODS
    + """SELECT 'scene_gap' AS case_kind, v AS video_id, e AS start_ms, nxt AS end_ms FROM (SELECT *, lead(s) OVER (PARTITION BY source, v ORDER BY s) AS nxt FROM per) WHERE source = 'scene_index' AND nxt IS NOT NULL
UNION ALL SELECT 'query_period', v, s, e FROM per WHERE source = 'kis_queries' AND members >= 2""",
    "p4_periods": _P4_PERIODS + "SELECT source, v AS video_id, s AS start_ms, e AS end_ms FROM per",
    "p5_found": _P5_REFS + "SELECT ref_table, ref_key, missing_key, case_kind, load_month FROM found WHERE case_kind IS NOT NULL",
    "p5_report": _P5_REFS + "SELECT ref_table, load_month, case_kind, count(*) AS refs, count(DISTINCT ref_key) AS records FROM found WHERE case_kind IS NOT NULL GROUP BY 1, 2, 3",
    # depths are walked to 40, far beyond those of the data, as records may refer to each other in circles
    "p5_cascade": _P5_REFS
    + """, edges AS (SELECT tab, k, ptab, p FROM refs UNION SELECT 'keyframes', upper(trim(keyframe_id, E' \\t\\n\\r')), 'scenes', upper(trim(scene_id, E' \\t\\n\\r')) FROM keyframes WHERE trim(scene_id, E' \\t\\n\\r') <> ''),
failing AS (SELECT DISTINCT e.tab, e.k FROM edges e JOIN came c ON c.tab = e.tab AND c.k = e.k LEFT JOIN came o ON o.tab = e.ptab AND o.k = e.p WHERE o.k IS NULL OR o.a > c.a OR o.d <= c.a),
walk AS (SELECT tab, k, 0 AS depth FROM failing UNION SELECT e.tab, e.k, depth + 1 FROM walk JOIN edges e ON e.ptab = walk.tab AND e.p = walk.k WHERE depth < 40),
orphans AS (SELECT tab, k, min(depth) AS depth FROM walk GROUP BY 1, 2)
SELECT o.tab AS "table", strftime(c.a, '%Y-%m') AS load_month, count(*) FILTER (depth = 0) AS direct, count(*) FILTER (depth > 0) AS inherited, CAST(max(depth) AS BIGINT) AS deepest FROM orphans o JOIN came c ON c.tab = o.tab AND c.k = o.k GROUP BY 1, 2""",
}
