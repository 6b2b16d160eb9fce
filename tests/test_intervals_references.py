"""Problems 4 and 5 on small cases and against brute force."""

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sceneloom.operators import intervals as iv
from sceneloom.operators import references as ref
from sceneloom.operators.skew import hot_keys, join_salted


def brute_periods(rows, tolerance):
    out = []
    for entity in {r[0] for r in rows}:
        merged = []
        for s, e in sorted((s, e) for v, s, e in rows if v == entity):
            if merged and s <= merged[-1][1] + tolerance:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(entity, *p) for p in merged]
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400), st.integers(1, 60)), max_size=40), st.integers(0, 5))
def test_periods_and_gaps(spark, rows, tolerance):
    rows = [(v, s, s + n) for v, s, n in rows]
    df = spark.createDataFrame(rows, "entity string, start_ms bigint, end_ms bigint")
    periods = brute_periods(rows, tolerance)
    assert sorted(map(tuple, iv.interval_periods(df, tolerance, block=50).collect())) == periods
    gaps = [(a[0], a[2], b[1]) for a, b in zip(periods, periods[1:]) if a[0] == b[0]]
    assert sorted(map(tuple, iv.interval_gaps(df, tolerance, block=50).collect())) == gaps


def test_invalid_intervals_and_members(spark):
    rows = [("v", 0.0, 1.0, "q1"), ("v", 1.04, 2.0, "q2"), ("v", 5.0, 5.0, "q3"), ("v", 9.0, 8.0, "q3"), (None, 0.0, 1.0, "q4"), ("v", None, 1.0, "q5"), ("v", float("nan"), 1.0, "q5"), ("v", 7.0, 8.0, "q6"), ("v", 7.0, 8.0, "q6")]
    df = spark.createDataFrame(rows, "video_id string, s double, e double, q string")
    valid = iv.intervals(df, F.col("video_id"), iv.millis("s"), iv.millis("e"), F.col("q"))
    got = sorted(map(tuple, iv.period_members(valid, "q", 40).collect()))
    assert got == [("v", 0, 2000, 2, True), ("v", 7000, 8000, 2, False)]
    assert iv.period_members(valid.limit(0), "q", 40).count() == 0


def test_reference_cases(spark):
    t = lambda day: datetime(2025, 3, day)
    frames = spark.createDataFrame(
        [("K1", t(1), None), (" k2", t(1), t(2)), ("K3", t(9), None), ("K1", t(20), None), (None, t(1), None), ("K4", t(1), t(28))],
        "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
    )
    scenes = spark.createDataFrame(
        [("S1", t(5), ["k1 ", "K2", "K3", "\tK9", "", None, "K4", "K9"]), ("S1", t(30), ["K3"]), ("S2", t(29), None), ("S3", None, ["K1", "K8"]), (None, t(1), ["K7"])],
        "sid string, loaded_at timestamp_ntz, refs array<string>",
    )
    queries = spark.createDataFrame([("Q1", t(6), ["S1"]), ("Q2", t(30), ["S2"]), ("Q3", t(30), ["S3", "S3"])], "qid string, loaded_at timestamp_ntz, refs array<string>")
    records = [ref.Record("scenes", scenes, "sid"), ref.Record("frames", frames, "id", deleted_at="deleted_at"), ref.Record("queries", queries, "qid")]
    keys = [ref.ForeignKey("scenes", F.col("refs"), "frames"), ref.ForeignKey("queries", F.col("refs"), "scenes")]
    for hot_rows in (ref.HOT_ROWS, 1):  # also with every parent split
        rows = ref.orphan_cascade(records, keys, hot_rows).collect()
        got = sorted((r.ref_table, r.ref_key, r.missing_key, r.case_kind, r.load_month, r.depth) for r in rows)
        assert got == [
            ("queries", "Q1", "S1", "inherited", "2025-03", 1),
            ("queries", "Q3", "S3", "inherited", "2025-03", 1),
            ("scenes", "S1", "K2", "deleted", "2025-03", 0),
            ("scenes", "S1", "K3", "late", "2025-03", 0),
            ("scenes", "S1", "K9", "missing", "2025-03", 0),
            ("scenes", "S3", "K8", "missing", None, 0),
        ]
    none = [ref.Record(r.name, r.df.limit(0), r.key, r.loaded_at, r.deleted_at) for r in records]
    assert ref.orphan_cascade(none, keys).count() == 0


def test_cascade_runs_to_the_end_of_a_chain_and_through_a_circle(spark):
    # 20 refers to 21, which is missing; each lower number refers to the next; a and b refer to each other and a to 0
    rows = [(str(i), [str(i + 1)]) for i in range(21)] + [("A", ["B", "0"]), ("B", ["A"])]
    nodes = ref.Record("nodes", spark.createDataFrame(rows, "id string, refs array<string>").withColumn("at", F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz")), "id", "at")
    got = {r.key: r.depth for r in ref.orphan_records(ref.orphan_cascade([nodes], [ref.ForeignKey("nodes", F.col("refs"), "nodes")])).collect()}
    assert got == {str(i): 20 - i for i in range(21)} | {"A": 21, "B": 22}


def test_salted_join_equals_the_plain_one(spark):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2)], "k string, n int")
    right = spark.createDataFrame([("a", 7), ("a", 8), ("b", 9), ("d", 1)], "k string, m int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = left.join(right, "k", how), join_salted(left, right, ["k"], how, hot_rows=10, salts=4, share=1.0)
        assert plain.columns == salted.columns and sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, salted.collect()), key=repr)
    assert hot_keys(left, ["k"], 10, 1.0).collect() == [("a",)] and hot_keys(left, ["k"], 100, 1.0) is None
