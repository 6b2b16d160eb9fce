"""Operators that SQL can't express, edge cases, sources and sinks."""

import random
import re
import unicodedata
import uuid
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sceneloom import runtime
from sceneloom.functions import text as T
from sceneloom.functions import vectors as V
from sceneloom.operators import fields, ingest, joins, media, metrics, quality, retrieval, scoring, selection, sequences, tasks
from sceneloom.plans import engine, planner
from sceneloom.sources import files
from sceneloom.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plain_tags(text, lexicon):
    low = text.casefold()
    found = set(re.findall(r"\w+", low))
    return sorted(name for name, forms in lexicon.items() if any(f in (low if " " in f else found) for f in forms))


def test_text_functions(spark):
    for t in ["", "Đường PHỐ, đẹp!", "Straße ß", "  a\tb ", "cà phê", "x" * 50_000]:
        assert one(spark, T.normalize(F.lit(t))) == T.plain_normalize(t)
        assert one(spark, T.tokens(F.lit(t))) == re.findall(r"\w+", t.casefold())
        assert one(spark, T.compose(F.lit(unicodedata.normalize("NFD", t)))) == unicodedata.normalize("NFC", t)
        assert one(spark, T.lexicon_tags(F.lit(t + " xanh lá đi bộ"), T.COLORS | T.ACTIONS)) == plain_tags(t + " xanh lá đi bộ", T.COLORS | T.ACTIONS)
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []
    assert set(one(spark, T.trigrams(F.lit("abc")))) == {"  a", " ab", "abc", "bc "}
    assert [one(spark, T.phrase_level(F.lit(p), F.lit("mot hai ba"))) for p in ("hai ba", "hai ba mot", "ba xx yy", "zz", "")] == ["exact", "partial", "hit", "miss", "miss"]


def test_fuzzy_scores():
    assert T.fuzzy_score("xin chao", "xin chao cac ban") == pytest.approx(1.0)
    assert T.fuzzy_score("xin chao", "") == 0 and T.fuzzy_score("", "a") == 0
    assert T.token_containment(["muong"], ["muomg"]) == 1.0 and T.token_containment(["muong"], ["trau"]) == 0.0


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0 and one(spark, V.unit(F.array(F.lit(0.0)))) is None
    assert one(spark, V.uuid5(F.lit("aic:v1:é"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "aic:v1:é"))
    assert np.linalg.norm(V.hash_vector(["a", "b", "a"])) == pytest.approx(1) and V.hash_vector([]) == [0.0] * 256
    assert one(spark, F.size(V.native_hash_vector(F.array(F.lit("a")), 8))) == 8


def test_planner(spark):
    texts = [
        "(1) người đi; (2) xe chạy",
        "Tìm bốn khoảnh khắc: (1) người đi; (2) xe chạy.",
        "Cảnh quay tại toà nhà số (1) Láng Hạ vào buổi sáng",
        "người đi, Sau đó xe chạy",
        'người cào muối, sau đó vẫy tay, có chữ "xin chào"',
        '"chỉ có chữ"',
        "bãi biển không có thuyền, without cars",
        "người nói",
        "người lớn và trẻ em, đang dạy hoặc tưới cây",
        "Một đoàn người đi. Có bao nhiêu người?",
        "cánh đồng muối",
        'Biển hiệu "Phở 24" cạnh UNESCO không có xe, 12 người',
        "  ",
        None,
        unicodedata.normalize("NFD", "  Cánh  đồng "),
    ]
    rows = planner.plan_queries(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")).collect()
    plans = {texts[int(r.query_id)]: r for r in rows}
    plan = plans.get

    assert plan("(1) người đi; (2) xe chạy").events == ["người đi", "xe chạy"]
    assert plan("Tìm bốn khoảnh khắc: (1) người đi; (2) xe chạy.").events == ["người đi", "xe chạy"]
    assert plan("Cảnh quay tại toà nhà số (1) Láng Hạ vào buổi sáng").events == ["Cảnh quay tại toà nhà số (1) Láng Hạ vào buổi sáng"]
    assert plan("người đi, Sau đó xe chạy").events == ["người đi", "xe chạy"]
    p = plan('người cào muối, sau đó vẫy tay, có chữ "xin chào"')
    assert (p.phrases, p.target, p.context, p.ocr_weight) == (["xin chào"], "vẫy tay, có chữ", "người cào muối", 2.0)
    assert plan('"chỉ có chữ"').target == "chỉ có chữ"
    p = plan("bãi biển không có thuyền, without cars")
    assert p.negatives == ["thuyen", "cars"] and p.groups == [["bãi biển"]]
    assert plan("người nói").asr_weight == 1.7
    assert plan("người lớn và trẻ em, đang dạy hoặc tưới cây").groups == [["người lớn"], ["trẻ"], ["đang dạy", "tưới cây"]]
    p = plan("Một đoàn người đi. Có bao nhiêu người?")
    assert (p.answer_type, p.event_query, p.question_target) == ("count", "Một đoàn người đi.", "Có bao nhiêu người?")
    assert plan("cánh đồng muối").terms == ["salt field", "salt flat"]
    p = plan('Biển hiệu "Phở 24" cạnh UNESCO không có xe, 12 người')
    assert p.must == ["Phở 24", "Biển", "hiệu", "UNESCO"] and set(p.rare) == {"Phở 24", "24", "12", "Phở", "UNESCO"} and p.negatives == ["xe"]
    assert plan("  ") is None and plan(None) is None
    assert plan(unicodedata.normalize("NFD", "  Cánh  đồng ")).normalized == "Cánh đồng"


def test_normalisation_of_small_lists(spark):
    df = spark.createDataFrame([(1, "b", "x", 1.0), (1, "b", "y", 1.0), (1, "b", "z", 3.0), (2, "b", "w", 5.0)], "query_id int, branch string, doc_id string, score double")
    got = {r.doc_id: (r.p, r.m) for r in df.select("doc_id", scoring.percentile().alias("p"), scoring.minmax().alias("m")).collect()}
    assert got == {"x": (0.25, 0.0), "y": (0.25, 0.0), "z": (1.0, 1.0), "w": (1.0, 1.0)}
    assert scoring.fuse(df.withColumn("rank", F.lit(1)), {"b": 0.0}).count() == 0


def test_sequence_repairs(spark):
    assert one(spark, sequences.increasing(F.array(*map(F.lit, [5, 3, -1, 4, 9])))) == [5, 6, -1, 7, 9]
    df = spark.createDataFrame([("q", [0, 2, 3])], "q string, frames array<int>")
    got = sorted((r.step, r.by, r.frames) for r in sequences.variants(df).collect())
    assert got == [(0, 1, [1, 2, 3]), (1, -1, [0, 1, 3]), (2, 1, [0, 2, 4])]


def test_videos_by_their_steps(spark):
    shape = "query_id string, step int, video_id string, scene_id string, frame_idx int, score double"
    rows = [("q", 0, "v", "s0", 100, 0.8), ("q", 2, "v", "s2", 200, 0.4), ("q", 0, "w", "t0", 5, 0.8), ("q", 1, "w", "t0", 9, 0.8), ("q", 0, "x", "u", 1, 0.7)]
    rows += [("r", 0, "v", "s0", 1, 0.5), ("r", 0, "w", "s1", 1, 0.5)]
    got = {(r.query_id, r.video_id): (r.ordered, r.score, r.below) for r in sequences.rank_videos(spark.createDataFrame(rows, shape), 3).collect()}
    # v: steps 0 and 2 are no neighbours; w: one pair in order, both steps in one scene; x: below half of the steps; r: nothing better than a third
    assert got == {
        ("q", "v"): (0.0, round(2 / 3 + 0.4 * 0.75, 6), False),
        ("q", "w"): (0.5, round(2 / 3 + 0.3 + 0.4 - 0.25, 6), False),
        ("r", "w"): (0.0, round(1 / 3 + 0.4, 6), True),
    }


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
    assert runtime.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["v", "w"]), st.integers(0, 1900), st.integers(1, 90)), max_size=80), st.sampled_from([2.0, 40.0]))
def test_events_equal_a_plain_walk(spark, rows, gap):
    # dense stretches that go over several blocks of ten minutes, too
    rows = [(v, f"s{i}", i, float(s), float(s + n)) for i, (v, s, n) in enumerate(rows)] + [("x", f"x{i}", i, 7.0 * i, 7.0 * i + 6.5) for i in range(300)]
    want = {}
    for video in {r[0] for r in rows}:
        first = last = None
        event = -1
        for _, scene, _, start, end in sorted((r for r in rows if r[0] == video), key=lambda r: (r[3], r[2])):
            if first is None or start - last > gap or end - first > 60.0:
                first, event = start, event + 1
            last = end
            want[scene] = event
    got = media.event_groups(spark.createDataFrame(rows, "video_id string, scene_id string, scene_idx int, start_sec double, end_sec double"), gap).collect()
    assert {r.scene_id: r.event_idx for r in got} == want and len(got) == len(rows)


def test_diverse_selection(spark):
    rows = [("q", "a", "v", 0.9, ["x", "y"]), ("q", "b", "v", 0.85, ["x", "y"]), ("q", "c", "w", 0.8, ["z"]), ("q", "d", "w", 0.1, None)]
    got = [(r.doc_id, r.cluster) for r in tasks.select_diverse(spark.createDataFrame(rows, "query_id string, doc_id string, video_id string, relevance double, words array<string>"), 3).orderBy("rank").collect()]
    assert got == [("a", 0), ("c", 1), ("b", 0)]


def test_answers(spark):
    rows = [("q", "v", 1, "5", 1.0, 0.7, "SUPPORTED"), ("q", "v", 1, "5 ", 0.5, 0.7, "SUPPORTED"), ("q", "v", 2, "6", 1.0, 0.7, "CONTRADICTED"), ("q", "w", 1, "7", 0.5, 0.8, "PARTIAL")]
    ranked = tasks.rank_answers(spark.createDataFrame(rows, "query_id string, video_id string, frame_idx int, answer string, score double, confidence double, status string"))
    assert [(r.answer, r.rank) for r in ranked.orderBy("rank").collect()] == [("5", 1), ("7", 2)]
    status = lambda a, t, e: one(spark, tasks.verify(F.lit(a), F.lit(t), F.lit(e)))
    assert [status("12", "count", "có 12 người"), status("12", "count", "có 3 người"), status("có", "yes_no", "x"), status("a", "entity", ""), status("zz", "entity", "x")] == ["SUPPORTED", "CONTRADICTED", "PARTIAL", "INSUFFICIENT", "INSUFFICIENT"]


def test_boxes_samples_and_zones(spark):
    assert one(spark, quality.normalized_box(*map(F.lit, [0.9, -1.0, 0.1, 0.5]))) == (0.1, 0.0, 0.9, 0.5)
    assert one(spark, quality.normalized_box(*map(F.lit, [0.1, 0.1, 0.1, 0.5]))) is None
    assert one(spark, selection.even_sample(F.sequence(F.lit(0), F.lit(9)), 4)) == [0, 3, 6, 9]
    assert spark.createDataFrame([(1,), (7,), (500,)], "rank int").select(metrics.zone()).toPandas().iloc[:, 0].tolist() == ["top1", "top20", "beyond"]


def test_step_score(spark):
    gold = spark.createDataFrame([("q", "v", 0, 0, 9), ("q", "v", 1, 10, 19)], "query_id string, video_id string, step int, low int, high int")
    answers = spark.createDataFrame([("q", "v", 0, 5), ("q", "v", 1, 25)], "query_id string, video_id string, step int, frame_idx int")
    assert [tuple(r) for r in metrics.step_score(answers, gold).collect()] == [("q", 0.5, False)]


def test_merges(spark):
    base = spark.createDataFrame([("v", 1), ("v", 2)], "video_id string, frame_idx int")
    pack = spark.createDataFrame([("v", 1, "a", 0), ("v", 1, "b", 1)], "video_id string, frame_idx int, ocr string, row int")
    merged, bad = joins.merge_by_key(base, {"ocr": pack}, ["video_id", "frame_idx"], "row")
    assert sorted(map(tuple, merged.collect())) == [("v", 1, "a"), ("v", 2, None)] and bad.count() == 1
    rows = spark.createDataFrame([("k", 1), ("k", 1), ("m", 1), ("m", 2)], "id string, x int")
    assert ingest.merge_identical(rows, "id").collect() == [("k", 1)] and [r.key for r in quality.conflicting_keys(rows, "t", "id", ["x"]).collect()] == ["m"]
    assert ingest.discover(["L21_keyframe_pack.zip", "video.zip"]) == {"keyframe": "L21_keyframe_pack.zip", "video": "video.zip"}
    with pytest.raises(ValueError):
        ingest.discover(["ocr1", "ocr2"])


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert files.export({"t": df}, {"t": "id"}, str(tmp_path / "out")) == {"t": 2}
    seen = files.checksums(spark, str(tmp_path / "out")).where("length > 0 and file like '%json'").select("file", "sha256")
    rows = [tuple(r) for r in seen.collect()]
    expected = spark.createDataFrame([(rows[0][0], "0"), *rows[1:], ("gone", "1")], "file string, sha256 string")
    assert sorted(r.problem for r in files.verify_export(spark, str(tmp_path / "out"), expected).where("file like '%json' or file = 'gone'").collect()) == ["changed", "missing"]
    with pytest.raises(ValueError):
        files.export({"t": df.union(df)}, {"t": "id"}, str(tmp_path / "bad"))
    (tmp_path / "x.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "a", "n": 2}\n')
    assert files.read_last(spark, str(tmp_path / "x.jsonl"), "id string, n int", "id").first().n == 2
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int", "id")
    lines = files.submission_lines(spark.createDataFrame([("q", 1, "v", 5, 'say "x", y')], "query_id string, rank int, video_id string, frame_idx int, answer string"), "QA")
    assert lines.first().line == 'v,5,"say ""x"", y"'
    assert files.safe_path("a/b") and not files.safe_path("/a") and not files.safe_path("a/../b") and not files.safe_path("ftp://x")


def test_engine_refuses_unknown_options():
    with pytest.raises(ValueError):
        engine.Options(weights={"smell": 1.0})
    with pytest.raises(ValueError):
        engine.Options(method="vote")


def test_options_of_branches_and_sequences():
    own = {"bm25.expanded": engine.BranchOptions(weight=0.3), "bm25": engine.BranchOptions(weight=0.9, limit=500)}
    default = engine.BranchOptions(True, 1.0, 100, 800)
    assert engine.resolve(own, "bm25.expanded", "bm25", default) == engine.BranchOptions(True, 0.3, 100, 800)
    assert engine.resolve({"ocr": engine.BranchOptions(enabled=False)}, "ocr.fuzzy", "ocr", default).weight == 0.0
    assert engine.registered({"b2": "b", "b1": "b", "a1": "a"}, {"b1": ("limit", "weight"), "b2": ("limit",)}) == [{"branch": "a", "executions": ["a1"], "controls": []}, {"branch": "b", "executions": ["b1", "b2"], "controls": ["limit"]}]
    assert sequences.SequenceOptions().overridden({"missing": None}) == sequences.SequenceOptions(missing=None)
    with pytest.raises(ValueError):
        sequences.SequenceOptions().overridden({"colour": 1})


def test_objects_in_texts(spark):
    texts = {"x ```json\n{\"a\": {\"b\": 1}}\n``` y {z}": '{"a": {"b": 1}}', 'so {"a": 1} end': '{"a": 1}', "none": None}
    assert {t: one(spark, T.json_object(F.lit(t))) for t in texts} == texts


def test_coverage_of_terms(spark):
    terms = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    asked = one(spark, fields.query_terms(F.lit("Những con thuyền trên Sông 7 và biển biển")))
    assert asked == ["con", "thuyen", "song", "7", "bien"] and one(spark, fields.query_terms(F.lit(None).cast("string"))) == []
    passes = lambda q, e, every=False: one(spark, fields.gate(terms(*q), terms(*e), every))
    assert passes(["a", "b", "c"], ["a", "c"]) and not passes(["a", "b", "c"], ["a"]) and passes(["a"], ["a"]) and not passes([], ["a"])
    assert not passes(["a", "b", "c"], ["a", "b"], True) and passes(["a", "b"], ["b", "a", "z"], True)


def test_packs_maps_and_ledgers(spark, tmp_path):
    pack = tmp_path / "pack"
    (pack / "manifests").mkdir(parents=True)
    (pack / "manifests" / "a.jsonl").write_text('{"id": "a"}\n')
    with pytest.raises(ValueError):
        files.read_pack(spark, str(pack), "id string")
    (pack / "_SUCCESS.json").write_text('{"status": "running"}')
    with pytest.raises(ValueError):
        files.read_pack(spark, str(pack), "id string")
    (pack / "_SUCCESS.json").write_text('{"status": "success"}')
    assert files.read_pack(spark, str(pack), "id string").collect() == [("a",)]
    (tmp_path / "map.csv").write_text("n,pts_time,fps,frame_idx\n2,8.0,25.0,200\n1,0.0,25.0,0\n3,8000.0,25.0,200000\n")
    assert [(r.frame_idx, r.row) for r in files.read_frame_map(spark, str(tmp_path / "map.csv"), "v").orderBy("row").collect()] == [(0, 1), (200, 2), (200000, 3)]
    ledger = spark.createDataFrame([("v", 1), ("w", 1)], "video_id string, state int")
    assert sorted(map(tuple, files.merge_ledger(ledger, spark.createDataFrame([("w", 2)], ledger.schema)).collect())) == [("v", 1), ("w", 2)]
    art = spark.createDataFrame([("b", "n", 1), ("b", "m", 1)], "backend string, name string, v int")
    assert sorted(map(tuple, ingest.replace_artifact(art, spark.createDataFrame([("b", "n", 2)], art.schema)).collect())) == [("b", "m", 1), ("b", "n", 2)]
    lines = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a")], "query_id string, rank int, line string")
    files.write_submission(lines, str(tmp_path / "sub"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sub" / "query_id=q")).collect()] == ["a", "b"]
    traces = spark.createDataFrame([("s", 1), ("t", 2)], "session_id string, created_at int")
    assert [r.session_id for r in files.latest_traces(traces, 1).collect()] == ["t"]
    scored = tasks.score_with(lambda texts: [float(len(t)) for t in texts], "line")(lines)
    assert sorted(r.model_score for r in scored.collect()) == [1.0, 1.0]
    state, weight = ingest.quality_state()
    rows = spark.createDataFrame([(1, 0), (0, 2), (0, 0)], "errors int, warnings int").select(state.alias("s"), weight.alias("w")).collect()
    assert [(r.s, r.w) for r in rows] == [("invalid", 0.0), ("needs_review", 0.75), ("passed", 1.0)]


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "a")], "query_id string, text string")
    assert retrieval.bm25(docs, "doc_id", T.tokens(F.col("text")), queries, T.tokens(F.col("text"))).count() == 0
    scenes = spark.createDataFrame([], "video_id string, scene_id string, scene_idx int, start_sec double, end_sec double")
    assert media.event_groups(scenes).count() == 0 and media.clip_windows(scenes).count() == 0


def test_capped_sessions_as_a_stream(spark, tmp_path):
    times = [0, 1, 2, 10, 11, 12, 13, 14, 15, 16, 500]
    rows = [(i, datetime(2025, 1, 1, 0, t // 60, t % 60), 1, "a", 1.0, "{}") for i, t in enumerate(times)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = windows.capped_sessions(windows.read_events(spark, str(tmp_path / "in")), 2.0, 4.0, "1 second")
    running = out.writeStream.format("memory").queryName("capped").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    got = sorted((r.start.second, r.end.second, r.n) for r in spark.table("capped").collect())
    assert got[:3] == [(0, 2, 3), (10, 14, 5), (15, 16, 2)]


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    from sceneloom.queries import registry

    assert "fuse_rrf" in registry.queries() and callable(registry.flagship)


# --- the best lists of very many queries (pruned.best) ---


def test_best_lists_equal_the_join_of_postings(spark, monkeypatch):
    """Blocks, chunks, repeated documents and queries, and more ties at the border than are kept: as the join gives them."""
    from sceneloom.operators import pruned

    for name, value in (("STEP", 64), ("QUERIES", 8), ("MOST_ASKED", 150), ("PART", 4), ("SHARED", 2), ("OFTEN", 0.05)):
        monkeypatch.setattr(pruned, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: [words[int(x)] for x in np.minimum(rng.geometric(0.08, n) - 1, 59)]
    docs = [(f"d{i:04}", text(int(rng.integers(0, 12)))) for i in range(600)] + [(f"c{i:03}", ["w1", "w2"]) for i in range(90)]
    queries = [(f"q{i:03}", text(int(rng.integers(0, 8))) + ["unknown"] * (i % 2)) for i in range(50)] + [(f"r{i}", ["w1", "w1", "w2"]) for i in range(5)]
    d = spark.createDataFrame(docs, "doc_id string, w array<string>").repartition(3)
    q = spark.createDataFrame(queries, "query_id string, w array<string>")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    got = rows(retrieval.bm25_top(d, "doc_id", F.col("w"), q, F.col("w"), 7))
    assert got == rows(retrieval.top_k(retrieval.bm25(d, "doc_id", F.col("w"), q, F.col("w")), 7))
    # 90 equal documents: the first ids come first
    assert [x[2] for x in got if x[0] == "r0"][:7] == [x[2] for x in rows(retrieval.top_k(retrieval.bm25(d, "doc_id", F.col("w"), q.where("query_id = 'r0'"), F.col("w")), 7))]
    tags = d.withColumn("tags", F.array_distinct("w"))
    asked = q.withColumn("tags", F.array_distinct("w"))
    assert rows(retrieval.tag_overlap_top(asked, tags, 7)) == rows(retrieval.top_k(retrieval.tag_overlap(asked, tags), 7))


def test_lists_over_several_chunks_equal_one(spark):
    """Memory of a task is that of a chunk and of its lists, whatever the number of documents."""
    import pyarrow as pa

    from sceneloom.operators import pruned

    rng = np.random.default_rng(5)
    pairs = [(f"q{i}", f"w{j}", 1.0, 3) for i in range(20) for j in rng.choice(30, 3, replace=False)]
    table = pa.table({"query_id": [p[0] for p in pairs], "token": [p[1] for p in pairs], "times": [p[2] for p in pairs], "n": [p[3] for p in pairs]})
    asked = pruned.Asked(table, pa.array([f"w{i}" for i in range(30)]), None)
    code = rng.integers(0, 30, 4000)
    ids = pa.array([f"d{x:05}" for x in rng.permutation(1000)])
    found = []
    for step in (1000, 170):
        lists = pruned.Lists(asked, 5, lambda tf, length: (tf > 0).astype(float))
        for x in range(0, 1000, step):
            y = min(1000, x + step)
            lists.chunk(ids[x:y], code[4 * x : 4 * y], np.ones(4 * (y - x)), np.full(y - x, 4), np.full(y - x, 4.0))
        assert lists.score.shape == (20, 5)
        found.append([[(float(s), lists.ids[int(i)].as_py()) for s, i in zip(a, b) if s > 0] for a, b in zip(lists.score, lists.doc)])
    assert found[0] == found[1]
    held = {i.as_py(): set(code[4 * n : 4 * n + 4].tolist()) for n, i in enumerate(ids)}
    for q in range(20):
        mine = {int(w[1:]) for a, w, _, _ in pairs if a == asked.ids[int(asked.member_ptr[q])].as_py()}
        best = sorted((-np.floor(len(mine & s) / 3 * 1e6 + 0.5), i) for i, s in held.items() if mine & s)[:5]
        assert [(-s, i) for s, i in best] == found[0][q]


def test_weighted_fields_equal_brute_force_without_pairs(spark, monkeypatch):
    """Weights of fields, the gate on terms and its ties, without the join of postings and queries."""
    monkeypatch.setattr(fields.retrieval, "top_k", lambda *_, **__: pytest.fail("pairs of all postings"))
    rng = np.random.default_rng(9)
    say = lambda n: " ".join(f"word{int(x)}" for x in rng.integers(0, 12, n))
    docs = [(f"d{i:03}", say(int(rng.integers(0, 6))), say(int(rng.integers(0, 4)))) for i in range(200)]
    queries = [(f"q{i}", sorted(set(say(int(rng.integers(1, 9))).split()))) for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id string, a string, b string")
    q = spark.createDataFrame(queries, "query_id string, terms array<string>")
    held = {i: [(w, 2.0) for w in a.split()] + [(w, 1.2) for w in b.split()] for i, a, b in docs}
    length = {i: sum(x for _, x in ws) for i, ws in held.items()}
    mean = sum(length.values()) / len(docs)
    df = {f"word{n}": sum(any(w == f"word{n}" for w, _ in ws) for ws in held.values()) for n in range(12)}
    for match_all in (False, True):
        expected = []
        for qid, terms in queries:
            out = []
            for i, ws in held.items():
                tf = {t: sum(x for w, x in ws if w == t) for t in terms}
                met = [t for t in terms if tf[t]]
                if len(met) < min(2, len(terms)) or len(met) / len(terms) + 1e-12 < (1.0 if match_all else 0.34):
                    continue
                score = sum(np.log1p((200 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * length[i] / mean)) for t in met)
                out.append((-round(score, 6), i, round(len(met) / len(terms), 6)))
            expected += [(qid, n, i, -s, c) for n, (s, i, c) in enumerate(sorted(out)[:6], 1)]
        got = fields.field_branch(d, {"a": 2.0, "b": 1.2}, q, 6, match_all).collect()
        assert sorted((r.query_id, r["rank"], r.doc_id, r.score, r.coverage) for r in got) == sorted(expected)


def test_answers_are_joined_only_where_the_place_is_right(spark):
    """Texts of results in a wrong place aren't read; queries without results stay."""
    from sceneloom.operators import evaluation

    results = spark.createDataFrame([("a", "d1", "v", 5, 1), ("a", "d2", "v", 50, 2), ("b", "d1", "w", 5, 1)], "query_id string, doc_id string, video_id string, frame_idx int, rank int")
    gold = spark.createDataFrame([(x, "v", 0, 10, ["Thuyền"]) for x in "abc"], "query_id string, video_id string, low int, high int, accepted array<string>")
    answers = spark.createDataFrame([("d1", "một thuyền"), ("d2", "thuyền")], "doc_id string, answer string")
    got = {r.query_id: tuple(r)[1:] for r in evaluation.answer_scores(results, gold, answers).collect()}
    assert got == {"a": (1, True, True), "b": (None, False, False), "c": (None, False, False)}
    assert got == {r.query_id: tuple(r)[1:] for r in evaluation.answer_scores(results.join(answers, "doc_id"), gold).collect()}


def test_best_lists_are_cut_by_places_and_equal_brute_force(spark, monkeypatch):
    # a task holds the lists of so many queries as fit, however long the lists are
    from sceneloom.operators import pruned

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i:03}", " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(1, 25)))) for i in range(400)]
    asked = [(f"q{i:02}", " ".join(rng.sample(words, rng.randint(1, 9)) + words[:1] * (i % 3))) for i in range(60)]
    d, q = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(asked, "query_id string, query string")
    held = []
    made = pruned.Asked.__init__
    monkeypatch.setattr(pruned.Asked, "__init__", lambda self, *a: (made(self, *a), held.append(len(self.ids)))[0])
    monkeypatch.setattr(pruned, "PLACES", 400)
    split = lambda c: F.split(c, " ")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.bm25_top(d, "doc_id", split(F.col("text")), q, split(F.col("query")), 20).collect()}
    want = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.top_k(retrieval.bm25(d, "doc_id", split(F.col("text")), q, split(F.col("query"))), 20).collect()}
    assert got == want
    assert len(held) == 3 and sum(held) == 60


def test_scene_texts_are_those_of_the_documents(spark):
    from sceneloom.queries import common as C
    from sceneloom.runtime import table
    from sceneloom.sources import tables

    d = "/root/testdata/sf0.001"
    docs = C.documents(spark, d)
    for field in C.FIELDS.values():
        slim = tables.scene_texts(table(spark, d, "scenes"), table(spark, d, "keyframes"), field)
        rows = lambda df: sorted((r[0], sorted(r[1] or [])) for r in df.select("scene_id", field).collect())  # noqa: B023, E731
        assert rows(slim) == rows(docs)


def test_evidence_keeps_the_form_of_texts(spark):
    # texts become digests once per scene, before candidates meet them
    from sceneloom.operators import evidence

    rows = [(f"s{i}", "v", i, ["text", str(i)], ["sign"] * (i % 2), []) for i in range(3)]
    docs = spark.createDataFrame(rows, "scene_id string, video_id string, scene_idx int, captions array<string>, ocr_texts array<string>, asr_texts array<string>")
    found = spark.createDataFrame([("q", "s0", 1), ("q", "s1", 2), ("p", "s1", 1)], "query_id string, doc_id string, rank int")
    digest = lambda c: F.md5(F.coalesce(c, F.lit("")))
    names = ("caption", "ocr", "asr", "previous_caption", "next_caption")
    late = evidence.evidence_packs(found, docs).withColumns({c: digest(F.col(c)) for c in names})
    early = evidence.evidence_packs(found, docs, digest)
    assert sorted(map(str, early.collect())) == sorted(map(str, late.collect()))
    assert early.where("doc_id = 's0' AND previous_id IS NULL").count() == 1
