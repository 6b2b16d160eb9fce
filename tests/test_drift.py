"""Problem 1 against a line-by-line version, and the edit scripts against exhaustive search."""

import itertools
import json
from collections import defaultdict
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sceneloom.operators import drift

SCHEMA = "file_id bigint, dataset_id string, entity string, file_path string, exported_at timestamp_ntz, line_no int, raw_json string"


def brute(rows):
    """The changes by the statement of the problem, one file after the other."""
    kinds = {str: "string", int: "integer", float: "decimal", bool: "boolean", list: "array", dict: "object"}
    files = defaultdict(lambda: {"fields": set(), "kinds": {}, "records": {}})
    order = defaultdict(set)
    for file_id, dataset, entity, at, raw in rows:
        try:
            o = json.loads(raw)
        except (ValueError, TypeError):
            continue
        if not isinstance(o, dict):
            continue
        flat = {}
        for k, v in o.items():
            if k == "provenance" and isinstance(v, dict):
                flat |= {f"provenance.{a}": b for a, b in v.items()}
            elif k != "extensions":
                flat[k] = v
        f = files[file_id]
        f["fields"] |= set(flat)
        for k, v in flat.items():
            if v is not None:
                f["kinds"][k] = kinds[type(v)]
        key = o.get("scene_id" if entity == "scenes" else "build_id")
        if key:
            f["records"][key] = flat
        order[dataset, entity].add((at, file_id))
    out = set()
    for sequence in order.values():
        state, prev = {}, None
        for _, file_id in sorted(sequence):
            f = files[file_id]
            if prev is None:
                state = dict.fromkeys(f["fields"]) | f["kinds"]
                prev = f
                continue
            gone, come = prev["fields"] - f["fields"], f["fields"] - prev["fields"]
            both = set(prev["records"]) & set(f["records"])
            renamed = {}
            for a, b in itertools.product(sorted(gone), sorted(come)):
                old, new = ([json.dumps(x["records"][r].get(n), sort_keys=True) for r in sorted(both)] for x, n in ((prev, a), (f, b)))
                if a not in renamed and b not in renamed.values() and old == new and any(x != "null" for x in old):
                    renamed[a] = b
            nxt = {k: v for k, v in state.items() if k in f["fields"]}
            for a in gone:
                out.add((file_id, "renamed", a, renamed[a]) if a in renamed else (file_id, "removed", a, ""))
            for b in come - set(renamed.values()):
                out.add((file_id, "added", "", b))
                nxt[b] = None
            for a, b in renamed.items():
                nxt[b] = state[a]
            for k, kind in f["kinds"].items():
                if nxt.get(k) and nxt[k] != kind:
                    out.add((file_id, "retyped", k, k))
                nxt[k] = kind
            state, prev = nxt, f
    return out


def test_changes_equal_the_line_by_line_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/export_lines.parquet")
    rows = [tuple(r) for r in df.select("file_id", "dataset_id", "entity", "exported_at", "raw_json").collect()]
    got = [tuple(r) for r in drift.schema_changes(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def _lines(spark, files):
    rows = [(i, "d", "scenes", "p", datetime(2025, 1, 1 + i), n, raw if isinstance(raw, str) or raw is None else json.dumps(raw)) for i, lines in enumerate(files) for n, raw in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rename_move_retype_and_broken_lines(spark):
    files = [
        [{"scene_id": "a", "x": 1, "provenance": {"pipeline": "p1"}}, "", None, "[1]", '{"scene_id": "b", "x'],
        [{"scene_id": "a", "y": 1, "provenance": {"pipeline": "p1"}}] * 3,
        [{"scene_id": "a", "y": None, "pipeline": "p1"}],
        [{"scene_id": "a", "y": 1.0, "pipeline": "p1"}],
        [{"scene_id": "a", "pipeline": "p1"}],
        [{"scene_id": "a", "y": "1", "pipeline": "p1"}],
    ]
    got = {tuple(r) for r in drift.schema_changes(_lines(spark, files)).collect()}
    assert got == {
        (1, "renamed", "x", "y"),
        (2, "renamed", "provenance.pipeline", "pipeline"),
        (3, "retyped", "y", "y"),
        (4, "removed", "y", ""),
        (5, "added", "", "y"),
    }
    # x, y and (removed, then added again) y are one name's column; the latest value that isn't null is kept, 1.0 and "1" as what most files say
    one = drift.unified_table(_lines(spark, files), "scenes").collect()
    assert [(r.record, r.y, r.pipeline, r.file_id) for r in one] == [("a", 1, "p1", 5)]


def test_inner_nodes_are_renamed_and_left():
    entered = ("provenance", "origin")
    old = {"provenance.model": 1, "provenance.device": 2, "provenance.run": 3, "a": 4}
    assert drift.edit_script(old, {"origin.model": 1, "origin.device": 2, "a": 4}, entered) == [
        ("renamed", "provenance.device", "origin.device"),
        ("renamed", "provenance.model", "origin.model"),
        ("removed", "provenance.run", ""),
    ]
    # equal values: the rename within the parent is preferred to the move
    assert drift.edit_script({"a": 1, "provenance.b": 1, "provenance.z": 5}, {"x": 1, "provenance.y": 1, "provenance.z": 5}) == [("renamed", "a", "x"), ("renamed", "provenance.b", "provenance.y")]
    assert drift.edit_script({"provenance.b": 1, "c": 2}, {"b": 1, "c": 2, "d": 3}) == [("renamed", "provenance.b", "b"), ("added", "", "d")]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "p.a", "p.b", "q.a", "q.c"]), st.integers(0, 2), max_size=5), st.dictionaries(st.sampled_from(["a", "c", "p.b", "p.d", "q.a", "r.a"]), st.integers(0, 2), max_size=5))
def test_script_renames_as_many_as_can_be(old, new):
    steps = drift.edit_script(old, new, ("p", "q", "r"))
    gone, come = {k: v for k, v in old.items() if k not in new}, {k: v for k, v in new.items() if k not in old}
    most = sum(min(list(gone.values()).count(v), list(come.values()).count(v)) for v in range(3))
    assert sum(op == "renamed" for op, _, _ in steps) == most
    assert all(gone[a] == come[b] for op, a, b in steps if op == "renamed")
    assert sorted(a for op, a, _ in steps if op != "added") == sorted(gone) and sorted(b for op, _, b in steps if op != "removed") == sorted(come)


def test_table_of_typed_columns(spark):
    files = [
        [{"scene_id": "a", "x": 1, "t": 7, "w": "old", "provenance": {"model": "m1"}}, {"scene_id": "b", "x": 2, "t": 8}, {"scene_id": "c", "x": 3}],
        [{"scene_id": "a", "y": 1, "t": None, "w": "new", "q": 0.5, "extensions": {"e": 1}}, {"scene_id": "a", "y": 9, "w": "repeated"}, {"scene_id": "b", "y": [2]}],
        [{"scene_id": "a", "w": None}, {"scene_id": "b", "y": {"value": 5}, "t": [8, 9]}, {"scene_id": None, "w": "lost"}],
    ]
    got = {r.record: r for r in drift.unified_table(_lines(spark, files), "scenes").collect()}
    assert {k: (r.file_id, r.t, r.w, r.q, r.provenance_model, r.extensions, r.rest) for k, r in got.items()} == {
        "a": (2, 7, "new", 0.5, "m1", '{"e":1}', {}),
        "b": (2, None, None, None, None, None, {"t": "[8,9]"}),
        "c": (0, None, None, None, None, None, {}),
    }
    assert (got["a"].y, got["b"].y, got["c"].y) == (1, 5, None) and got["c"].x == 3  # b's list spoils the rename, so x and y stay two fields


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(empty).count() == 0
    assert drift.unified_table(empty, "scenes").columns == ["file_id", "dataset_id", "record", "extensions", "rest"]
    assert drift.unified_table(empty, "scenes").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=4, max_size=4), min_size=1, max_size=4))
def test_assignment_is_cheapest(cost):
    chosen = drift.assign(cost)
    best = min(sum(row[j] for row, j in zip(cost, p)) for p in itertools.permutations(range(4), len(cost)))
    assert len(set(chosen)) == len(cost) and sum(row[j] for row, j in zip(cost, chosen)) == pytest.approx(best)


def test_script_prefers_the_similar_name():
    old, new = {"a": 0, "end_frame": (1, 2)}, {"a": 0, "frame_rate": (1, 2), "endFrame": (1, 2)}
    assert drift.edit_script(old, new) == [("renamed", "end_frame", "endFrame"), ("added", "", "frame_rate")]
    assert drift.edit_script({"a": None}, {"b": None}) == [("removed", "a", ""), ("added", "", "b")]
