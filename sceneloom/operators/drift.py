"""Schemas that drift between files (problem 1).

Every line of a file is a JSON object; files of one sequence follow each other in
time. The schema of a file is a tree: object keys, of which some (``entered``) are
inner nodes with keys of their own. For two successive files a tree edit gives the
minimum-cost script that turns the old tree into the new one: delete, add, rename
(of a leaf or of an inner node, within one parent) and move (to another parent).
A leaf may be renamed or moved only if its values agree on all records that both
files hold; that test is made in the cluster by order-free signatures, and only for
files that have lost and gained fields, only for those fields.

Lines are parsed once, a batch at a time, for the trees of the files (in Python, as the
built-in variants took three times as long); all that follows works on one row per file, and the lines of the files that need signatures are read a second time.
The scripts of all files are compiled into one projection: names that a script links
are one field (unless some file carries both), and each field has one type.

Defined results: lines that aren't complete JSON objects (cut off, blank, arrays,
null) are ignored, as are files of which no line is left; repeated lines count
once; a record without its key takes no part in the test of renames; values of
several types in one file are a type of their own; an empty table gives no rows;
other columns of the table are ignored. Integers beyond 64 bits count as decimal.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .blocked import blocked_last

#: Objects whose keys are fields of their own (dotted paths); every other object or array is a single value.
ENTERED = ("provenance",)
#: Keys that are never reported.
UNREPORTED = ("extensions",)
#: The key of a record, by entity.
RECORD_KEY = {"scenes": "scene_id", "dataset_manifest": "build_id"}
#: Types of values, as the bits of a mask.
KINDS = {"string": 1, "integer": 2, "decimal": 4, "boolean": 8, "array": 16, "object": 32}
#: Rows of a table of files up to which it is broadcast (a row has few names), and most names of fields of an entity.
FEW_FILES, MOST_NAMES = 50_000, 100_000

DELETE = ADD = 1.0
RENAME, MOVE, NAME_WEIGHT = 0.5, 0.75, 0.2


# --- trees ---


@dataclass
class Node:
    """A node of a schema: a leaf (a field, with the signature of its values) or an entered object."""

    path: str
    signature: object = None
    children: dict[str, Node] | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.children is None else [x for _, c in sorted(self.children.items()) for x in c.leaves()]


def tree(paths: dict[str, object], entered: tuple[str, ...] = ENTERED) -> Node:
    """The tree of dotted paths; a dot parts two nodes only where an entered object ends."""
    root = Node("", children={})
    for path, signature in sorted(paths.items()):
        at, start = root, 0
        for prefix in sorted((e for e in entered if path.startswith(e + ".")), key=len):
            at = at.children.setdefault(prefix[start:] + ".", Node(prefix, children={}))
            start = len(prefix) + 1
        at.children[path[start:]] = Node(path, signature)
    return root


def name_distance(a: str, b: str) -> float:
    """Edit distance of two names as a share of the longer one."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1] / max(len(a), len(b), 1)


def assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to columns (at least as many columns as rows), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, came, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[at]:
            done[at] = True
            row, step, to = match[at], float("inf"), 0
            for j in range(1, m + 1):
                if done[j]:
                    continue
                reduced = cost[row - 1][j - 1] - u[row] - v[j]
                if reduced < least[j]:
                    least[j], came[j] = reduced, at
                if least[j] < step:
                    step, to = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            match[at], at = match[came[at]], came[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


NEVER = 1e6


def _matched(gone: list[Node], come: list[Node], change) -> tuple[float, list[tuple[Node, Node]]]:
    """The cheapest way from the subtrees ``gone`` to ``come``: its cost and the pairs that are changed, not deleted and added."""
    weight = lambda x: DELETE * len(x.leaves())  # noqa: E731  (an addition costs as much)
    rest = sum(map(weight, come))
    if not gone:
        return rest, []
    cost = [[change(a, b) - weight(b) for b in come] + [weight(a) if i == j else NEVER for j in range(len(gone))] for i, a in enumerate(gone)]
    chosen = assign(cost)
    return rest + sum(cost[i][j] for i, j in enumerate(chosen)), [(gone[i], come[j]) for i, j in enumerate(chosen) if j < len(come)]


def _edit(a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
    """Cost and renamed leaves of the edit between two inner nodes; children of one label are the same field."""
    cost, renamed, same = 0.0, [], set()
    for label in a.children.keys() & b.children.keys():
        same.add(label)
        if a.children[label].children is not None:
            inner, pairs = _edit(a.children[label], b.children[label])
            cost, renamed = cost + inner, renamed + pairs
    parts = {}

    def change(x: Node, y: Node) -> float:
        name = NAME_WEIGHT * name_distance(x.path.rpartition(".")[2], y.path.rpartition(".")[2])
        if x.children is None and y.children is None:
            return RENAME + name if x.signature is not None and x.signature == y.signature else NEVER
        if x.children is None or y.children is None:
            return NEVER
        parts[x.path, y.path] = inner, pairs = _edit_inner(x, y)
        return RENAME + name + inner if pairs else NEVER

    gone, come = ([n for label, n in sorted(t.children.items()) if label not in same] for t in (a, b))
    rest, pairs = _matched(gone, come, change)
    for x, y in pairs:
        renamed += [(x, y)] if x.children is None else parts[x.path, y.path][1]
    return cost + rest, renamed


def _edit_inner(x: Node, y: Node) -> tuple[float, list[tuple[Node, Node]]]:
    """An inner node under a new name: its leaves change their paths, so even those of one label must agree in value."""
    pairs = [(x.children[k], y.children[k]) for k in sorted(x.children.keys() & y.children.keys())]
    kept = [(p, q) for p, q in pairs if p.children is None and q.children is None and p.signature is not None and p.signature == q.signature]
    held = {id(n) for pair in kept for n in pair}
    rest, more = _matched([n for n in x.leaves() if id(n) not in held], [n for n in y.leaves() if id(n) not in held], lambda p, q: RENAME if p.signature is not None and p.signature == q.signature else NEVER)
    return rest, kept + more


def edit_script(old: dict[str, object], new: dict[str, object], entered: tuple[str, ...] = ENTERED) -> list[tuple[str, str, str]]:
    """The minimum-cost script between two trees, given as path -> signature of the leaf (None: matches nothing).

    Nodes with the same path match at no cost. Renames within a parent (of leaves, or of an inner node with what it
    holds) are chosen first, by a minimum-cost assignment at each inner node; leaves that remain may move to another
    parent. Similar names cost less, so that the script is the same however many equal columns there are.
    Returns (op, old path, new path) of leaves, ops being 'removed', 'added' and 'renamed' (a move is a rename
    whose paths have different parents).
    """
    a, b = tree(old, entered), tree(new, entered)
    _, renamed = _edit(a, b)
    from_, to = {x.path: y.path for x, y in renamed}, {y.path for _, y in renamed}
    gone = [n for n in a.leaves() if n.path not in new and n.path not in from_]
    come = [n for n in b.leaves() if n.path not in old and n.path not in to]
    _, moved = _matched(gone, come, lambda x, y: MOVE + NAME_WEIGHT * name_distance(x.path.rpartition(".")[2], y.path.rpartition(".")[2]) if x.signature is not None and x.signature == y.signature else NEVER)
    from_ |= {x.path: y.path for x, y in moved}
    to |= {y.path for _, y in moved}
    steps = [("renamed", n, from_[n]) if n in from_ else ("removed", n, "") for n in sorted(set(old) - set(new))]
    return steps + [("added", "", n) for n in sorted(set(new) - set(old)) if n not in to]


# --- lines and files ---


@dataclass(frozen=True)
class Layout:
    """What the operator is told about the files."""

    record_key: dict[str, str] = field(default_factory=lambda: dict(RECORD_KEY))
    entered: tuple[str, ...] = ENTERED
    unreported: tuple[str, ...] = UNREPORTED

    def record(self) -> Column:
        """The key of the record that a line (entity, v) holds."""
        keys = [F.when(F.col("entity") == e, F.try_variant_get("v", f"$.{k}", "string")) for e, k in self.record_key.items()]
        return F.nullif(F.coalesce(*keys), F.lit(""))


LAYOUT = Layout()


def _object(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key twice in one object")
    return found


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def read_object(raw: str | None) -> dict | None:
    """A complete JSON object, or None."""
    if raw is None or "{" not in raw:
        return None
    try:
        found = json.loads(raw, object_pairs_hook=_object, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def flat(found: dict, layout: Layout) -> dict[str, object]:
    """The reported fields of an object by path, entered objects being replaced by their keys."""
    out = {k: v for k, v in found.items() if k not in layout.unreported}
    for path in sorted(layout.entered, key=len):
        inner = out.get(path)
        if isinstance(inner, dict):
            del out[path]
            for k, v in inner.items():
                out[f"{path}.{k}"] = v
    return out


_KIND_OF = {type(None): 0, str: KINDS["string"], int: KINDS["integer"], float: KINDS["decimal"], bool: KINDS["boolean"], list: KINDS["array"], dict: KINDS["object"]}


def kind_of(value: object) -> int:
    """The bit of a value's type, 0 for a null value."""
    kind = _KIND_OF[type(value)]
    return KINDS["decimal"] if kind == KINDS["integer"] and not -(1 << 63) <= value < 1 << 63 else kind


def _plain(texts: list[str]) -> list[str]:
    """Without lone surrogates, which no table holds."""
    return [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]


_FIELDS_TYPE = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.int32())]))


def _fields(layout: Layout):
    """The fields of the files of each batch of lines (file_id, dataset_id, entity, exported_at, raw_json), one row per file of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, dict[str, int]] = {}
            place: list[int] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.int64()).to_pylist())
            for i, (key, raw) in enumerate(zip(keys, batch.column(4).to_pylist())):
                found = read_object(raw)
                if found is None:
                    continue
                kinds = held.get(key)
                if kinds is None:
                    kinds = held[key] = {}
                    place.append(i)
                for path, value in flat(found, layout).items():
                    kinds[path] = kinds.get(path, 0) | kind_of(value)
            trees = [sorted(zip(_plain(list(kinds)), kinds.values())) for kinds in held.values()]
            paths, masks = [p for t in trees for p, _ in t], [m for t in trees for _, m in t]
            ends = [0]
            for t in trees:
                ends.append(ends[-1] + len(t))
            fields = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(masks, pa.int32())], names=["path", "kind"]))
            at = pa.array(place, pa.int64())
            yield pa.record_batch([*(batch.column(i).take(at) for i in range(4)), fields], names=[*batch.schema.names[:4], "fields"])

    return run


def file_trees(lines: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(file_id, dataset_id, entity, exported_at, fields): each file with its fields (path, kind) in order, kind being a mask of types."""
    named = lines.where("file_id is not null and dataset_id is not null and entity is not null and exported_at is not null and raw_json is not null")
    key = [F.col("file_id").cast("long").alias("file_id"), F.col("dataset_id").cast("string").alias("dataset_id"), F.col("entity").cast("string").alias("entity"), F.col("exported_at").cast("timestamp_ntz").alias("exported_at")]
    each = named.select(*key, "raw_json").mapInArrow(_fields(layout), "file_id bigint, dataset_id string, entity string, exported_at timestamp_ntz, fields array<struct<path:string,kind:int>>")
    # the batches of a large file mostly have the same fields, so what is gathered per file is short
    whole = each.distinct().groupBy("file_id").agg(F.min("dataset_id").alias("dataset_id"), F.min("entity").alias("entity"), F.min("exported_at").alias("exported_at"), F.collect_list("fields").alias("lists"))
    every = F.flatten("lists")
    mask = lambda p: F.aggregate(F.filter(every, lambda x: x["path"] == p), F.lit(0), lambda m, x: m.bitwiseOR(x["kind"]))
    merged = F.array_sort(F.transform(F.array_distinct(F.transform(every, lambda f: f["path"])), lambda p: F.struct(p.alias("path"), mask(p).alias("kind"))))
    return whole.select("file_id", "dataset_id", "entity", "exported_at", F.when(F.size("lists") == 1, F.get("lists", F.lit(0))).otherwise(merged).alias("fields"))


def _week(c: str) -> Column:
    return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (7 * 86400))


def _paths(fields: str) -> Column:
    return F.transform(fields, lambda f: f["path"])


def compared(files: DataFrame) -> DataFrame:
    """The files with the one before in their sequence: prev_file, prev_fields, and the paths that are gone and have come."""
    me = files.withColumn("me", F.struct("file_id", "fields"))
    seen = blocked_last(me, ["dataset_id", "entity"], ["exported_at", "file_id"], "me", "prev", _week("exported_at"), inclusive=False)
    first = F.col("prev").isNull()
    none = F.array().cast("array<string>")
    return seen.select(
        "file_id", "dataset_id", "entity", "exported_at", "fields", F.col("prev.file_id").alias("prev_file"), F.col("prev.fields").alias("prev_fields"),
        F.when(first, none).otherwise(F.array_except(_paths("prev.fields"), _paths("fields"))).alias("gone"),
        F.when(first, none).otherwise(F.array_except(_paths("fields"), _paths("prev.fields"))).alias("come"),
    )


def signatures(lines: DataFrame, pairs: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(pair, side, path, n, sig_a, sig_b) of the fields that are gone from or have come to ``pairs`` (file_id, prev_file, gone, come).

    Only records of both files count; n is the number of those with a value that isn't null.
    """
    wanted = pairs.select(F.col("file_id").alias("pair"), F.explode(F.array(F.struct(F.lit("new").alias("side"), F.col("file_id"), F.col("come").alias("paths")), F.struct(F.lit("old").alias("side"), F.col("prev_file").alias("file_id"), F.col("gone").alias("paths")))).alias("w")).select("pair", "w.*")
    if wanted.count() <= FEW_FILES:
        wanted = F.broadcast(wanted)
    met = lines.where("file_id is not null and raw_json is not null").select(F.col("file_id").cast("long").alias("file_id"), "entity", "raw_json").join(wanted, "file_id")
    values = met.select("pair", "side", "paths", "entity", "raw_json").mapInArrow(_values(layout), "pair bigint, side string, record string, values array<struct<path:string,value:bigint>>")
    sides = {s: F.min(F.when(F.col("side") == s, F.col("values"))).alias(s) for s in ("old", "new")}
    both = values.groupBy("pair", "record").agg(*sides.values()).where("old is not null and new is not null")
    tag = lambda s: F.transform(s, lambda x: F.struct(F.lit(s).alias("side"), x["path"].alias("path"), x["value"].alias("value")))
    each = both.select("pair", "record", F.explode(F.concat(*map(tag, sides))).alias("x"))
    return each.groupBy("pair", F.col("x.side").alias("side"), F.col("x.path").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("record", "x.value")).alias("sig_a"), F.bit_xor(F.xxhash64(F.lit("b"), "x.value", "record")).alias("sig_b")
    )


def _values(layout: Layout):
    """Hashes of the wanted values that aren't null, of each line (pair, side, paths, entity, raw_json) with a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            at, records, out = [], [], []
            for i, (paths, entity, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                found = read_object(raw)
                record = found.get(layout.record_key.get(entity)) if found else None
                if not isinstance(record, str) or not record:
                    continue
                held = flat(found, layout)
                at.append(i)
                records.append(record)
                out.append([{"path": p, "value": xxhash.xxh3_64_intdigest(json.dumps([kind_of(held[p]), held[p]], sort_keys=True)) - (1 << 63)} for p in sorted(paths) if held.get(p) is not None])
            take = pa.array(at, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(_plain(records), pa.string()), pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("value", pa.int64())])))],
                names=["pair", "side", "record", "values"],
            )

    return run


def _scripts(entered: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for gone, come, signed in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                known = {(s["side"], s["path"]): (s["n"], s["sig_a"], s["sig_b"]) for s in signed or []}
                steps = edit_script({p: known.get(("old", p)) for p in gone}, {p: known.get(("new", p)) for p in come}, entered)
                out.append([dict(zip(("op", "old", "new"), s)) for s in steps])
            yield pa.record_batch([ids, pa.array(out, pa.list_(pa.struct([("op", pa.string()), ("old", pa.string()), ("new", pa.string())])))], names=["file_id", "steps"])

    return run


_STEP = "struct<op:string,old:string,new:string>"


def schema_history(lines: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(file_id, dataset_id, entity, exported_at, fields, prev_fields, steps): each file with the script (op, old, new) that leads to it."""
    chain = checkpoint(compared(checkpoint(file_trees(lines, layout))))
    unsure = chain.where((F.size("gone") > 0) & (F.size("come") > 0)).select("file_id", "prev_file", "gone", "come")
    signed = signatures(lines, unsure, layout).groupBy(F.col("pair").alias("file_id")).agg(F.collect_list(F.struct("side", "path", "n", "sig_a", "sig_b")).alias("signed"))
    scripts = unsure.join(signed, "file_id", "left").select("file_id", "gone", "come", "signed").mapInArrow(_scripts(layout.entered), f"file_id bigint, steps array<{_STEP}>")
    step = lambda op, old, new: F.struct(F.lit(op).alias("op"), old.alias("old"), new.alias("new"))
    sure = F.concat(F.transform("gone", lambda p: step("removed", p, F.lit(""))), F.transform("come", lambda p: step("added", F.lit(""), p)))
    return chain.join(scripts, "file_id", "left").select("file_id", "dataset_id", "entity", "exported_at", "fields", "prev_fields", F.coalesce("steps", sure).alias("steps"))


def retyped(history: DataFrame) -> DataFrame:
    """(file_id, path): fields whose type differs from the last one that the field had, under any name.

    The file before tells that type in most cases; only where the field had no value there are its files scanned.
    """
    each = history.select("file_id", "dataset_id", "entity", "exported_at", "prev_fields", "steps", F.explode("fields").alias("f")).select("*", F.col("f.path").alias("path"), F.nullif("f.kind", F.lit(0)).alias("kind"))
    start = F.get(F.filter("steps", lambda s: s["new"] == F.col("path")), F.lit(0))
    in_last = lambda name: F.get(F.filter("prev_fields", lambda p: p["path"] == name), F.lit(0))["kind"]
    # a renamed field had a value that wasn't null under its old name in the file before, so its type there is known; an added one starts afresh (-1)
    old = F.when(start["op"] == "added", -1).when(start["op"] == "renamed", in_last(start["old"]))
    rows = each.select("file_id", "dataset_id", "entity", "exported_at", "path", "kind", old.alias("old"), in_last(F.col("path")).alias("before"))
    known = F.coalesce("old", F.nullif("before", F.lit(0)))
    plain = rows.where(F.col("kind").isNotNull() & (known > 0) & (known != F.col("kind"))).select("file_id", "path")
    unsure = F.col("kind").isNotNull() & F.col("old").isNull() & (F.col("before") == 0)
    key = ["dataset_id", "entity", "path"]
    scanned = rows.join(rows.where(unsure).select(*key).distinct(), key, "left_semi").withColumn("known", F.coalesce("kind", "old"))
    filled = blocked_last(scanned, key, ["exported_at", "file_id"], "known", "last", _week("exported_at"), inclusive=False)
    return plain.unionByName(filled.where(unsure & (F.col("last") > 0) & (F.col("last") != F.col("kind"))).select("file_id", "path"))


def schema_changes(lines: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(file_id, change_kind, old_field, new_field): every change with the file in which it first shows."""
    history = checkpoint(schema_history(lines, layout))
    steps = history.select("file_id", F.explode("steps").alias("s")).select("file_id", F.col("s.op").alias("change_kind"), F.col("s.old").alias("old_field"), F.col("s.new").alias("new_field"))
    return steps.unionByName(retyped(history).select("file_id", F.lit("retyped").alias("change_kind"), F.col("path").alias("old_field"), F.col("path").alias("new_field")))


# --- one table ---


@dataclass(frozen=True)
class FieldClass:
    """A field under all its names: the name that most files use, the others, and the one type of its column."""

    name: str
    names: tuple[str, ...]
    kind: str


def _few(df: DataFrame) -> list:
    rows = df.limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names of fields")
    return rows


def field_classes(history: DataFrame) -> list[FieldClass]:
    """The fields of one entity, from the names and scripts of all its files (schemas, not records, reach the driver).

    Names that scripts link are one field, the links of most files first; a link is left out where some file
    carries names of both sides. The type is the one that most files have, integers giving way to decimals
    where both occur.
    """
    counts = [F.count_if(F.col("f.kind").bitwiseAND(bit) > 0).alias(kind) for kind, bit in KINDS.items()]
    uses = {r.path: r for r in _few(history.select(F.explode("fields").alias("f")).groupBy(F.col("f.path").alias("path")).agg(F.count(F.lit(1)).alias("files"), *counts))}
    links = _few(history.select(F.explode("steps").alias("s")).where("s.op = 'renamed'").groupBy("s.old", "s.new").agg(F.count(F.lit(1)).alias("n")))
    linked = sorted({x for r in links for x in (r.old, r.new)})
    together = set()
    if linked:
        present = history.select(F.array_intersect(_paths("fields"), F.array(*map(F.lit, linked))).alias("p")).where(F.size("p") > 1).distinct()
        pairs = present.select(F.explode("p").alias("a"), "p").select("a", F.explode("p").alias("b")).where("a < b").distinct()
        together = {(r.a, r.b) for r in _few(pairs)}
    group = {p: [p] for p in uses}
    for r in sorted(links, key=lambda r: (-r.n, r.old, r.new)):
        a, b = group[r.old], group[r.new]
        if a is not b and not any((min(x, y), max(x, y)) in together for x in a for y in b):
            a += b
            for x in b:
                group[x] = a
    out = []
    for names in {id(g): g for g in group.values()}.values():
        ordered = sorted(names, key=lambda p: (-uses[p].files, p))
        total = {k: sum(uses[p][k] for p in names) for k in KINDS}
        kind = max(("boolean", "integer", "decimal", "string", "array", "object"), key=lambda k: total[k])  # the first of equals
        out.append(FieldClass(ordered[0], tuple(ordered), "decimal" if kind == "integer" and total["decimal"] > 0.5 * total["integer"] else kind))
    return sorted(out, key=lambda c: c.name)


def _typed(x: Column, kind: str) -> Column:
    """A variant as its column's type; null where it doesn't fit. An array of one value, or an object with a ``value``, is unwrapped for scalar types."""
    json = F.to_json(x)
    if kind in ("array", "object"):
        return F.when(json.startswith("[" if kind == "array" else "{"), json)
    at = lambda p: F.try_variant_get(x, p, "variant")
    inner = F.when(json.startswith("["), F.when(at("$[1]").isNull(), at("$[0]"))).when(json.startswith("{"), at("$.value")).otherwise(x)
    scalar = F.when(~F.to_json(inner).rlike(r"^[\[{]"), F.try_variant_get(inner, "$", "string"))
    if kind == "integer":
        return F.when(scalar.rlike(r"^-?\d{1,18}(\.0+)?$"), F.regexp_extract(scalar, r"^(-?\d+)", 1).cast("bigint"))
    if kind == "decimal":
        return F.when(scalar.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), scalar.try_cast("double"))
    if kind == "boolean":
        return F.when(scalar.isin("true", "1"), True).when(scalar.isin("false", "0"), False)
    # a decimal as text keeps its point, which variants drop
    return F.when(F.schema_of_variant(inner).rlike("^(DECIMAL|DOUBLE)"), F.try_variant_get(inner, "$", "double").cast("string")).otherwise(scalar)


def column_names(classes: list[FieldClass], taken: tuple[str, ...]) -> dict[str, str]:
    """A column for each field: dots become underscores; what would clash (also but for case) gets a number."""
    out, used = {}, {t.lower() for t in taken}
    for c in classes:
        name, n = c.name.replace(".", "_"), 2
        while (own := name if n == 2 else f"{name}_{n - 1}").lower() in used:
            n += 1
        out[c.name] = own
        used.add(own.lower())
    return out


def unified_table(lines: DataFrame, entity: str, layout: Layout = LAYOUT) -> DataFrame:
    """One consistent table: (file_id, dataset_id, record, a typed column for every field, rest), one row per record.

    Each field has its latest value that isn't null, from whichever file, under whichever of its names (see
    ``field_classes``); file_id is the record's latest file. A value that doesn't fit the type of its column is kept
    as JSON in the map ``rest`` under the column's name, if it is the latest one.
    """
    own = lines.where(F.col("entity") == entity)
    history = checkpoint(schema_history(own, layout))
    classes = field_classes(history)
    classes += [FieldClass(u, (u,), "object") for u in layout.unreported]
    names = column_names(classes, ("file_id", "dataset_id", "record", "rest"))
    held = own.where("file_id is not null and dataset_id is not null and exported_at is not null")
    parsed = held.select("file_id", "dataset_id", "entity", "exported_at", "line_no", F.try_parse_json("raw_json").alias("v")).withColumn("record", layout.record()).where("record is not null")

    def value(c: FieldClass) -> Column:
        # no file carries two names of a field; a null under one is no value
        each = [F.try_variant_get("v", "$" + "".join(f"['{p}']" for p in _steps(n, layout)), "variant") for n in c.names]
        return F.coalesce(*[F.when(F.to_json(x) != "null", x) for x in each])

    wide = parsed.select("file_id", "dataset_id", "exported_at", "line_no", "record", *[value(c).alias(f"x{i}") for i, c in enumerate(classes)])
    at = [F.col("exported_at").alias("e"), F.col("file_id").alias("f"), (-F.col("line_no")).alias("l")]
    cells = []
    for i, c in enumerate(classes):
        x = F.col(f"x{i}")
        t = _typed(x, c.kind)
        cells.append(F.when(x.isNotNull(), F.struct(*at, t.alias("t"), F.when(t.isNull(), F.to_json(x)).alias("r"))).alias(f"c{i}"))
    typed = wide.select("dataset_id", "record", F.struct(F.col("exported_at").alias("e"), F.col("file_id").alias("f")).alias("last"), *cells)
    folded = typed.groupBy("dataset_id", "record").agg(F.max("last").alias("last"), *[F.max(f"c{i}").alias(f"c{i}") for i in range(len(classes))])
    unfit = [F.when(F.col(f"c{i}.r").isNotNull(), F.struct(F.lit(names[c.name]).alias("key"), F.col(f"c{i}.r").alias("value"))) for i, c in enumerate(classes)]
    rest = F.map_from_entries(F.array_compact(F.array(*unfit))) if unfit else F.create_map().cast("map<string,string>")
    return folded.select(F.col("last.f").alias("file_id"), "dataset_id", "record", *[F.col(f"c{i}.t").alias(names[c.name]) for i, c in enumerate(classes)], rest.alias("rest"))


def _steps(path: str, layout: Layout) -> list[str]:
    """A dotted path as keys; a dot parts two keys only where an entered object ends."""
    out, start = [], 0
    for prefix in sorted((e for e in layout.entered if path.startswith(e + ".")), key=len):
        out.append(prefix[start:])
        start = len(prefix) + 1
    return [*out, path[start:]]
