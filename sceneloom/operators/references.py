"""References to records that do not exist, and what hangs on them (problem 5).

A reference is ``missing`` (no record has the key), ``late`` (the record came
after the referring one) or ``deleted`` (it had been withdrawn by then). The
cascade then walks the graph of foreign keys to a fixpoint: a record that refers
to an orphaned record is an orphan by inheritance.

Defined results: ids are compared trimmed and in upper case; null and empty ids
are no references and no keys; a record arrived at the earliest ``loaded_at`` of
its rows and was withdrawn at the earliest ``deleted_at``; where the arrival of
the referring record is unknown, only ``missing`` can be told and its month is
null; repeated rows and repeated references count once; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .skew import HOT_ROWS, join_salted


@dataclass(frozen=True)
class Record:
    """A table of records: its key column, when rows arrived and were withdrawn."""

    name: str
    df: DataFrame
    key: str
    loaded_at: str | None = "loaded_at"
    deleted_at: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """``refs`` is an array column of ``child`` (or an expression giving one) that names keys of ``parent``."""

    child: str
    refs: Column
    parent: str


def tidy(c: Column) -> Column:
    """An id as it is compared: trimmed of any white space, upper case; null if nothing is left."""
    t = F.upper(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(t != "", t)


def arrivals(record: Record) -> DataFrame:
    """(key, raw_key, arrived, deleted): one row per record."""
    never = F.lit(None).cast("timestamp_ntz")
    return (
        record.df.select(
            tidy(F.col(record.key)).alias("key"),
            F.col(record.key).alias("raw_key"),
            (F.col(record.loaded_at) if record.loaded_at else never).alias("loaded"),
            (F.col(record.deleted_at) if record.deleted_at else never).alias("deleted"),
        )
        .where("key is not null")
        .groupBy("key")
        .agg(F.min("raw_key").alias("raw_key"), F.min("loaded").alias("arrived"), F.min("deleted").alias("deleted"))
    )


def references(record: Record, fk: ForeignKey) -> DataFrame:
    """(child_key, parent_key): the distinct references of one foreign key."""
    return (
        record.df.select(tidy(F.col(record.key)).alias("child_key"), F.explode(fk.refs).alias("ref"))
        .select("child_key", tidy(F.col("ref")).alias("parent_key"))
        .where("child_key is not null and parent_key is not null")
        .distinct()
    )


_EDGE = ["parent_table", "parent_key"]


def _record_keys(df: DataFrame, table: str, key: str) -> DataFrame:
    return df.select(F.col("table").alias(table), F.col("key").alias(key))


def orphan_cascade(records: list[Record], keys: list[ForeignKey], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(ref_table, ref_key, parent_table, missing_key, case_kind, load_month, child_key, depth): every orphan reference.

    Depth 0 are the references that fail themselves (``missing``, ``late``, ``deleted``); their records are direct
    orphans. A reference to a record that is an orphan of depth d, and doesn't fail itself, is ``inherited`` with
    depth d + 1. Each round semi-joins the references with the orphans that the round before has found first, and
    the loop ends at the fixpoint, when a round finds none; there is no limit of rounds. Rounds are written to the
    shared folder. Parents that very many records refer to are split (see ``skew``).
    """
    by_name = {r.name: r for r in records}
    came = checkpoint(reduce(DataFrame.unionByName, [arrivals(r).withColumn("table", F.lit(r.name)) for r in records]))
    edges = checkpoint(
        reduce(DataFrame.unionByName, [references(by_name[fk.child], fk).select(F.lit(fk.child).alias("child_table"), "child_key", F.lit(fk.parent).alias("parent_table"), "parent_key") for fk in keys])
    )
    parent = came.select(F.col("table").alias("parent_table"), F.col("key").alias("parent_key"), "arrived", "deleted", F.lit(True).alias("there"))
    child = came.select(F.col("table").alias("child_table"), F.col("key").alias("child_key"), F.col("raw_key").alias("ref_key"), F.col("arrived").alias("t"))
    kind = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("arrived") > F.col("t"), "late")
        .when((F.col("arrived") <= F.col("t")) & (F.col("deleted") <= F.col("t")), "deleted")
    )
    known_parents = join_salted(edges, parent, _EDGE, "left", hot_rows)
    direct = known_parents.join(child, ["child_table", "child_key"]).withColumn("case_kind", kind).where("case_kind is not null")
    shape = [F.col("child_table").alias("ref_table"), "ref_key", "parent_table", F.col("parent_key").alias("missing_key"), "case_kind", F.date_format("t", "yyyy-MM").alias("load_month"), "child_key"]
    found = checkpoint(direct.select(*shape, F.lit(0).alias("depth")))
    failing = found.select(F.col("ref_table").alias("child_table"), "child_key", "parent_table", F.col("missing_key").alias("parent_key"))
    orphans = frontier = checkpoint(found.select(F.col("ref_table").alias("table"), F.col("child_key").alias("key")).distinct())
    levels, depth = [found], 0
    while not frontier.isEmpty():
        depth += 1
        # a record becomes an orphan once, so each reference is reached once
        met = join_salted(edges, _record_keys(frontier, *_EDGE), _EDGE, "left_semi", hot_rows)
        inherited = met.join(failing, ["child_table", "child_key", *_EDGE], "left_anti").join(child, ["child_table", "child_key"])
        level = checkpoint(inherited.withColumn("case_kind", F.lit("inherited")).select(*shape, F.lit(depth).alias("depth")))
        levels.append(level)
        frontier = checkpoint(level.select(F.col("ref_table").alias("table"), F.col("child_key").alias("key")).distinct().join(orphans, ["table", "key"], "left_anti"))
        orphans = orphans.unionByName(frontier)
        if depth % 16 == 0:
            orphans, levels = checkpoint(orphans), [checkpoint(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def orphan_records(cascade: DataFrame) -> DataFrame:
    """(table, key, depth): the records behind the references of a cascade, each with its least depth."""
    return cascade.groupBy(F.col("ref_table").alias("table"), F.col("child_key").alias("key")).agg(F.min("depth").alias("depth"))
