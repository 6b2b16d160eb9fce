"""Visually identical text with different characters (problem 2).

Texts are brought to one form by SQL that an in-process DuckDB runs over the Arrow
batches of each partition: ``translate`` for characters that stand for one other
character, a lookup per character for ligatures and other forms of several, a
regular expression for invisible characters, ``nfc_normalize`` for accents. A
regular expression first sorts out the texts that hold none of these characters,
which need composition only. Texts are then compared by their forms.

Defined results: a null text has a null form; the form of an empty or invisible
text is '' and such texts match nothing; spaces are neither trimmed nor collapsed,
case, digits and punctuation are kept; repeated rows count once; other columns
pass through unchanged (a column named as the result is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, join_salted
from ..runtime import checkpoint
from .charmap import LOOKALIKES, table


def char_class(chars: list[str]) -> str:
    """A character class of a regular expression, as ranges of code points."""
    codes, out = sorted(map(ord, chars)), []
    for cp in codes:
        if out and out[-1][1] == cp - 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@cache
def form_sql(column: str = "text") -> str:
    """The SQL expression for the form of ``column``."""
    t = table()
    gone = [c for c, to in t.items() if not to]
    single = {c: to for c, to in t.items() if len(to) == 1}
    # the frequent kinds are kept apart, as translate() builds its table anew for every text
    usual = {c: to for c, to in single.items() if c in LOOKALIKES or to == " " or 0xFF00 <= ord(c) <= 0xFF5E}
    rare = {c: to for c, to in single.items() if c not in usual}
    several = {c: to for c, to in t.items() if len(to) > 1}

    def swap(expression: str, chars: dict[str, str]) -> str:
        return f"CASE WHEN regexp_matches({expression}, {_quoted(char_class(list(chars)))}) THEN translate({expression}, {_quoted(''.join(chars))}, {_quoted(''.join(chars.values()))}) ELSE {expression} END"

    lookup = f"MAP([{', '.join(map(_quoted, several))}], [{', '.join(map(_quoted, several.values()))}])"
    return f"""CASE WHEN NOT regexp_matches({column}, {_quoted(char_class(list(t)))}) THEN nfc_normalize({column})
ELSE (SELECT nfc_normalize(c) FROM (
  SELECT regexp_replace(b, {_quoted(char_class(gone))}, '', 'g') AS c FROM (
    SELECT {swap("a", usual)} AS b FROM (
      SELECT {swap("l", rare)} AS a FROM (
        SELECT CASE WHEN regexp_matches({column}, {_quoted(char_class(list(several)))})
          THEN array_to_string(list_transform(string_split({column}, ''), lambda x: coalesce({lookup}[x], x)), '') ELSE {column} END AS l))))) END"""


def with_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """The columns of ``df`` and ``out``, the one form of the texts in ``column``."""
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]
    sql = f"SELECT {form_sql('text')} AS form FROM piece ORDER BY place"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pa.table({"text": batch.column(names.index(column)).cast(pa.string()), "place": pa.array(range(batch.num_rows), pa.int64())})
            con.register("piece", texts)
            form = con.sql(sql).to_arrow_table().column(0).combine_chunks()
            con.unregister("piece")
            form = form.chunk(0) if isinstance(form, pa.ChunkedArray) else form
            yield pa.RecordBatch.from_arrays([*batch.columns, form.cast(pa.string())], names=[*names, out])
        con.close()

    schema = df.select(*[f"`{n}`" for n in names]).schema.add(out, "string")
    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


#: Different forms of the left side up to which they are broadcast (16 bytes each).
FEW_FORMS = 500_000


def same_look(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(left_key, right_key): the pairs of which some texts look the same but are not the same characters.

    Only hashes of the texts (128 bits of each form, 64 of the text) are moved. Rows of the right side that share no
    form with the left are dropped by a semi-join, before they are made distinct or moved, if the left's forms are
    few enough to be broadcast; pairs are made of the rows that are left, and a form that very many of them carry is
    split (see ``skew``).
    """

    def hashed(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
        return with_form(rows, "t", "f").where("f <> ''").select("k", F.xxhash64("f").alias("f1"), F.xxhash64(F.lit(1), "f").alias("f2"), F.xxhash64("t").alias("h"))

    a = checkpoint(hashed(left, left_key).distinct())
    forms = a.select("f1", "f2").distinct()
    if forms.count() <= FEW_FORMS:
        forms = F.broadcast(forms)
    b = checkpoint(hashed(right, right_key).join(forms, ["f1", "f2"], "left_semi").distinct())
    met = join_salted(b.select(F.col("k").alias("__right"), "f1", "f2", F.col("h").alias("h2")), a.withColumnRenamed("k", left_key), ["f1", "f2"], hot_rows=hot_rows)
    return met.where("h <> h2").select(left_key, F.col("__right").alias(right_key)).distinct()
