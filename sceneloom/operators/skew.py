"""Joins whose left side may hold a third of all rows under one key.

Hot keys are told by a sample of the left side, which decides only how rows travel, never what comes out: rows
of a hot key are spread over ``salts`` parts, and the right side's rows of that key are sent to each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it is split, parts it is split into, share of the rows that tells hot keys.
HOT_ROWS, SALTS, SHARE = 2_000_000, 64, 0.01


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, share: float = SHARE) -> DataFrame | None:
    """The keys of about ``hot_rows`` rows or more (there are at most rows / hot_rows), or None."""
    part = df.select(*keys).sample(share, seed=11) if share < 1 else df.select(*keys)
    hot = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= max(1, hot_rows * share)).drop("__n")
    return None if hot.isEmpty() else hot


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS, share: float = SHARE) -> DataFrame:
    """``left.join(right, keys, how)``, how being inner, left, left_semi or left_anti; ``left`` should be a table, as it is read twice.

    Keys must not be null. The columns come out as those of the plain join.
    """
    hot = hot_keys(left, keys, hot_rows, share)
    if hot is None:
        return left.join(right, keys, how)
    marked = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    spread = left.join(marked, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salts))).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copied = right.join(marked, keys, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return spread.withColumn("__salt", F.col("__salt").cast("long")).join(copied, [*keys, "__salt"], how).drop("__salt")
