"""Running computations over an ordered key without one task per key.

A plain window puts all rows of a key into one task. Here the order axis is cut
into blocks; each (key, block) is scanned alone, one summary row per block is
carried over the blocks, and both are added up. A key that holds a third of all
rows is thereby spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"


def blocked_cumsum(df: DataFrame, keys: list[str], order: str | list[str], weight: str, out: str, block: Column) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` up to and with the row, in ``order`` within ``keys``.

    ``block`` must not decrease along ``order``; ties of ``order`` must have been aggregated. Keys must not be null.
    """
    cut = df.withColumn(_BLOCK, block)
    by = [*keys, _BLOCK]
    offsets = (
        cut.groupBy(*by)
        .agg(F.sum(weight).alias("__w"))
        .withColumn("__before", F.sum("__w").over(Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)))
        .drop("__w")
    )
    within = cut.withColumn("__own", F.sum(weight).over(Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, 0)))
    return within.join(offsets, by).withColumn(out, F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__own", "__before", _BLOCK)


def blocked_last(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, block: Column, inclusive: bool = True) -> DataFrame:
    """Adds ``out``: the last value that isn't null at (or, if not ``inclusive``, before) the row within ``keys``.

    ``block`` must not decrease along ``order``, and ``order`` should be total. Keys must not be null.
    """
    cut = df.withColumn(_BLOCK, block)
    by = [*keys, _BLOCK]
    tagged = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    carry = (
        cut.groupBy(*by)
        .agg(F.max(F.when(F.col(value).isNotNull(), tagged)).alias("__last"))
        .withColumn("__carry", F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)))
        .drop("__last")
    )
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = cut.withColumn("__own", F.last(value, ignorenulls=True).over(frame))
    return within.join(carry, by).withColumn(out, F.coalesce("__own", F.col("__carry.v"))).drop("__own", "__carry", _BLOCK)
