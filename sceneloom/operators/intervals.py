"""Continuous periods and gaps of overlapping intervals (problem 4).

Starts and ends are ranked independently per entity. With n intervals, a gap
lies after the i-th smallest end exactly where the (i+1)-th smallest start is
later; the boundaries left over, paired in order, are the periods. Equal times
are counted before they are ranked, and ranks are computed in blocks of the
time axis, so no entity has to fit into one task.

Defined results: an interval without entity, start or end, or with end <= start,
counts as none; repeated intervals count once in effect; touching intervals
(and those at most ``tolerance`` apart) form one period; an empty input gives
empty results. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .blocked import blocked_cumsum, blocked_last

#: Width of a block of the time axis, in the unit of the times (milliseconds here): ten minutes.
BLOCK = 600_000


def millis(seconds: str | Column) -> Column:
    """Seconds as whole milliseconds; null for null, NaN and infinite values."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(1e14)), F.round(c * 1000).cast("long"))


def intervals(df: DataFrame, entity: Column, start_ms: Column, end_ms: Column, *extra: Column) -> DataFrame:
    """The valid intervals as (entity, start_ms, end_ms, *extra)."""
    return df.select(entity.alias("entity"), start_ms.alias("start_ms"), end_ms.alias("end_ms"), *extra).where("entity is not null and end_ms > start_ms")


def _block(column: str, width: int) -> Column:
    return F.floor(F.col(column) / width)


def interval_gaps(iv: DataFrame, tolerance: int = 0, block: int = BLOCK) -> DataFrame:
    """(entity, gap_start, gap_end): stretches longer than ``tolerance`` that no interval covers, between two intervals."""
    bounds = (
        iv.select("entity", F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("start_ms").alias("t")), F.struct(F.lit("e").alias("kind"), F.col("end_ms").alias("t")))).alias("b"))
        .groupBy("entity", F.col("b.kind").alias("kind"), F.col("b.t").alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = blocked_cumsum(bounds, ["entity", "kind"], "t", "n", "rank", _block("t", block))
    ends = ranked.where("kind = 'e'").select("entity", "rank", F.col("t").alias("gap_start"))
    starts = ranked.where("kind = 's'").select("entity", (F.col("rank") - F.col("n")).alias("rank"), F.col("t").alias("gap_end"))
    return ends.join(starts, ["entity", "rank"]).where(F.col("gap_end") > F.col("gap_start") + F.lit(tolerance)).select("entity", "gap_start", "gap_end")


def interval_periods(iv: DataFrame, tolerance: int = 0, block: int = BLOCK) -> DataFrame:
    """(entity, period_start, period_end): the continuous periods."""
    gaps = checkpoint(interval_gaps(iv, tolerance, block))  # few rows that four branches of the plan read
    whole = iv.groupBy("entity").agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last"))

    def ordinal(df: DataFrame, name: str) -> DataFrame:
        return blocked_cumsum(df.withColumn("n", F.lit(1)), ["entity"], name, "n", "ordinal", _block(name, block)).drop("n")

    starts = ordinal(whole.select("entity", F.col("first").alias("period_start")).unionByName(gaps.select("entity", F.col("gap_end").alias("period_start"))), "period_start")
    ends = ordinal(gaps.select("entity", F.col("gap_start").alias("period_end")).unionByName(whole.select("entity", F.col("last").alias("period_end"))), "period_end")
    return starts.join(ends, ["entity", "ordinal"]).select("entity", "period_start", "period_end")


def assign_periods(iv: DataFrame, periods: DataFrame, block: int = BLOCK) -> DataFrame:
    """The intervals with the period each lies in: (entity, period_start, period_end) and the columns of ``iv``."""
    rest = [c for c in iv.columns if c not in ("entity", "start_ms")]
    marks = periods.select("entity", F.col("period_start").alias("start_ms"), F.lit(0).alias("__row"), F.struct("period_start", "period_end").alias("__period"))
    rows = iv.withColumns({"__row": F.lit(1), "__period": F.lit(None).cast("struct<period_start:bigint,period_end:bigint>")})
    filled = blocked_last(marks.unionByName(rows, allowMissingColumns=True), ["entity"], ["start_ms", "__row"], "__period", "__in", _block("start_ms", block))
    return filled.where("__row = 1").select("entity", F.col("__in.period_start").alias("period_start"), F.col("__in.period_end").alias("period_end"), "start_ms", *rest)


def period_members(iv: DataFrame, member: str, tolerance: int = 0, block: int = BLOCK) -> DataFrame:
    """The periods with the number of intervals and whether at least two different members make them up."""
    placed = assign_periods(iv, checkpoint(interval_periods(iv, tolerance, block)), block)
    return placed.groupBy("entity", "period_start", "period_end").agg(
        F.count(F.lit(1)).alias("intervals"), (F.min(member) < F.max(member)).alias("several_members")
    )
