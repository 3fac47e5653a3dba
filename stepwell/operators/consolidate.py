"""Consolidation of a short step to a longer one.

A consolidated interval is closed on the right: a time is rounded up to the step, so a value stamped with
the interval's end belongs to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .meters import SUMMED


def interval_end(ts: Column, step_ms: int) -> Column:
    return (F.floor((ts + (step_ms - 1)) / step_ms) * step_ms).cast("long")


def kind_of(statistic: Column, multiple: int) -> Column:
    """none, avg (counter-like) or max (gauges, and where the statistic isn't known)."""
    return F.lit("none") if multiple == 1 else F.when(F.coalesce(statistic.isin(*SUMMED), F.lit(False)), "avg").otherwise("max")


def consolidate(df: DataFrame, ids: list[str], step_ms: int, multiple: int, kind: str | Column, ts: str = "ts_ms", value: str = "value") -> DataFrame:
    """ids, ts_ms and value of each interval of ``multiple`` steps.

    avg divides by ``multiple``, so missing points count as 0; max and avg skip NaN, and an interval with
    NaN only gives no row; none keeps the last point of a step.
    """
    long = step_ms * multiple
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rows = df.select(*ids, F.col(ts).alias("__t"), v.alias("__v"), interval_end(F.col(ts), long).alias("ts_ms"), kind.alias("__kind"))
    got = rows.groupBy(*ids, "ts_ms", "__kind").agg((F.sum("__v") / multiple).alias("a"), F.max("__v").alias("m"), F.max_by("__v", F.struct("__t", "__v")).alias("l"))
    out = F.when(F.col("__kind") == "avg", F.col("a")).when(F.col("__kind") == "max", F.col("m")).otherwise(F.col("l"))
    return got.select(*ids, "ts_ms", out.alias("value")).where("value is not null")


def in_order(df: DataFrame, ids: list[str], arrival: list[str], step_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Rows that aren't late: whose interval isn't before one that the id has reached already, in order of arrival."""
    end = interval_end(F.col(ts), step_ms)
    seen = F.max(end).over(Window.partitionBy(*ids).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__seen", seen).where(end >= F.col("__seen")).drop("__seen")


def strictly_newer(df: DataFrame, ids: list[str], arrival: list[str], ts: str = "ts_ms") -> DataFrame:
    """Rows later than all that came before them."""
    before = F.max(ts).over(Window.partitionBy(*ids).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__seen", before).where(F.col("__seen").isNull() | (F.col(ts) > F.col("__seen"))).drop("__seen")
