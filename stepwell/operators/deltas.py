"""Differences to a source's previous value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(df: DataFrame, ids: list[str], order: list[str], value: str = "value", default: float | None = None) -> DataFrame:
    """``df`` with previous: the value before, of the same id (``default`` for the first)."""
    return df.withColumn("previous", F.lag(value, 1, default).over(Window.partitionBy(*ids).orderBy(*order)))


def monotonic_counter(df: DataFrame, ids: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Increments of a growing value; the previous value always advances, decreases count as 0 and the first has none."""
    rows = previous(df, ids, order, value)
    return rows.where("previous is not null").withColumn("delta", F.greatest(F.col(value) - F.col("previous"), F.lit(0))).drop("previous")


def reported(df: DataFrame, ids: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Cumulative values to differences, the first against 0."""
    return previous(df, ids, order, value, 0).withColumn("delta", F.col(value) - F.col("previous")).drop("previous")


def inflight(df: DataFrame, ids: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """For each call, how many of its id run as it starts (itself too)."""
    on = df.select("*", F.posexplode(F.array(F.struct(F.col(start).alias("__at"), F.lit(1).alias("__d")), F.struct(F.col(end).alias("__at"), F.lit(-1).alias("__d")))).alias("__p", "__e"))
    order = Window.partitionBy(*ids).orderBy("__e.__at", "__e.__d", "__p").rowsBetween(Window.unboundedPreceding, 0)
    return on.withColumn("inflight", F.sum("__e.__d").over(order)).where("__p = 0").drop("__p", "__e")


def overhead(part: Column, whole: Column, part_before: Column, whole_before: Column) -> Column:
    """Share of growth, 0 where the whole didn't grow."""
    grown = whole - whole_before
    return F.when(grown > 0, F.greatest((part - part_before) / grown, F.lit(0.0))).otherwise(0.0)
