"""Meters: raw updates to measurements for each step.

An update is a row with id columns, a time in ms and an amount. A step holds the times from its start up to,
not including, its end, and measurements are stamped with the end (rates over the step just finished).
Every meter is one groupBy, whose partial aggregates do what client-side batching does elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statistics whose values are sums over time; others are levels.
SUMMED = ("count", "totalAmount", "totalTime", "totalOfSquares", "percentile")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def stepped(df: DataFrame, ts: str, step_ms: int) -> DataFrame:
    """``df`` with ts_ms, the end of the step a row belongs to."""
    return df.withColumn("__end", (F.floor(F.col(ts) / step_ms) + 1) * step_ms)


def _out(df: DataFrame, ids: list[str], *cols: Column) -> DataFrame:
    return df.select(*ids, F.col("__end").cast("long").alias("ts_ms"), *cols)


def counter(df: DataFrame, ids: list[str], step_ms: int, ts: str = "ts_ms", amount: str = "amount") -> DataFrame:
    """Rate a second of finite amounts above 0."""
    v = F.col(amount).cast("double")
    got = stepped(df.where(finite(v) & (v > 0)), ts, step_ms).groupBy(*ids, "__end").agg(F.sum(v).alias("s"))
    return _out(got, ids, (F.col("s") / (step_ms / 1000.0)).alias("value"))


def _totals(df: DataFrame, ids: list[str], step_ms: int, ts: str, amount: str, unit: float, total: str) -> DataFrame:
    """count, total, totalOfSquares and max as rows with their statistic; every record counts, amounts above 0 add."""
    v = F.col(amount).cast("double")
    up = F.when(v > 0, v)
    got = stepped(df.where(v.isNotNull()), ts, step_ms).groupBy(*ids, "__end").agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum(up), F.lit(0.0)).alias("t"), F.coalesce(F.sum(up * up), F.lit(0.0)).alias("q"), F.coalesce(F.max(up), F.lit(0.0)).alias("m"))
    s = step_ms / 1000.0
    rows = F.array(*[F.struct(F.lit(name).alias("statistic"), c.alias("value")) for name, c in (("count", F.col("n") / s), (total, F.col("t") * unit / s), ("totalOfSquares", F.col("q") * unit * unit / s), ("max", F.col("m") * unit))])
    return _out(got.withColumn("__s", F.explode(rows)), ids, F.col("__s.statistic"), F.col("__s.value"))


def timer(df: DataFrame, ids: list[str], step_ms: int, ts: str = "ts_ms", amount: str = "amount") -> DataFrame:
    """Amounts in nanoseconds; results in seconds."""
    return _totals(df, ids, step_ms, ts, amount, 1e-9, "totalTime")


def distribution_summary(df: DataFrame, ids: list[str], step_ms: int, ts: str = "ts_ms", amount: str = "amount") -> DataFrame:
    return _totals(df, ids, step_ms, ts, amount, 1.0, "totalAmount")


def gauge(df: DataFrame, ids: list[str], step_ms: int, ts: str = "ts_ms", amount: str = "amount", tie: str | None = None) -> DataFrame:
    """The last value set in a step (ties: larger ``tie``, else larger value), if finite."""
    v = F.col(amount).cast("double")
    order = F.struct(ts, tie or v.alias("v"))
    got = stepped(df, ts, step_ms).groupBy(*ids, "__end").agg(F.max_by(v, order).alias("value")).where(finite(F.col("value")))
    return _out(got, ids, F.col("value"))


def max_gauge(df: DataFrame, ids: list[str], step_ms: int, ts: str = "ts_ms", amount: str = "amount") -> DataFrame:
    v = F.col(amount).cast("double")
    return _out(stepped(df.where(finite(v)), ts, step_ms).groupBy(*ids, "__end").agg(F.max(v).alias("value")), ids, F.col("value"))


def carried(measured: DataFrame, ids: list[str], step_ms: int, ttl_ms: int = 900_000) -> DataFrame:
    """A gauge's rows with gaps filled by its last value, for ``ttl_ms`` after it."""
    after = F.lead("ts_ms").over(Window.partitionBy(*ids).orderBy("ts_ms"))
    until = F.least(F.coalesce(after - step_ms, F.col("ts_ms") + ttl_ms), F.col("ts_ms") + ttl_ms)
    rows = measured.withColumn("__to", F.greatest(until, F.col("ts_ms")))
    return rows.withColumn("ts_ms", F.explode(F.sequence(F.col("ts_ms"), F.col("__to"), F.lit(step_ms).cast("long")))).drop("__to")


def densified(measured: DataFrame, ids: list[str], step_ms: int) -> DataFrame:
    """A counter's rows with rate 0 in steps without updates between its first and last."""
    after = F.lead("ts_ms").over(Window.partitionBy(*ids).orderBy("ts_ms"))
    rows = measured.withColumn("__to", F.coalesce(after - step_ms, F.col("ts_ms"))).withColumn("__t", F.explode(F.sequence(F.col("ts_ms"), F.col("__to"), F.lit(step_ms).cast("long"))))
    return rows.withColumn("value", F.when(F.col("__t") == F.col("ts_ms"), F.col("value")).otherwise(0.0)).withColumn("ts_ms", F.col("__t")).drop("__t", "__to")


def cumulative(df: DataFrame, ids: list[str], kind: str, ts: str = "ts_ms", amount: str = "amount") -> DataFrame:
    """Meters without steps: all updates so far. Timers and summaries skip negative amounts."""
    v = F.col(amount).cast("double")
    if kind == "counter":
        return df.where(finite(v) & (v > 0)).groupBy(*ids).agg(F.sum(v).alias("value"))
    if kind in ("timer", "summary"):
        return df.where(v >= 0).groupBy(*ids).agg(F.count(F.lit(1)).alias("count"), F.sum(v).alias("total"))
    if kind == "gauge":
        return df.groupBy(*ids).agg(F.max_by(v, F.struct(ts, v.alias("v"))).alias("value"))
    if kind == "max_gauge":
        return df.where(finite(v)).groupBy(*ids).agg(F.max(v).alias("value"))
    raise ValueError(kind)


def deltas(df: DataFrame, ids: list[str], kind: str, amount: str = "amount") -> DataFrame:
    """What a stateless registry sends for one batch of updates: op (add or max), statistic and value; nothing for count 0."""
    v = F.col(amount).cast("double")
    if kind == "counter":
        return df.where(finite(v) & (v > 0)).groupBy(*ids).agg(F.sum(v).alias("value")).select(*ids, F.lit("count").alias("statistic"), F.lit("add").alias("op"), "value")
    unit, total = (1e-9, "totalTime") if kind == "timer" else (1.0, "totalAmount")
    got = df.where(v >= 0).groupBy(*ids).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("t"), F.sum(v * v).alias("q"), F.max(v).alias("m"))
    rows = F.array(*[F.struct(F.lit(s).alias("statistic"), F.lit(o).alias("op"), c.alias("value")) for s, o, c in (("count", "add", F.col("n")), (total, "add", F.col("t") * unit), ("totalOfSquares", "add", F.col("q") * unit * unit), ("max", "max", F.col("m") * unit))])
    return got.select(*ids, F.explode(rows).alias("s")).select(*ids, "s.statistic", "s.op", "s.value")


def double_summary(df: DataFrame, ids: list[str], reset_ms: int = 60_000, ts: str = "ts_ms", amount: str = "amount") -> DataFrame:
    """Summaries of doubles: totals of each reset interval over its length in seconds, and the maximum."""
    return _totals(df, ids, reset_ms, ts, amount, 1.0, "totalAmount")


def long_tasks(tasks: DataFrame, ids: list[str], now_ns: int, start: str = "start_ns", stop: str = "stop_ns") -> DataFrame:
    """Tasks without a stop: activeTasks and their duration in seconds."""
    got = tasks.where(F.col(stop).isNull()).groupBy(*ids).agg(F.count(F.lit(1)).cast("double").alias("activeTasks"), (F.sum(F.lit(now_ns) - F.col(start)) / 1e9).alias("duration"))
    return got.select(*ids, F.expr("stack(2, 'activeTasks', activeTasks, 'duration', duration) as (statistic, value)"))


def interval_counter(df: DataFrame, ids: list[str], now_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Updates so far, and seconds since the last."""
    return df.groupBy(*ids).agg(F.count(F.lit(1)).alias("count"), ((F.lit(now_ms) - F.max(ts)) / 1000.0).alias("seconds_since"))


def alive(df: DataFrame, ids: list[str], now_ms: int, ttl_ms: int = 900_000, ts: str = "ts_ms") -> DataFrame:
    """Rows of meters updated within ``ttl_ms``: the last updates are aggregated first, then rows are kept by their id."""
    last = df.groupBy(*[F.col(i).alias(f"__{n}") for n, i in enumerate(ids)]).agg(F.max(ts).alias("__last")).where(F.lit(now_ms) - F.col("__last") <= ttl_ms)
    same = [F.col(i).eqNullSafe(F.col(f"__{n}")) for n, i in enumerate(ids)]
    return df.join(last, same, "left_semi")


def polled(df: DataFrame, ids: list[str], value: str = "value") -> DataFrame:
    """Sources registered under one id: the sum of their values that aren't NaN."""
    return df.groupBy(*ids).agg(F.sum(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias("value")).where("value is not null")


def exploded(df: DataFrame, amounts: str, amount: str = "amount") -> DataFrame:
    """Array records to one row for each amount."""
    return df.withColumn(amount, F.explode(amounts))


def conflicts(df: DataFrame, ids: list[str], kind: str = "meter_type") -> DataFrame:
    """Ids used with several meter types."""
    return df.groupBy(*ids).agg(F.array_sort(F.collect_set(kind)).alias("types")).where(F.size("types") > 1)
