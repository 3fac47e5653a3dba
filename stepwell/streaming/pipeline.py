"""Structured Streaming: steps, consolidation and subscriptions over a live stream of measurements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import evaluate, reducer
from ..operators.consolidate import kind_of
from ..operators.matching import matched
from ..plans import ast
from ..plans.compile import Series
from ..plans.parser import parse_data_expr


def right_closed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """``df`` with __ts, a millisecond before ``ts``, and a watermark on it: left-closed windows over it hold their end."""
    return df.withColumn("__ts", F.col(ts) - F.expr("interval 1 millisecond")).withWatermark("__ts", late)


def step_rates(updates: DataFrame, ids: list[str], step_seconds: int, late: str = "0 seconds", ts: str = "ts", amount: str = "amount") -> DataFrame:
    """Counter rates a step; rows stamped with its end."""
    v = F.col(amount).cast("double")
    rows = updates.where((v > 0) & ~F.isnan(v) & (v < float("inf"))).withWatermark(ts, late)
    got = rows.groupBy(F.window(ts, f"{step_seconds} seconds").alias("w"), *ids).agg((F.sum(v) / step_seconds).alias("value"))
    return got.select(*ids, F.col("w.end").alias(ts), "value")


def consolidated(points: DataFrame, ids: list[str], step: str, multiple: int, kind: str, late: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """Right-closed intervals: avg over ``multiple`` points, or max. Points older than the watermark are dropped."""
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    value = F.sum(v) / multiple if kind == "avg" else F.max(v)
    got = right_closed(points, ts, late).groupBy(F.window("__ts", step).alias("w"), *ids).agg(value.alias("value"))
    return got.select(*ids, "w", F.col("w.end").alias(ts), "value").where("value is not null")


def due(subscriptions: list[dict], step_ms: int, publish_step_ms: int | None = None) -> list[dict]:
    """Subscriptions to time series whose frequency is a multiple of the step (and isn't the publish step, if that is ignored)."""
    keep = []
    for s in subscriptions:
        f = s["frequency"]
        if (s.get("expr_type") or "TIME_SERIES") == "TIME_SERIES" and f >= step_ms and f % step_ms == 0 and f != publish_step_ms:
            keep.append(s)
    return keep


def problems(subscriptions: list[dict]) -> list[tuple[str, str]]:
    """(sub_id, message) of subscriptions that can't be evaluated."""
    out = []
    for s in subscriptions:
        try:
            expr = parse_data_expr(s["expression"])
        except ValueError as e:
            out.append((s["id"], str(e)))
            continue
        if expr.function == "all" or expr.grouping not in ("", "by"):
            out.append((s["id"], "only plain and grouped aggregates are evaluated"))
    return out


RESULT = "timestamp long, sub_id string, tags map<string,string>, value double"


def evaluated(points: DataFrame, subscriptions: list[dict], step_ms: int, series: Series = Series(), ts: str = "ts_ms", common: dict[str, str] | None = None, after: int | None = None, until: int | None = None) -> DataFrame:
    """timestamp, sub_id, tags and value of each subscription at each multiple of its frequency.

    Points (one a series and ``step_ms``) are first consolidated for each subscription and series to the subscription's
    frequency, in right-closed intervals: rates are averaged over all steps of the interval, of gauges the greatest counts.
    Then the series of a subscription are aggregated. ``common``: tags that all points have besides their own; queries
    and keys see them. ``after``, ``until``: only timestamps beyond the one and up to the other.
    Subscriptions among ``problems`` give nothing. One plan serves all subscriptions: points are matched once,
    then two aggregates by key follow.
    """
    common, bad = common or {}, {i for i, _ in problems(subscriptions)}
    parsed = {s["id"]: (parse_data_expr(s["expression"]), s["frequency"]) for s in subscriptions if s["id"] not in bad}
    if not parsed:
        return points.sparkSession.createDataFrame([], RESULT)
    rows = points.select(F.col(ts).cast("long").alias("ts_ms"), series.all_tags().alias("tags"), series.amount().alias("value"))
    known = Series({}, "tags")
    hits = matched(rows, {k: ast.normalise(e.query.simplify(common)) for k, (e, _) in parsed.items()}, known, "sub_id")
    exact = {k: e.exact() or ({} if e.grouping else {"name": "unknown"}) for k, (e, _) in parsed.items()}
    table = [(k, f, max(1, f // step_ms), e.function, list(e.keys), exact[k]) for k, (e, f) in parsed.items()]
    subs = points.sparkSession.createDataFrame(table, "sub_id string, frequency long, multiple int, function string, keys array<string>, exact map<string,string>")
    subs = F.broadcast(subs) if len(table) <= 100_000 else subs
    hits = hits.join(subs, "sub_id").withColumn("timestamp", (F.floor((F.col("ts_ms") + F.col("frequency") - 1) / F.col("frequency")) * F.col("frequency")).cast("long"))
    hits = hits.where((F.lit(True) if after is None else F.col("timestamp") > after) & (F.lit(True) if until is None else F.col("timestamp") <= until))
    v = F.nanvl("value", F.lit(None).cast("double"))
    kind = F.when(F.col("multiple") == 1, "none").otherwise(kind_of(F.col("tags")["statistic"], 2))
    series_key = ["sub_id", "timestamp", F.array_sort(F.map_entries("tags")).alias("id")]
    own = hits.groupBy(*series_key, kind.alias("kind")).agg((F.sum(v) / F.first("multiple")).alias("a"), F.max(v).alias("m"), F.max_by(v, F.struct("ts_ms", v)).alias("l"))
    own = own.select("sub_id", "timestamp", F.map_from_entries("id").alias("tags"), F.when(F.col("kind") == "avg", F.col("a")).when(F.col("kind") == "max", F.col("m")).otherwise(F.col("l")).alias("value"))
    own = own.where("value is not null").join(subs, "sub_id")
    shared = F.create_map(*[F.lit(x) for kv in sorted(common.items()) for x in kv]).cast("map<string,string>") if common else F.lit(None).cast("map<string,string>")
    values = F.transform("keys", lambda k: F.coalesce(F.try_element_at(F.col("tags"), k), F.try_element_at(shared, k)))
    own = own.withColumn("by", values).where(F.forall("by", lambda x: x.isNotNull()))
    got = own.groupBy("sub_id", "timestamp", "by").agg(F.first("function").alias("function"), *[reducer(f, F.col("value")).alias(f) for f in ("sum", "min", "max", "count")])
    value = F.when(F.col("function") == "sum", F.col("sum")).when(F.col("function") == "min", F.col("min")).when(F.col("function") == "max", F.col("max")).otherwise(F.col("count"))
    got = got.select("sub_id", "timestamp", "by", value.alias("value")).where("value is not null").join(subs, "sub_id")
    left = F.filter(F.arrays_zip(F.col("keys").alias("k"), F.col("by").alias("v")), lambda e: ~F.map_contains_key(F.col("exact"), e["k"]))
    return got.select("timestamp", "sub_id", F.map_concat("exact", F.map_from_entries(left)).alias("tags"), "value")


def delayed(points: DataFrame, expression: str, id_text: Column, is_gauge: Column, series: Series = Series(), aggr_key: str = "aggr", ts: str = "ts_ms") -> DataFrame:
    """Sums and counts whose gauge inputs are kept apart: one row each, with the hash of the id as a tag,
    to be added up later."""
    from ..operators.sketches import hash64

    expr = parse_data_expr(expression)
    if expr.function not in ("sum", "count"):
        return evaluate(points, expr, series, (ts,))
    mark = F.when(is_gauge, F.lower(F.hex(hash64(id_text))))
    got = evaluate(points.withColumn("__aggr", mark), expr, series, (ts, "__aggr"))
    return got.select(ts, F.when(F.col("__aggr").isNull(), F.col("tags")).otherwise(F.map_concat("tags", F.create_map(F.lit(aggr_key), F.coalesce("__aggr", F.lit(""))))).alias("tags"), "value")


def run_subscriptions(stream: DataFrame, subscriptions: Callable[[], list[dict]], sink: Callable[[DataFrame, int], None], checkpoint: str, step_ms: int = 5000, late_ms: int = 0, common: dict[str, str] | None = None):
    """A query that evaluates the subscriptions, read again for each batch, and hands results to ``sink``.

    A timestamp is evaluated once a point later than it by more than ``late_ms`` has come, so one that is split over batches
    gives one result. Points of intervals that are still open wait in tables beside the checkpoint, one
    for each batch, which a repeated batch writes anew; points of intervals that were evaluated are dropped. What
    is still open when the stream stops is evaluated by ``flush``.
    """

    def batch(df: DataFrame, number: int) -> None:
        subs = due(subscriptions(), step_ms)
        waiting, through = _state(df.sparkSession, checkpoint, number - 1)
        rows = df if waiting is None else waiting.unionByName(df)
        top = rows.agg(F.max("ts_ms")).first()[0]
        now = through if top is None else max(int(top) - late_ms - 1, -(2**62) if through is None else through)
        longest = max((s["frequency"] for s in subs), default=step_ms)
        open_ = rows if now is None else rows.where(F.col("ts_ms") > now - longest)
        open_.write.mode("overwrite").parquet(f"{checkpoint}-open/{number}")
        df.sparkSession.createDataFrame([(now,)], "through long").write.mode("overwrite").parquet(f"{checkpoint}-through/{number}")
        if now is not None:
            sink(evaluated(rows, subs, step_ms, common=common, after=through, until=now), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state(spark: SparkSession, checkpoint: str, number: int) -> tuple[DataFrame | None, int | None]:
    """Points that wait after a batch, and the last timestamp evaluated."""
    if number < 0:
        return None, None
    return spark.read.parquet(f"{checkpoint}-open/{number}"), spark.read.parquet(f"{checkpoint}-through/{number}").first()[0]


def flush(spark: SparkSession, subscriptions: list[dict], sink: Callable[[DataFrame, int], None], checkpoint: str, number: int, step_ms: int = 5000, common: dict[str, str] | None = None) -> None:
    """Evaluates all that waits after batch ``number``, as when a stream has stopped for good."""
    waiting, through = _state(spark, checkpoint, number)
    if waiting is not None:
        sink(evaluated(waiting, due(subscriptions, step_ms), step_ms, common=common, after=through), number + 1)


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One sink that writes to all."""

    def write(df: DataFrame, number: int) -> None:
        for s in sinks:
            s(df, number)

    return write
