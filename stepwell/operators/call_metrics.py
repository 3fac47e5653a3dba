"""Metrics of remote calls, from a log of calls to measurements, and the rules such metrics keep.

A log has a row for each call: side (``client`` or ``server``), ts_ms, latency_ns, request_size and
response_size, and any of the columns of ``COLUMNS``, ``path``, ``asg`` columns of either side and ``extra``, a map
of further tags. Missing columns count as null, and null or empty values give no tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls
from ..functions.text import sanitize_path, server_group
from . import meters, sketches
from .limiters import ROLLED_UP

#: Tag key by column of the log.
COLUMNS = {
    "owner": "owner", "result": "ipc.result", "status": "ipc.status", "status_detail": "ipc.status.detail", "attempt": "ipc.attempt", "attempt_final": "ipc.attempt.final",
    "endpoint": "ipc.endpoint", "vip": "ipc.vip", "protocol": "ipc.protocol", "http_status": "http.status", "http_method": "http.method",
    "client_app": "ipc.client.app", "client_cluster": "ipc.client.cluster", "client_asg": "ipc.client.asg",
    "server_app": "ipc.server.app", "server_cluster": "ipc.server.cluster", "server_asg": "ipc.server.asg",
}
CLIENT_ONLY = ("attempt", "attempt_final", "server_app", "server_cluster", "server_asg")
SERVER_ONLY = ("client_app", "client_cluster", "client_asg")
#: Distinct values of a tag key beyond which all become the marker.
LIMIT = 25

#: Tag keys that metrics must have, and further ones that they may have.
_CALL, _TRIED = {"owner", "ipc.result", "ipc.status"}, {"ipc.attempt", "ipc.attempt.final"}
_MAY = {"ipc.endpoint", "ipc.failure.injected", "http.method", "http.status", "id", "ipc.protocol", "ipc.status.detail", "ipc.vip"}
_INFLIGHT_MAY = {"ipc.endpoint", "id", "ipc.protocol", "ipc.vip"}
_PEER = {side: {f"ipc.{side}.{x}" for x in ("app", "cluster", "asg")} for side in ("client", "server")}
#: Meter type, required and optional tag keys by metric.
METRICS = {
    "ipc.client.call": ("timer", _CALL | _TRIED, _MAY | _PEER["server"]),
    "ipc.server.call": ("timer", _CALL, _MAY | _PEER["client"]),
    "ipc.client.call.size.inbound": ("summary", _CALL | _TRIED, _MAY | _PEER["server"]),
    "ipc.client.call.size.outbound": ("summary", _CALL | _TRIED, _MAY | _PEER["server"]),
    "ipc.server.call.size.inbound": ("summary", _CALL, _MAY | _PEER["client"]),
    "ipc.server.call.size.outbound": ("summary", _CALL, _MAY | _PEER["client"]),
    "ipc.client.inflight": ("summary", {"owner"}, _INFLIGHT_MAY | _PEER["server"]),
    "ipc.server.inflight": ("summary", {"owner"}, _INFLIGHT_MAY | _PEER["client"]),
}
#: What tags with a closed set of values may hold.
VALUES = {
    "ipc.attempt.final": ("true", "false"),
    "ipc.attempt": ("initial", "second", "third_up", "unknown"),
    "ipc.result": ("success", "failure"),
    "ipc.status": calls.STATUSES,
    "ipc.failure.injected": ("none", "failure", "delay", "delay_and_failure"),
}


def completed(log: DataFrame) -> DataFrame:
    """``log`` with every column of ``COLUMNS``, those that follow from others filled in.

    The endpoint is the sanitised path, or unknown without a path and for code 404; without a status the result decides.
    """
    have = set(log.columns)
    col = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    code = calls.valid_code(F.coalesce(col("http_status", "int"), F.lit(-1)))
    status = F.coalesce(col("status"), calls.status_of_exception(col("exception")), F.when(code > 0, calls.status_of_code(code)), F.when(col("result") == "failure", "unexpected_error"), F.lit("success"))
    endpoint = F.when(col("path").isNull() | (code == 404), "unknown").otherwise(sanitize_path(col("path")))
    full = {
        "result": F.coalesce(col("result"), calls.result_of(status)), "status": status, "status_detail": F.coalesce(col("status_detail"), calls.simple_name(col("exception"))),
        "attempt": calls.attempt_of(F.coalesce(col("attempt", "int"), F.lit(1))), "attempt_final": F.coalesce(col("attempt_final", "boolean"), F.lit(True)).cast("string"),
        "endpoint": F.coalesce(col("endpoint"), endpoint), "http_status": code.cast("string"), "http_method": F.lower(F.coalesce(col("http_method"), F.lit("unknown"))),
    }
    for side in ("client", "server"):
        group = server_group(col(f"{side}_asg"))
        full |= {f"{side}_{x}": F.coalesce(col(f"{side}_{x}"), group[x]) for x in ("app", "cluster")}
    return log.withColumns(full | {c: col(c) for c in COLUMNS if c not in full})


def tagged(log: DataFrame) -> DataFrame:
    """A completed log with tags: those of its side, and ``extra`` below them."""
    own = F.array(*[F.struct(F.lit(k).alias("key"), F.when(_side(c), F.col(c)).alias("value")) for c, k in COLUMNS.items()])
    own = F.map_from_entries(own)
    if "extra" in log.columns:
        more = F.coalesce("extra", F.create_map().cast("map<string,string>"))
        own = F.map_concat(F.map_filter(more, lambda k, _: ~k.isin(*COLUMNS.values())), own)
    return log.withColumn("tags", F.map_filter(own, lambda _, v: v.isNotNull() & (v != "")))


def _side(column: str) -> Column:
    if column in CLIENT_ONLY:
        return F.col("side") == "client"
    return F.col("side") != "client" if column in SERVER_ONLY else F.lit(True)


def limited(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Tags whose key has more than ``limit`` distinct values get the marker instead, results and statuses aside.

    Distinct pairs are aggregated before the keys are; what is broadcast is one row of keys.
    """
    free = F.col("key").isin("ipc.result", "ipc.status", "ipc.attempt", "ipc.attempt.final")
    pairs = rows.select(F.explode_outer("tags")).where(F.col("key").isNotNull() & ~free).distinct()  # outer: no filter on the maps is inferred, which would repeat what makes them
    over = pairs.groupBy("key").count().where(F.col("count") > limit).agg(F.collect_list("key").alias("__over"))
    marked = F.transform_values("tags", lambda k, v: F.when(F.array_contains("__over", k), F.lit(ROLLED_UP)).otherwise(v))
    return rows.join(F.broadcast(over)).withColumn("tags", marked).drop("__over")  # one row


def records(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    """name, tags, meter_type, ts_ms and amount: a timer record of each call, and one of each size that is known."""
    client = F.col("side") == "client"
    size = lambda c, way: F.struct(F.concat(F.lit("ipc."), F.when(client, "client").otherwise("server"), F.lit(f".call.size.{way}")).alias("name"), F.lit("summary").alias("meter_type"), F.col(c).cast("double").alias("amount"))
    inward, outward = F.when(client, size("response_size", "inbound")).otherwise(size("request_size", "inbound")), F.when(client, size("request_size", "outbound")).otherwise(size("response_size", "outbound"))
    call = F.struct(F.when(client, "ipc.client.call").otherwise("ipc.server.call").alias("name"), F.lit("timer").alias("meter_type"), F.col("latency_ns").cast("double").alias("amount"))
    rows = limited(tagged(completed(log)), limit).select("tags", "ts_ms", F.inline_outer(F.array(call, inward, outward)))
    return rows.where(F.col("amount").isNotNull() & ((F.col("amount") >= 0) | (F.col("meter_type") == "timer"))).select("name", "tags", "meter_type", "ts_ms", "amount")


def measured(rows: DataFrame, step_ms: int) -> DataFrame:
    """Records as measurements (name, tags with their statistic, ts_ms, value); timers have percentile counts as well."""
    timer = F.col("meter_type") == "timer"
    keyed, ids = rows.select("name", "tags", "meter_type", "ts_ms", "amount"), ["name", "tags", "meter_type"]
    # timers in seconds from here on, so that one aggregate serves both types
    totals = meters.distribution_summary(keyed.withColumn("amount", F.when(timer, F.col("amount") * 1e-9).otherwise(F.col("amount"))), ids, step_ms)
    totals = totals.withColumn("statistic", F.when(timer & (F.col("statistic") == "totalAmount"), "totalTime").otherwise(F.col("statistic")))
    counts = sketches.percentile_counts(meters.stepped(keyed.where(timer), "ts_ms", step_ms), [*ids, "__end"], "amount")
    counts = counts.select(*ids, F.col("__end").cast("long").alias("ts_ms"), F.lit("percentile").alias("statistic"), (F.col("count") / (step_ms / 1000.0)).alias("value"), "percentile")
    one = lambda k: F.create_map(F.lit(k), F.col(k))
    totals = totals.select("name", F.map_concat("tags", one("statistic")).alias("tags"), "ts_ms", "value")
    counts = counts.select("name", F.map_concat("tags", one("statistic"), one("percentile")).alias("tags"), "ts_ms", "value")
    return totals.unionByName(counts)


def violations(series: DataFrame, strict: bool = False, kind: str | None = None) -> DataFrame:
    """Series (name, tags) of the metrics above that break rules, with all ``violations`` of each; percentile series and other names pass.

    Required keys are there, closed sets of values hold, the result follows from the status, ``kind`` (a column) is the
    meter type, and with ``strict`` no other keys are used.
    """
    tag = lambda k: F.col("tags")[k]
    checks = []
    for name, (meter, required, optional) in METRICS.items():
        mine = F.col("name") == name
        checks += [F.when(mine & tag(k).isNull(), F.lit(f"missing {k}")) for k in sorted(required)]
        if kind:
            checks.append(F.when(mine & (F.col(kind) != meter), F.lit("wrong type")))
        if strict:
            keys = F.array(*[F.lit(k) for k in sorted(required | optional | {"statistic", "percentile"})])
            odd = F.array_sort(F.array_except(F.map_keys("tags"), keys))
            checks.append(F.when(mine & (F.size(odd) > 0), F.concat(F.lit("unspecified "), F.array_join(odd, " "))))
    checks += [F.when(~tag(k).isin(*values), F.lit(f"invalid {k}")) for k, values in VALUES.items()]
    checks.append(F.when(calls.result_of(tag("ipc.status")) != tag("ipc.result"), F.lit("result contradicts status")))
    known = F.col("name").isin(*METRICS) & (F.coalesce(tag("statistic"), F.lit("")) != "percentile")
    return series.where(known).withColumn("violations", F.array_compact(F.array(*checks))).where(F.size("violations") > 0)
