"""Metrics of calls: defaults, sides, limits, measurements, rules."""

from pyspark.sql import functions as F

from stepwell.functions import calls
from stepwell.operators import call_metrics

LOG = "side string, ts_ms long, latency_ns long, request_size long, response_size long, owner string, vip string, path string, http_status int, exception string, server_asg string, extra map<string,string>"


def log(spark, *rows):
    return spark.createDataFrame([dict(zip((c.split()[0] for c in LOG.split(", ")), r)) for r in rows], LOG)


def test_tags_of_a_side_and_defaults(spark):
    rows = log(spark, ("client", 1, 5, None, None, "me", "", "/api/v1/x", 200, None, "app-stack-v001", {"k": "v", "e": ""}), ("server", 1, 5, -1, 0, None, "b", "/api", 404, None, "app", None))
    a, b = [r.tags for r in call_metrics.tagged(call_metrics.completed(rows)).orderBy("side").collect()]
    assert a == {"owner": "me", "ipc.result": "success", "ipc.status": "success", "ipc.attempt": "initial", "ipc.attempt.final": "true", "ipc.endpoint": "_api_v1_x", "http.status": "200", "http.method": "unknown", "ipc.server.app": "app", "ipc.server.cluster": "app-stack", "ipc.server.asg": "app-stack-v001", "k": "v"}
    assert b == {"ipc.result": "success", "ipc.status": "success", "ipc.endpoint": "unknown", "ipc.vip": "b", "http.status": "404", "http.method": "unknown"}


def test_records_by_side(spark):
    rows = log(spark, ("client", 1, 5, 7, None, "me", "v", None, None, None, None, None), ("server", 1, 6, -1, 0, "me", "v", None, None, "java.net.SocketTimeoutException", None, None))
    got = call_metrics.records(rows)
    assert {(r.name, r.meter_type, r.amount, r.tags["ipc.status"]) for r in got.collect()} == {("ipc.client.call", "timer", 5.0, "success"), ("ipc.client.call.size.outbound", "summary", 7.0, "success"), ("ipc.server.call", "timer", 6.0, "timeout"), ("ipc.server.call.size.outbound", "summary", 0.0, "timeout")}
    out = {(r.name, r.tags["statistic"], r.tags.get("percentile")): r.value for r in call_metrics.measured(got, 1000).collect()}
    assert out["ipc.client.call", "percentile", "T0005"] == 1.0 and abs(out["ipc.client.call", "totalTime", None] - 5e-9) < 1e-18 and out["ipc.server.call.size.outbound", "count", None] == 1.0


def test_values_beyond_the_limit_become_one(spark):
    rows = log(spark, *[("client", 1, 5, None, None, "me", f"v{i % 3}", None, None, None, None, None) for i in range(6)])
    vips = lambda n: {r.tags["ipc.vip"] for r in call_metrics.records(rows, n).collect()}
    assert vips(3) == {"v0", "v1", "v2"} and vips(2) == {"--auto-rollup--"}


def test_records_keep_the_rules(spark):
    rows = log(spark, ("client", 1, 5, 7, 3, "me", "v", "/a", 500, None, None, None), ("server", 1, 6, 8, 0, "me", "v", None, None, "x.IOException", None, None))
    made = call_metrics.records(rows)
    assert call_metrics.violations(made, strict=True, kind="meter_type").count() == 0
    wrong = made.withColumn("meter_type", F.lit("gauge")).withColumn("tags", F.map_filter("tags", lambda k, _: k != "owner"))
    assert {tuple(r.violations) for r in call_metrics.violations(wrong, kind="meter_type").collect()} == {("missing owner", "wrong type")}
    assert call_metrics.records(rows.limit(0)).count() == 0


def test_endpoints_follow_from_paths(spark):
    rows = spark.createDataFrame([(1, "/a/b?x", 200), (2, "/a/b", 404), (3, None, 200)], "n int, path string, http_status int")
    assert [r.endpoint for r in calls.derived(rows).orderBy("n").collect()] == ["_a_b", "unknown", "unknown"]
