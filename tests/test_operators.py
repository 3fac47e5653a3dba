"""Meters, consolidation, sketches, scalar functions, encodings and streaming on small inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from stepwell.functions import calls, text
from stepwell.operators import consolidate, deltas, limiters, matching, meters, sketches
from stepwell.plans.parser import parse_query
from stepwell.sources import sinks
from stepwell.streaming import pipeline


def bucket(v):
    """The bucket of a long, from its binary length."""
    if v <= 4:
        return max(v, 0)
    e = (v.bit_length() - 1) // 2 * 2
    return min(275, 1 + (v - (1 << e)) // ((1 << e) // 3) + (3 if e == 2 else 14 + 9 * (e // 2 - 2)))


def test_bucket_index_and_boundaries(spark):
    values = [-1, 0, 1, 4, 5, 15, 16, 61, 1000, 10**12, 2**62, 2**63 - 1] + [4**k + d for k in range(2, 31) for d in (-1, 0, 1)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", sketches.bucket_index(F.col("v")).alias("b")).collect()
    assert [r.b for r in rows] == [bucket(v) for v in values]
    ends = sketches.boundaries()
    assert len(ends) == 276 and ends == sorted(set(ends)) and ends[-1] == 2**63 - 1


def test_percentiles_of_uniform_data(spark):
    counts = spark.range(100_000).select(sketches.bucket_index(F.col("id")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("count")).withColumn("k", F.lit(1))
    got = sketches.percentiles(counts, ["k"], [25, 50, 90, 99]).first().percentiles
    assert all(abs(g - p * 1000) <= 0.1 * p * 1000 for g, p in zip(got, (25, 50, 90, 99)))


def test_percentile_zero_and_past_the_end(spark):
    counts = spark.createDataFrame([(1, 100, 10), (2, 0, 5), (2, 3, 5)], "k int, bucket int, count long")
    got = {r.k: r.percentiles for r in sketches.percentiles(counts, ["k"], [0, 50, 100]).collect()}
    ends = sketches.boundaries()
    assert got[1] == [0.0, (ends[99] + ends[100]) / 2, float(ends[100])]
    assert got[2][0] == 0.0 and got[2][2] == float(ends[3])


def test_distinct_counts(spark):
    for n in (10, 1000, 50_000):
        regs = sketches.registers(spark.range(n).withColumn("k", F.lit(1)), ["k"], F.col("id"))
        assert sketches.cardinality(regs, ["k"]).first().cardinality == pytest.approx(n, rel=0.35)
    import xxhash

    row = spark.sql("select 5L as a, 'héllo' as b").select(sketches.hash64(F.col("a")).alias("a"), sketches.hash64(F.col("b")).alias("b")).first()
    assert row.a % 2**64 == xxhash.xxh64_intdigest((5).to_bytes(8, "little"), 0) and row.b % 2**64 == xxhash.xxh64_intdigest("héllo".encode(), 0)


def test_consolidation(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 30_000, 12.0), ("a", 60_000, nan), ("b", 60_000, nan), ("a", 60_001, 6.0)], "id string, ts_ms long, value double")
    got = lambda kind: {(r.id, r.ts_ms): r.value for r in consolidate.consolidate(df, ["id"], 5000, 12, kind).collect()}
    assert got("avg") == {("a", 60_000): 1.0, ("a", 120_000): 0.5} and got("max") == {("a", 60_000): 12.0, ("a", 120_000): 6.0}


def test_meters_skip_what_does_not_count(spark):
    df = spark.createDataFrame([(0, 5.0), (4999, -1.0), (5000, 10.0), (1, float("nan")), (2, float("inf"))], "ts_ms long, amount double").withColumn("id", F.lit("x"))
    assert {(r.ts_ms, r.value) for r in meters.counter(df, ["id"], 5000).collect()} == {(5000, 1.0), (10_000, 2.0)}
    assert {(r.ts_ms, r.value) for r in meters.max_gauge(df, ["id"], 5000).collect()} == {(5000, 5.0), (10_000, 10.0)}
    timer = {r.statistic: r.value for r in meters.timer(df.where("ts_ms in (0, 4999)"), ["id"], 5000).collect()}
    assert timer["count"] == 0.4 and timer["totalTime"] == pytest.approx(1e-9) and timer["max"] == pytest.approx(5e-9)
    filled = meters.carried(spark.createDataFrame([("x", 5000, 1.0), ("x", 20_000, 2.0)], "id string, ts_ms long, value double"), ["id"], 5000, 5000)
    assert sorted((r.ts_ms, r.value) for r in filled.collect()) == [(5000, 1.0), (10_000, 1.0), (20_000, 2.0), (25_000, 2.0)]
    assert deltas.monotonic_counter(spark.createDataFrame([(1, 5), (2, 3), (3, 9)], "t long, value long").withColumn("id", F.lit(1)), ["id"], ["t"]).select(F.sum("delta")).first()[0] == 6


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("path,want", [("", "none"), ("/", "none"), ("/api/v1/1234", "_api_v1_-"), ("/api/en?x=1", "_api_-"), ("/graphql/", "_graphql"), ("/a/b/c/d/e/f", "_a_b_c_d_e"), (None, None), ("/" + "a" * 130, "_-")])
def test_paths(spark, path, want):
    assert one(spark, path, text.sanitize_path) == want


@pytest.mark.parametrize("host,want", [("www.example.com:80", "www.example.com"), ("ab12.cd34.example.com", "_.example.com"), ("a.b.c.d.e.f", "_.c.d.e.f"), ("", "none"), ("us-east-1.example.com", "us-east-1.example.com")])
def test_hosts(spark, host, want):
    assert one(spark, host, text.sanitize_host) == want


@pytest.mark.parametrize("asg,want", [
    ("app", ("app", "app", None, None, None, None, None)), ("app-stack-detail-v001", ("app", "app-stack-detail", "stack", "detail", None, None, "v001")), ("-x", (None, None, None, None, None, None, None)),
    ("app-s-x1abc-x2def-rest", ("app", "app-s-x1abc-x2def-rest", "s", "x1abc-x2def-rest", "abc", "def", None)), ("app-v01", ("app", "app-v01", "v01", None, None, None, None)), ("app-v123456", ("app", "app", None, None, None, None, "v123456")),
])
def test_server_groups(spark, asg, want):
    got = text.server_group(F.col("x"))
    r = spark.createDataFrame([(asg,)], "x string").select(*[got[k].alias(k) for k in ("app", "cluster", "stack", "detail", "shard1", "shard2", "sequence")]).first()
    assert tuple(r) == want


def test_arithmetic_and_durations(spark):
    r = spark.range(1).select(text.arithmetic("1,0,:div", None).alias("a"), text.arithmetic("{x},1,:add", lambda k: F.lit(None)).alias("b")).first()
    assert r.a == math.inf and math.isnan(r.b)
    assert text.duration_ms("PT5S") == 5000 and text.duration_ms("P1DT2M") == 86_520_000
    with pytest.raises(ValueError):
        text.duration_ms("5s")


def test_calls(spark):
    log = spark.createDataFrame([("java.net.SocketTimeoutException", None, "us-east-1a"), (None, 503, None), (None, 999, None)], "exception string, http_status int, zone string")
    assert [(r.status, r.result, r.region) for r in calls.derived(log).collect()] == [("timeout", "failure", "us-east-1"), ("throttled", "failure", None), ("success", "success", None)]


@pytest.mark.parametrize("n,want", [(None, "initial"), (0, "unknown"), (-1, "unknown"), (1, "initial"), (2, "second"), (3, "third_up"), (42, "third_up")])
def test_attempts(spark, n, want):
    assert calls.derived(spark.createDataFrame([(n,)], "attempt int")).first().attempt == want


@pytest.mark.parametrize("name,want", [("javax.net.ssl.SSLHandshakeException", "access_denied"), ("java.io.EOFException", "connection_error"), ("java.net.ConnectException", "connection_error"), ("java.util.concurrent.TimeoutException", "timeout"), ("java.lang.NumberFormatException", "bad_request"), ("java.util.concurrent.CancellationException", "bad_request"), ("java.lang.RuntimeException", "unexpected_error"), ("com.example.Outer$MyTimeout", "unexpected_error")])
def test_statuses_of_exceptions(spark, name, want):
    assert one(spark, name, calls.status_of_exception) == want


def test_statuses_by_class_chain(spark):
    chain = F.array(F.lit("com.example.Base"), F.lit("java.net.SocketTimeoutException"), F.lit("java.io.IOException"))
    assert one(spark, "com.example.Mine", lambda x: calls.status_of_exception(x, chain)) == "timeout"


def test_long_values_stay_whole(spark):
    long = "Ab" + "x" * 2_000_000
    assert one(spark, long, text.decapitalized) == "a" + long[1:]
    got = text.server_group(F.col("x"))
    r = spark.createDataFrame([("app-s-x1" + long,)], "x string").select(got["shard1"].alias("a")).first()
    assert r.a == long


@pytest.mark.parametrize("value,want", [("[::1]", True), ("[abc", False), ("10.0.0.1", True), ("host", False), ("]", False)])
def test_addresses(spark, value, want):
    assert one(spark, value, limiters.is_ip) is want


def test_indexed_matching_equals_the_predicates(spark):
    rows = spark.createDataFrame([(i, f"n{i % 5}", {"a": str(i % 7), "b": "x" * (i % 3), **({"c": f"v{i}"} if i % 2 else {})}) for i in range(60)], "i int, name string, tags map<string,string>")
    some = ["a,{0},:eq", "a,{0},:eq,b,xx,:eq,:and", "name,n{1},:eq,c,:has,:not,:and", "name,n{1},:eq,a,(,1,2,{0},),:in,:and", "a,{0},:eq,b,x,:gt,:and", "a,{0},:eq,c,v[1-3],:re,:and", "a,{0},:eq,c,V1,:reic,:not,:and", "a,{0},:eq,b,x,:eq,c,:has,:or,:and", "c,:has", ":true", ":false", "a,{0},:lt"]
    queries = {f"q{k}-{j}": q.format(j, j % 5) for k, q in enumerate(some) for j in range(9)}
    got = sorted(map(tuple, matching.matches(rows, queries).select("i", "query_id").collect()))
    parsed = {k: parse_query(q) for k, q in queries.items()}
    want = sorted((r.i, k) for r in rows.collect() for k, q in parsed.items() if q.matches({**r.tags, "name": r.name}))
    assert len(queries) > matching.MANY and len(matching._index(matching._parsed(queries))) > 50 and got == want


def test_string_table(spark):
    df = spark.createDataFrame([("m", {"statistic": "count", "a": 'q"x'}, 1, 2.0), ("m", {"statistic": "count"}, 2, 0.0), ("g", {}, 3, -1.0)], "name string, tags map<string,string>, ts_ms long, value double").coalesce(1)
    for r in sinks.string_table(df, 10, ["ts_ms"], {"app": "z"}).collect():
        got = json.loads(r.payload)
        strings, at = got[1 : 1 + got[0]], 1 + got[0]
        assert strings == sorted(strings)
        while at < len(got):
            n = got[at]
            tags = {strings[got[at + 1 + 2 * i]]: strings[got[at + 2 + 2 * i]] for i in range(n)}
            assert (tags, got[at + 1 + 2 * n], got[at + 2 + 2 * n]) in [({"app": "z", "statistic": "count", "a": 'q"x', "name": "m"}, 0, 2.0), ({"app": "z", "name": "g"}, 10, -1.0)]
            at += 3 + 2 * n


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("e", {"k": str(i % 2)}, 60_000 * (i // 4 + 1), float(i)) for i in range(12)], "name string, tags map<string,string>, ts_ms long, value double")
    rows.write.parquet(f"{tmp_path}/in")
    subs = [{"id": "s", "expression": ":true,:sum,(,k,),:by", "frequency": 60_000}]
    got = []
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = pipeline.run_subscriptions(stream, lambda: subs, lambda df, n: got.extend(df.collect()), f"{tmp_path}/c", 60_000)
    q.awaitTermination(60)
    pipeline.flush(spark, subs, lambda df, n: got.extend(df.collect()), f"{tmp_path}/c", 0, 60_000)
    want = pipeline.evaluated(rows, subs, 60_000).collect()
    key = lambda r: (r.timestamp, r.sub_id, sorted(r.tags.items()), r.value)
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_subscriptions_consolidate_each_series(spark):
    """Twelve points of 5 s under a subscription of 60 s: rates are averaged, missing ones as 0, gauges are not."""
    data = [("e", {"statistic": "count", "k": "a"}, 5000 * i, 1.0) for i in range(1, 13)] + [("e", {"statistic": "count", "k": "b"}, 5000 * i, 6.0) for i in (1, 12)]
    data += [("g", {"statistic": "gauge"}, 5000 * i, float(i)) for i in (1, 7, 3)] + [("e", {"statistic": "count"}, 60_000, float("nan"))]
    rows = spark.createDataFrame(data, "name string, tags map<string,string>, ts_ms long, value double")
    subs = [{"id": "sum", "expression": "name,e,:eq,:sum", "frequency": 60_000}, {"id": "n", "expression": "name,e,:eq,:count", "frequency": 60_000}, {"id": "g", "expression": "name,g,:eq,:max", "frequency": 60_000}]
    subs += [{"id": "by", "expression": "app,x,:eq,name,e,:eq,:and,:sum,(,k,app,),:by", "frequency": 60_000}, {"id": "five", "expression": "name,g,:eq,:sum", "frequency": 5000}, {"id": "bad", "expression": "a,:nosuch", "frequency": 5000}]
    got = sorted((r.sub_id, r.timestamp, sorted(r.tags.items()), r.value) for r in pipeline.evaluated(rows, subs, 5000, common={"app": "x"}).collect())
    assert got == [
        ("by", 60_000, [("app", "x"), ("k", "a"), ("name", "e")], 1.0), ("by", 60_000, [("app", "x"), ("k", "b"), ("name", "e")], 1.0),
        ("five", 5000, [("name", "g")], 1.0), ("five", 15_000, [("name", "g")], 3.0), ("five", 35_000, [("name", "g")], 7.0),
        ("g", 60_000, [("name", "g")], 7.0), ("n", 60_000, [("name", "e")], 2.0), ("sum", 60_000, [("name", "e")], 2.0),
    ]
    assert [i for i, _ in pipeline.problems(subs)] == ["bad"]


def test_a_timestamp_split_over_batches_gives_one_result(spark, tmp_path):
    data = [("e", {"k": str(i)}, 60_000 * (1 + i // 3), float(i)) for i in range(9)]
    for n, part in enumerate((data[:2], data[2:5], data[5:])):  # the first two timestamps come in two batches
        spark.createDataFrame(part, "name string, tags map<string,string>, ts_ms long, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    subs, got, last = [{"id": "s", "expression": ":true,:sum", "frequency": 60_000}], [], []
    stream = spark.readStream.schema("name string, tags map<string,string>, ts_ms long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    def sink(df, n):
        last.append(n)
        got.extend(df.collect())

    pipeline.run_subscriptions(stream, lambda: subs, sink, f"{tmp_path}/c", 60_000).awaitTermination(90)
    pipeline.flush(spark, subs, sink, f"{tmp_path}/c", 2, 60_000)
    assert sorted((r.timestamp, r.value) for r in got) == [(60_000, 3.0), (120_000, 12.0), (180_000, 21.0)]


def test_windows_are_closed_on_the_right(spark, tmp_path):
    rows = spark.createDataFrame([("a", 60, 6.0), ("a", 61, 12.0), ("a", 500, 1.0)], "id string, s long, value double").select("id", F.timestamp_seconds("s").alias("ts"), "value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = pipeline.consolidated(stream, ["id"], "1 minute", 12, "avg").select("id", F.unix_seconds("ts").alias("s"), "value")
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))[:2] == [("a", 60, 0.5), ("a", 120, 1.0)]
