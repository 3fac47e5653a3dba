"""String tables: whole batches, one shuffle, odd strings and values."""

import json
import time

import pytest
from pyspark.sql import functions as F

from stepwell.sources import sinks

SCHEMA = "name string, tags map<string,string>, ts_ms long, value double"


def decoded(payload):
    got = json.loads(payload)
    strings, at, found = got[1 : 1 + got[0]], 1 + got[0], []
    assert strings == sorted(set(strings))
    while at < len(got):
        n = got[at]
        found.append((tuple(strings[i] for i in got[at + 1 : at + 1 + 2 * n]), got[at + 1 + 2 * n], got[at + 2 + 2 * n]))
        at += 3 + 2 * n
    return found


def test_a_wide_batch_is_whole_and_quick(spark):
    n = 40_000
    rows = spark.range(n).select(F.lit("m").alias("name"), F.create_map(F.lit("user"), F.concat(F.lit("u"), "id")).alias("tags"), F.col("id").alias("ts_ms"), (F.col("id") + 1).cast("double").alias("value")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sinks.string_table(rows.limit(1), n, ["ts_ms"]).collect()  # starts a worker
        began = time.time()
        (r,) = sinks.string_table(rows, n, ["ts_ms"]).collect()
        took = time.time() - began
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert decoded(r.payload) == [(("user", f"u{i}", "name", "m"), 10, i + 1.0) for i in range(n)]
    assert took < 30


def test_rows_are_shuffled_once(spark):
    rows = spark.createDataFrame([("m", {"a": "b"}, 1, 2.0)], SCHEMA)
    plan = sinks.string_table(rows, 10, ["ts_ms"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_missing_values_and_tags_leave_the_payload_whole(spark):
    rows = spark.createDataFrame([("m", {"a": None, "b": "x"}, 1, 1.0), ("m", {"c": "y"}, 2, None), ("m", None, 3, 3.0), (None, {}, 4, 4.0)], SCHEMA).coalesce(1)
    found = sorted(e for r in sinks.string_table(rows, 10, ["ts_ms"]).collect() for e in decoded(r.payload))
    assert found == [((), 10, 4.0), (("b", "x", "name", "m"), 10, 1.0), (("name", "m"), 10, 3.0)]


def test_batches_of_ties_depend_on_no_order_of_arrival(spark):
    rows = [("m", {"k": f"v{i:02}"}, 1, 1.0) for i in range(40)]
    sent = [[decoded(r.payload) for r in sinks.string_table(spark.createDataFrame(x, SCHEMA).coalesce(1), 7, ["ts_ms"]).collect()] for x in (rows, rows[::-1])]
    assert all(len(b) <= 7 for s in sent for b in s)
    assert sent[0] == sent[1] and sorted(e[0][1] for b in sent[0] for e in b) == [f"v{i:02}" for i in range(40)]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_strings_are_escaped_as_by_spark(spark, size):
    odd = [chr(i) + "x" for i in range(1, 128)] + ["é", " ", "😀", "�", "a/b"]
    rows = spark.createDataFrame([("m", {"k": s}, i, 1.0) for i, s in enumerate(odd)], SCHEMA)
    got = sinks.string_table(rows, size, ["ts_ms"]).collect()
    assert sorted(e[0][1] for r in got for e in decoded(r.payload)) == sorted(odd)
    quoted = [r.j[1:-1] for r in spark.createDataFrame([(s,) for s in odd], "s string").select(F.to_json(F.array("s")).alias("j")).collect()]
    assert all(any(q in r.payload for r in got) for q in quoted)
