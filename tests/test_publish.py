"""The publish path."""

import json

import pytest

from stepwell.operators.rollup import Rule
from stepwell.streaming import publish

POINT = "name string, tags map<string,string>, ts_ms long, value double"


def test_batches_hold_equal_common_tags_and_no_more_than_their_size(spark):
    rows = [(f"n{i}", {"k": str(i % 2), "statistic": "count"}, t, float(i)) for i in range(10) for t in (1000, 2000)] + [("n0", {"k": "0", "statistic": "gauge"}, 1500, float("nan"))]
    got = []
    publish.publish(spark.createDataFrame(rows, POINT), lambda df: got.extend(df.collect()), 1000, 2000, [Rule("k,1,:eq", ("node",))], {"node": "a"}, size=3)
    assert all(r.n <= 3 and r.n == len(json.loads(r.metrics)) for r in got)
    sent = {(r.tags, m["tags"]["name"], m["tags"]["dstype"], m["timestamp"]): m["value"] for r in got for m in json.loads(r.metrics)}
    assert sent == {("{}" if i % 2 else '{"node":"a"}', f"n{i}", "sum", 2000): float(i) for i in range(10)}


def test_steps_must_fit_and_empty_tables_send_nothing(spark):
    empty = spark.createDataFrame([], POINT)
    with pytest.raises(ValueError):
        publish.prepared(empty, 3, 10)
    assert publish.batched(publish.prepared(empty, 5, 10)).count() == 0
