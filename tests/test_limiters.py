"""Limiters with budgets above the bound that only ``first`` and ``most_frequent`` have, and what counts as an address."""

import duckdb
import pytest

from stepwell import queries
from stepwell.operators import limiters


def limited(df):
    return [r.limited for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_rollups_keep_more_than_a_hundred_values(spark, groups):
    values = [f"v{i:03}" for i in range(120)]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "g int, i int, v string")
    assert limited(limiters.rollup(rows, "v", 120, groups)) == values
    assert limited(limiters.rollup(rows, "v", 119, groups)) == [limiters.ROLLED_UP] * 120
    assert limited(limiters.rollup_in_order(rows, "v", 120, ["i"], groups)) == values
    assert limited(limiters.rollup_in_order(rows, "v", 110, ["i"], groups)) == values[:110] + [limiters.ROLLED_UP] * 10
    assert limited(limiters.first(rows, "v", 120, ["i"], groups)) == values[:100] + [limiters.OTHERS] * 20


def test_names_and_ips_of_long_negative_and_missing_users(spark, tmp_path):
    users = [1209, 1425, 1500, 3, -1, -3, -5, None, *range(1001, 1060), *range(40)]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*users, *users])], "event_id long, user_id long")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in queries.limiter_names_and_ips(spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(queries.ORACLES["limiter_names_and_ips"]).fetchall()
    assert sorted(got) == sorted(want) and len(got) == 14


def test_addresses_are_what_the_caller_says(spark):
    rows = spark.createDataFrame([(0, "10.0.0.1000"), (1, "10.0.0.1"), (2, None), (3, "10.0.0.2"), (4, "a")], "i int, v string")
    others = limiters.OTHERS
    assert limited(limiters.names_and_ips(rows, "v", 5, ["i"])) == ["10.0.0.1000", "10.0.0.1", None, others, "a"]
    assert limited(limiters.names_and_ips(rows, "v", 5, ["i"], ip=rows.v.startswith("10."))) == ["10.0.0.1000", others, None, others, "a"]
