"""Exact shard sizes, gapless slots, and the law of the communication matrix."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepwell.llm import queries, sharding

from .helpers import EDGE, edge, empty, rows, table


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.integers(1, 6), st.integers(0, 99))
def test_matrix_has_exact_margins(blocks, parts, seed):
    places = sharding.even_sizes(sum(blocks), parts)
    got = sharding.communication_matrix(blocks, places, seed)
    assert got.min() >= 0 and got.sum(axis=1).tolist() == blocks and got.sum(axis=0).tolist() == places


def test_matrix_means_are_hypergeometric():
    draws = np.array([sharding.communication_matrix([30, 10], [20, 20], s)[0, 0] for s in range(3000)])
    assert abs(draws.mean() - 15) < 0.2
    assert abs(draws.var() - 20 * 0.75 * 0.25 * 20 / 39) < 0.25


def test_draws_agree_on_both_sides_of_the_bound():
    for good, bad, n in ((30, 10, 20), (500, 90, 300), (3, 1000, 40)):
        both = [np.array([sharding.hypergeometric(np.random.default_rng(s), good, bad, n, bound) for s in range(4000)]) for bound in (10**9, 0)]
        assert abs(both[0].mean() - both[1].mean()) < 5 * both[0].std() / 60 and abs(both[0].std() / both[1].std() - 1) < 0.08
        assert both[1].min() >= max(0, n - bad) and both[1].max() <= min(good, n)
    large = [sharding.hypergeometric(np.random.default_rng(s), 3 * 10**10, 10**10, 4000) for s in range(2000)]
    assert abs(np.mean(large) - 3000) < 3 and abs(np.std(large) / np.sqrt(750) - 1) < 0.08
    places = sharding.even_sizes(4 * 10**9, 3)
    got = sharding.communication_matrix([10**9] * 4, places, 1)
    assert got.sum(axis=0).tolist() == places and got.sum(axis=1).tolist() == [10**9] * 4


def test_blocks_and_ranges_grow_with_the_rows(spark):
    for cells in (1 << 22, 8):  # the second: a matrix that can't grow
        got = rows(sharding.shard(spark.range(3000), 4, rows_per_block=10, rows_per_range=20, max_cells=cells))
        assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(750)) for s in range(4))


def test_many_equal_rows_are_spread(spark):
    df = spark.createDataFrame([(i % 2, "same") for i in range(4000)], "doc_id long, text string")
    got = rows(sharding.shard(df, 5, rows_per_block=32, rows_per_range=50))
    assert Counter((r["doc_id"], r["text"]) for r in got) == {(0, "same"): 2000, (1, "same"): 2000}
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(800)) for s in range(5))
    assert all(300 < sum(r["doc_id"] for r in got if r["shard"] == s) < 500 for s in range(5))


def test_op5_shards(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in table(small, "documents")}
    got = rows(queries.op5_sharding(spark, small))
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    import zlib

    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in got)
    assert rows(queries.op5_sharding(spark, small)) and {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in rows(queries.op5_sharding(spark, small))}


def test_several_blocks_and_chunks(spark):
    got = rows(sharding.shard(spark.range(5000), 7, rows_per_block=64, rows_per_range=50))
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 5000 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    firsts = [r["id"] for r in got if r["slot"] < 100]
    assert abs(np.mean(firsts) - 2500) < 300


def test_awkward_rows(spark):
    got = rows(sharding.shard(edge(spark), 4))
    assert len(got) == len(EDGE) and max(Counter(r["shard"] for r in got).values()) == 3
    assert rows(sharding.shard(empty(spark), 4)) == []
    with pytest.raises(ValueError):
        sharding.shard(edge(spark).withColumnRenamed("size", "slot"))
