"""Mixing against its targets, and the splitting tree's exactness."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwell.llm import mixing, queries

from .helpers import EDGE, edge, empty, rows, table


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.integers(0, 1000), min_size=1))
def test_targets(sizes):
    names = sorted(sizes)
    got = mixing.targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    total = sum(sizes.values())
    assert set(got) == set(sizes) and sum(got.values()) == pytest.approx(1.5 * total)
    assert all(got[s] <= 2 * sizes[s] + 1e-6 for s in names)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9))
def test_tree_meets_quotas(quotas, shards):
    tree = mixing.splitting_tree(quotas, shards, 3)
    assert tree.min() >= 0 and tree.sum(axis=0).tolist() == quotas
    assert np.ptp(tree.sum(axis=1)) <= max(1, int(np.ceil(np.log2(shards))))


def test_op2_comes_near_its_targets(spark, small):
    got = rows(queries.op2_mixing(spark, small))
    docs = {r["doc_id"]: r for r in table(small, "documents")}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    size = Counter()
    for d in docs.values():
        size[d["source"]] += n_words(d["text"])
    names = sorted(size, key=mixing.source_order)
    target = mixing.targets(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        n = n_words(docs[r["doc_id"]]["text"])
        assert (r["size"], r["source_size"]) == (n, size[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in names)
    again = {r["doc_id"]: r for r in rows(queries.op2_mixing(spark, small))}
    assert again == {r["doc_id"]: r for r in got}


def test_default_shards_are_even(spark):
    mixed = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    places = rows(mixing.drawn(mixed).groupBy("__shard").agg(F.count("*").alias("n"), F.sum(mixing.words(F.col("text"))).alias("words")))
    assert {r["__shard"] for r in places} == set(range(16))
    n, sizes = [r["n"] for r in places], [r["words"] for r in places]
    assert max(n) < 2 * min(n) and max(sizes) < 2.5 * min(sizes)


def test_takes_come_from_the_dealt_blocks(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = {r["doc_id"]: len(r["__takes"]) for r in rows(mixing.mix(docs))}
    real = mixing.deal
    monkeypatch.setattr(mixing, "deal", lambda *a: [x for x in real(*a) if x[2] != 3])
    less = {r["doc_id"]: len(r["__takes"]) for r in rows(mixing.mix(docs))}
    assert all(less[i] <= n for i, n in whole.items()) and sum(less.values()) < sum(whole.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 9))
def test_every_block_is_dealt_once(quota, shards):
    got = mixing.deal(quota, shards, 3)
    assert sorted((i, b) for i, b, _ in got) == [(i, b) for i, q in enumerate(quota) for b in range(q)]
    tree = mixing.splitting_tree(quota, shards, 3)
    assert all(sum(x[0] == i and x[2] == s for x in got) == tree[s, i] for i in range(len(quota)) for s in range(shards))


def test_clashing_names_and_equal_rows(spark):
    docs = spark.createDataFrame([(i % 3, f"a b {i % 3}", "s", 1, 2, 3) for i in range(300)], "doc_id long, text string, source string, shard int, position int, __x int")
    got = rows(mixing.drawn(mixing.mix(docs, rows_per_range=4)))
    assert set(got[0]) == {*docs.columns, "__shard", "__position"}
    assert sum(3 for _ in got) == pytest.approx(1.5 * 900, abs=3) and max(Counter(r["doc_id"] for r in got).values()) <= 200


def test_awkward_rows(spark):
    got = rows(mixing.mix(edge(spark)))
    assert len(got) == len(EDGE)
    assert all(len(r["__takes"]) <= 2 for r in got)
    assert rows(mixing.mix(empty(spark))) == []
    with pytest.raises(ValueError):
        mixing.mix(empty(spark), most=3)
