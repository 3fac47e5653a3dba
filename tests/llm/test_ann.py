"""Neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwell.llm import ann, queries

from .helpers import rows, table


def brute(vectors, queries_, k=10):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], dtype=float)
    out = {}
    for i, v in vectors:
        if i in queries_:
            d = np.sqrt(((x - np.array(v, dtype=float)) ** 2).sum(axis=1))
            out[i] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def recall(got, want):
    found = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & {i for i, _ in w}) for q, w in want.items())
    return found / sum(map(len, want.values()))


def test_op3_recall(spark, small):
    vectors = [(r["vec_id"], r["embedding"]) for r in table(small, "embeddings")]
    want = brute(vectors, {i for i, _ in vectors if i % 100 == 0})
    got = rows(queries.op3_ann(spark, small))
    assert len(got) == sum(map(len, want.values())) and recall(got, want) >= 0.95
    exact = dict(vectors)
    for r in got:
        a, b = np.array(exact[r["query_id"]], dtype=float), np.array(exact[r["vec_id"]], dtype=float)
        assert r["score"] == pytest.approx(float(np.sqrt(((a - b) ** 2).sum())), abs=1e-12)
    for q in want:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)


def test_op3_recall_on_a_larger_table(spark):
    """Several cells; and the stopping test leaves most rows of a larger table alone."""
    sf = "/root/testdata/sf0.1"
    vectors = [(r["vec_id"], r["embedding"]) for r in table(sf, "embeddings")]
    want = brute(vectors, {i for i, _ in vectors if i % 100 == 0})
    got = rows(queries.op3_ann(spark, sf))
    assert len(got) == sum(map(len, want.values())) and recall(got, want) >= 0.92


def test_the_stopping_test_prunes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    w = rng.normal(size=(64, ann.DIMS))
    tree, found = ann.LocalTree(np.arange(len(x)), x, x @ w), 0
    for i in range(0, 2000, 100):
        ids, _ = tree.search(i, x[i], x[i] @ w, 10, ann.chi2_quantile(ann.PROB, ann.DIMS), 1e300)
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        found += len(set(ids) & set(np.argsort(d)[:10]))
    assert found >= 0.9 * 200 and tree.looked_at < 0.5 * 20 * len(x)


def test_repeated_query_ids_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(1, 600)] + [(100, [9.0] * 8), (100, [9.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "GROUP", 3)
    got = rows(ann.nearest(df, F.col("vec_id") % 20 == 0, dims=8, prob=0.9999))
    firsts = {}
    for i, v in sorted(vectors):
        firsts.setdefault(i, v)
    assert {r["query_id"] for r in got} == set(range(20, 600, 20))
    for q in (100, 200):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        d = sorted((float(np.sqrt(((np.array(v) - firsts[q]) ** 2).sum())), i) for i, v in vectors if i != q)[:10]
        assert len(own) == 10 and [r["vec_id"] for r in own] == [i for _, i in d]


def test_many_cells_keep_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24)) * 3
    vectors = [(i, (centres[i % 20] + rng.normal(size=24)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = rows(ann.nearest(df, rows_per_cell=100))
    assert recall(got, brute([(i, np.float32(v).tolist()) for i, v in vectors], set(range(0, 3000, 100)))) >= 0.9


def test_awkward_rows(spark):
    bad = [(0, None), (100, [0.0, 0.0]), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [])]
    good = [(200, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (300, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, "q") for i, v in bad + good], "vec_id long, embedding array<double>, query_id string")
    got = rows(ann.nearest(df))
    of = lambda q: [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert {r["query_id"] for r in got} == {200, 300}
    assert of(200) == [(1, 8), (2, 9), (3, 9), (4, 300)] and len(of(300)) == 4
    assert rows(ann.nearest(df.limit(0))) == []
    same = spark.range(5000).selectExpr("id as vec_id", "array(1.0, 2.0) as embedding")
    assert [r["vec_id"] for r in sorted(rows(ann.nearest(same, rows_per_cell=64)), key=lambda r: (r["query_id"], r["rank"]))][:10] == list(range(1, 11))
