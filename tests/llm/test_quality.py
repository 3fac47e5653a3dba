"""The factorisation machine: its identity, its gradient in effect, and held-out accuracy."""

import numpy as np
import pytest

from stepwell.llm import quality, queries

from .helpers import EDGE, edge, empty, rows, table


def test_linear_time_identity():
    fm = quality.FactorisationMachine()
    rng = np.random.default_rng(0)
    fm.w[:] = rng.normal(size=len(fm.w))
    fm.ws[:] = rng.normal(size=len(fm.ws))
    words, z = rng.integers(0, quality.BUCKETS, 12), rng.normal(size=len(quality.STATS))
    x = [(1 / 12, fm.w[i], fm.v[i]) for i in words] + [(z[i], fm.ws[i], fm.vs[i]) for i in range(len(z))]
    want = sum(a * w for a, w, _ in x) + sum(x[i][0] * x[j][0] * float(x[i][2] @ x[j][2]) for i in range(len(x)) for j in range(i))
    assert fm._parts(words, z)[0] == pytest.approx(want)


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows(queries.op7_quality(spark, sf))}
    assert len(got) == len(table(sf, "documents"))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == quality.held_out(i) for i, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in table(sf, "labels") if quality.held_out(r["doc_id"]) and r["doc_id"] in got and r["quality"] is not None]
    right = np.mean([r["predicted"] == y for r, y in held])
    assert right >= 0.9


def test_scores_equal_the_pairwise_sum(spark, small):
    """Every score of the table against the model's definition: all pairs, one by one."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    fm = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    got = {r["doc_id"]: r["__score"] for r in rows(quality.score(docs, fm))}
    for r in table(small, "documents"):
        words, stats = quality.features(r["text"])
        if len(words) > 400:
            continue
        z = np.clip((stats - fm.mean) / fm.scale, -5, 5)
        x = np.concatenate([np.full(len(words), 1 / max(1, len(words))), z])
        v = np.concatenate([fm.v[words], fm.vs]) * x[:, None]
        pairs = v @ v.T
        y = fm.bias + float(x @ np.concatenate([fm.w[words], fm.ws])) + (pairs.sum() - np.trace(pairs)) / 2
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-np.clip(y, -30, 30))), abs=1e-9)


def test_repeated_labelled_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a a a")] * 50 + [(2, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    once = quality.train(docs.distinct().where("text is null or text <> 'b'"), labels)
    assert (quality.train(docs, labels).w == once.w).all()


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.train(edge(spark), labels)
    got = rows(quality.score(edge(spark), model))
    assert len(got) == len(EDGE) and all(0 <= r["__score"] <= 1 for r in got)
    assert rows(quality.score(empty(spark), model)) == []
    none = quality.train(empty(spark), labels.limit(0))
    assert {r["__score"] for r in rows(quality.score(edge(spark), none))} == {0.5}
