"""Near-duplicate classes against brute force over all pairs, similarity weighted by how often shingles occur."""

from collections import Counter

import numpy as np
import pytest

from stepwell.llm import dartminhash, queries

from .helpers import EDGE, edge, empty, rows, table


def brute(docs, similarity=0.8):
    sets = [(i, Counter(dict(zip(*(x.tolist() for x in dartminhash.shingles(t)))))) for i, t in docs]
    size = {i: s.total() for i, s in sets}
    label = {i: i for i, _ in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if min(size[i], size[j]) >= similarity * max(size[i], size[j]):
                both = (a & b).total()
                if (not a and not b) or both >= similarity * (size[i] + size[j] - both):
                    x, y = sorted((top(i), top(j)))
                    label[y] = x
    return {i: top(i) for i, _ in sets}


def shifted(n, k):
    return " ".join(f"w{i}" if i >= k else f"v{i}" for i in range(n))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    got = np.mean([np.mean(dartminhash.dart_minhash(a, k=256, seed=s) == dartminhash.dart_minhash(b, k=256, seed=s)) for s in range(20)])
    assert abs(got - 200 / 400) < 0.03


def test_weighted_signatures_estimate_weighted_similarity():
    e = np.arange(40, dtype=np.uint64) * np.uint64(7919)
    x, y = np.linspace(0.5, 9, 40), np.linspace(9, 0.5, 40)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    got = np.mean([np.mean(dartminhash.dart_minhash(e, x, 256, s) == dartminhash.dart_minhash(e, y, 256, s)) for s in range(20)])
    assert abs(got - want) < 0.03


def test_op10_equals_brute_force(spark, small):
    got = {r["doc_id"]: r["class_id"] for r in rows(queries.op10_near_duplicates(spark, small))}
    assert got == brute([(r["doc_id"], r["text"]) for r in table(small, "documents")])


def test_chains_stars_and_short_texts(spark):
    docs = [(100 + k, shifted(400, 6 * k)) for k in range(40)]  # neighbours are near, ends are not
    docs += [(500 + k, shifted(100, 0) + f" tail{k}") for k in range(60)]
    docs += [(700, "a b"), (701, "A  b"), (702, "a b c"), (703, ""), (704, " \n"), (705, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["class_id"] for r in rows(dartminhash.near_duplicates(df))} == brute(docs)


def test_weights_count(spark):
    """Texts with equal sets of shingles, but not as often: less similar than their sets."""
    line = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{line} " * 10), (2, f"{line} " * 11), (3, f"{line} " * 30), (4, f"{line} " * 28 + "end"), (5, f"{line} " * 2)]
    got = {r["doc_id"]: r["class_id"] for r in rows(dartminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == brute(docs) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_unlike_texts_of_one_id(spark):
    docs = [(1, shifted(50, 0)), (2, shifted(50, 0)), (2, shifted(50, 40)), (3, shifted(50, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [{r["doc_id"]: r["class_id"] for r in rows(dartminhash.near_duplicates(df.repartition(n)))} for n in (1, 4)]
    least = min(docs[1:3], key=lambda d: dartminhash.set_digest(dartminhash.shingles(d[1])))
    assert got[0] == got[1] == brute([docs[0], least, docs[3]])


def test_awkward_rows(spark):
    got = {r["doc_id"]: r["class_id"] for r in rows(dartminhash.near_duplicates(edge(spark)))}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 6, 8: 2}
    assert rows(dartminhash.near_duplicates(empty(spark))) == []


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in rows(dartminhash.components(links))}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    with pytest.raises(KeyError):
        got[999]


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    docs = [(k, shifted(120, 5 * k)) for k in range(20)] + [(100 + k, shifted(120, 0) + f" x{k} y{k} z{k}") for k in range(20)]
    whole = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = dartminhash.shingle_sets(df, df.select("doc_id"))
    members = df.selectExpr("doc_id as rep", "1L as key", "120 as n")
    labels = df.selectExpr("doc_id as node", "doc_id as label")
    for block in (1 << 18, 400):
        links = dartminhash._rest(members, labels, sets, 0.8, block)
        got = {r["node"]: r["label"] for r in rows(dartminhash.components(links))}
        assert {i: got.get(i, i) for i in whole} == whole
