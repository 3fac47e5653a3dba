"""Fingerprints against their definition."""

import hashlib

from stepwell.llm import fingerprint, queries

from .helpers import EDGE, edge, empty, rows, table


def check(got, docs):
    docs = sorted(docs)
    by = {r["doc_id"]: r for r in got}
    assert len(by) == len(docs)
    for i, (doc, text) in enumerate(docs):
        nxt, r = docs[(i + 1) % len(docs)][1], by[doc]
        k = len(text) // 4
        edited = text[: len(text) - k] + nxt[:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        canon = fingerprint.canonical
        assert r["near_edited"] == float(canon(edited) == canon(text)) and r["near_next"] == float(canon(nxt) == canon(text))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (canon(edited) == canon(text))
    of = {}
    for doc, text in docs:
        assert of.setdefault(fingerprint.canonical(text), by[doc]["fingerprint"]) == by[doc]["fingerprint"]
    assert len(set(of.values())) == len(of)


def test_op8(spark, small):
    check(rows(queries.op8_fingerprints(spark, small)), [(r["doc_id"], r["text"] or "") for r in table(small, "documents")])


def test_awkward_rows(spark):
    docs = [r for r in {r[0]: r for r in EDGE if r[0] is not None}.values()]
    check(rows(fingerprint.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string, fingerprint string, x string, y long"))), [(r[0], r[1] or "") for r in docs])
    assert len(rows(fingerprint.edited_fingerprints(edge(spark)))) == len(EDGE)
    assert rows(fingerprint.edited_fingerprints(empty(spark))) == []


def test_canonical_forms():
    assert fingerprint.canonical("  ﬁne\tSTRASSE ") == fingerprint.canonical("fine straße")
    assert fingerprint.canonical("é") == fingerprint.canonical("é") != fingerprint.canonical("e")


def test_texts_that_share_a_digest_are_told_apart(spark):
    docs = [(i, f"text number {i % 40}") for i in range(80)] + [(100, ""), (101, None)]
    df = spark.createDataFrame([*docs, (None, "no id"), (None, "other")], "doc_id long, text string")
    assert not fingerprint.collisions(df, bits=8).isEmpty() and fingerprint.collisions(df).isEmpty()
    got = rows(fingerprint.edited_fingerprints(df, bits=8))
    assert len(got) == len(docs) + 2 and any("-" in r["fingerprint"] for r in got)
    of = {}
    for r in got:
        if r["doc_id"] is not None:
            canon = fingerprint.canonical(dict(docs)[r["doc_id"]])
            assert of.setdefault(canon, r["fingerprint"]) == r["fingerprint"]
    assert len(set(of.values())) == len(of)
    edited = {r["edited_sha256"]: r["edited_fingerprint"] for r in got}
    assert len(set(edited.values())) == len(edited)
