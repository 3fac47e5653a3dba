"""The pipeline's stages, each against a direct reading of its input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepwell.llm import mixing, queries, secret_scan

from .helpers import edge, empty, rows
from .test_dartminhash import brute


def run_stages(spark, docs, sf, tmp):
    out, ins = [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, ins, sf)
        made.write.parquet(f"{tmp}/{i}")
        ins = spark.read.parquet(f"{tmp}/{i}")
        out.append(ins)
    return out


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good, single, clean, mixed, packed = run_stages(spark, docs, small, tmp_path)
    for made in (good, single, clean, mixed):
        assert made.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in rows(queries.op7_quality(spark, small))}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in scores.items() if p)
    classes = brute([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    assert secret_scan.scan(clean).where(F.size("__spans") > 0).isEmpty()
    was, now = {r.doc_id: r.text for r in single.collect()}, {r.doc_id: r for r in clean.collect()}
    assert set(was) == set(now) and all(r.text == was[i] or "[REDACTED]" in r.text for i, r in now.items())
    assert all(r.n_chars == len(r.text) for r in now.values() if r.text is not None)
    size, taken = Counter(), Counter()
    for r in now.values():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in mixed.collect():
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(size, key=mixing.source_order)
    target = mixing.targets(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.2)
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    total = packed.agg(F.sum("length"), F.max("sequence_id")).first()
    assert total[1] == (total[0] - 1) // 1024


def test_run_equals_its_stages(spark, small, tmp_path):
    got = corpus_pipeline.run(spark, small)
    want = run_stages(spark, spark.read.parquet(f"{small}/documents.parquet"), small, tmp_path)[-1]
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows(df))
    total = lambda df: df.groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert {(r["doc_id"], r["n"]) for r in rows(total(got))} == {(r["doc_id"], r["n"]) for r in rows(total(want))}
    assert key(got)


def test_awkward_and_empty_tables(spark, small, tmp_path):
    run_stages(spark, edge(spark), small, tmp_path / "a")
    assert run_stages(spark, empty(spark), small, tmp_path / "b")[-1].count() == 0
