"""Unlike texts under one doc_id are documents of their own in the near-dedup stage."""

import corpus_pipeline

from .helpers import SCHEMA


def test_dedup_keeps_unlike_texts_of_one_id(spark, small):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
    docs = [(1, one), (2, one), (2, two), (2, two), (2, three), (3, three), (4, two), (None, one)]
    rows = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs], SCHEMA)
    got = corpus_pipeline.dedup_stage(spark, rows, small)
    assert got.columns == rows.columns
    found = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert [t for _, t in found].count(one) == 2  # with the one that has no id
    assert [t for _, t in found].count(two) == 1 and [t for _, t in found].count(three) == 1
    assert (1, one) in found and (0, one) in found and len(found) == 4
