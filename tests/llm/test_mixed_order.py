"""The dealt shards and positions decide what is written, and packing follows it."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from stepwell.llm import mixing, queries

from .helpers import rows


def test_op2_returns_the_dealt_places(spark, small):
    got = rows(queries.op2_mixing(spark, small))
    assert all(len(r["shard"]) == len(r["block"]) == len(r["position"]) and r["taken"] == r["size"] * len(r["shard"]) for r in got)
    assert {s for r in got for s in r["shard"]} <= set(range(16)) and any(len(r["shard"]) == 2 for r in got)


def test_a_block_goes_to_one_shard_as_a_whole(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    shards = defaultdict(set)
    for r in rows(mixing.mix(docs, blocks_per_shard=4, shards=4)):
        for t in r["__takes"]:
            shards[r["source"], t.block].add(t.shard)
    assert all(len(x) == 1 for x in shards.values())


def test_drawn_rows_are_in_order_of_shard_and_position(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mixed = mixing.mix(docs, blocks_per_shard=4, shards=4)
    parts = defaultdict(list)
    for r in mixing.drawn(mixed).withColumn("p", F.spark_partition_id()).collect():
        parts[r.p].append((r["__shard"], r["__position"]))
    order = [x for p in sorted(parts) for x in parts[p]]
    assert order == sorted(order) and len(order) == mixed.agg(F.sum(F.size("__takes"))).first()[0]


def test_packing_follows_the_mix(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    corpus_pipeline.mixing_stage(spark, docs, small).write.parquet(f"{tmp_path}/mix")
    mixed = spark.read.parquet(f"{tmp_path}/mix")
    packed = corpus_pipeline.packing_stage(spark, mixed, small)
    stream = [r.doc_id for r in packed.where("start = 0").orderBy("sequence_id", "offset").collect()]
    placed = mixing.drawn(mixing.mix(docs)).withColumn("p", F.spark_partition_id()).collect()
    want = [r.doc_id for r in sorted(placed, key=lambda r: (r["__shard"], r["__position"]))]
    assert sorted(stream) == sorted(want)
    follows = set(zip(want, want[1:]))
    broken = sum(pair not in follows for pair in zip(stream, stream[1:]))
    assert broken < len({r.p for r in placed})  # only where one file ends
    source = {r.doc_id: r.source for r in docs.collect()}
    changes = lambda ids: sum(source[a] != source[b] for a, b in zip(ids, ids[1:]))
    assert changes(stream) > 0.2 * len(stream)  # no runs of one source
