"""A corpus pipeline of five stages, each an operator of ``stepwell.llm`` applied to all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwell.llm import dartminhash, mixing, packing, quality, secret_scan
from stepwell.llm.common import materialise, quoted
from stepwell.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be good; the others go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.score(docs, model).where("__predicted = 1")
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])


def row_keys(docs: DataFrame) -> DataFrame:
    """Documents with an id, and __key: their doc_id, or a new number above all ids for further texts of one doc_id."""
    named = docs.where("doc_id is not null").withColumn("__text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    texts = named.groupBy(F.col("doc_id").alias("__id")).agg(F.min("__text").alias("x"), F.max("__text").alias("y"))
    clashing = materialise(texts.where("x < y"), "clashing-ids")
    if clashing.isEmpty():
        return named.drop("__text").withColumn("__key", F.col("doc_id").cast("long"))
    top = int(named.agg(F.max(F.col("doc_id").cast("long"))).first()[0]) + 1
    more = named.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__t")).join(clashing, "__id").where("__t > x").select("__id", "__t").distinct()
    more = materialise(more.withColumn("__new", F.monotonically_increasing_id() + F.lit(top)), "new-keys")
    keyed = named.join(more, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__t")), "left")
    keyed = keyed.withColumn("__key", F.coalesce("__new", F.col("doc_id").cast("long")))
    return materialise(keyed.drop("__text", "__id", "__t", "__new"), "row-keys")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (its least doc_id); documents without an id stay.

    Rows that share a doc_id but not the text are documents of their own.
    """
    keyed = row_keys(docs)
    classes = dartminhash.near_duplicates(keyed, "__key")
    kept = classes.where("doc_id = class_id").select(F.col("doc_id").alias("__key"))
    cols = [F.col(quoted(c)) for c in docs.columns]
    named = keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*cols)
    return named.unionByName(docs.where("doc_id is null"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text (n_chars follows); every document stays."""
    masked = secret_scan.redact(F.col("text"), F.col("__spans"))
    found = secret_scan.scan(docs).withColumn("__hit", F.size("__spans") > 0)
    found = found.withColumn("text", F.when(F.col("__hit"), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("__hit"), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*[F.col(quoted(c)) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a row for each time a document is taken.

    Rows are written by shard and position, and packing takes the rows of a file in their order.
    """
    mixed = mixing.drawn(mixing.mix(docs))
    return mixed.select(*[F.col(quoted(c)) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary(), seq_len=1024, end_id=0)


STAGES = [("quality classifier", quality_stage), ("minhash near-dedup", dedup_stage), ("secret scans", secret_stage), ("mixing sources", mixing_stage), ("packing", packing_stage)]

#: A trained classifier and hashed draws have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
