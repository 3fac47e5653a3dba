"""Encodings and sinks: JSON, string-table payloads, line protocol, snapshots, batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import add_missing, fix_chars, keep_keys, to_map
from ..operators.meters import SUMMED


def measurement_json(name: Column, tags: Column, ts_ms: Column, value: Column, common: dict[str, str] | None = None, dstype_key: str = "dstype") -> Column:
    """``{"tags": {...}, "timestamp": ms, "value": v}``: the name is a tag, and the type is gauge where the tags don't say."""
    all_tags = to_map(name, add_missing(add_missing(tags, {dstype_key: "gauge"}), common or {}))
    return F.to_json(F.struct(F.map_from_entries(F.array_sort(F.map_entries(all_tags))).alias("tags"), ts_ms.alias("timestamp"), value.alias("value")))


def numbered(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``df`` with batch, of about ``size`` rows each; the rows of a batch follow each other.

    Rows are range-partitioned and numbered inside their partition, so no task sees all rows; a batch doesn't span partitions.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id())
    at = F.col("__i").bitwiseAND((1 << 33) - 1)  # the partition is in the bits above
    return spread.withColumn("batch", F.concat_ws("-", F.shiftright("__i", 33), F.floor(at / size))).drop("__i")


def payloads(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """batch and metrics (JSON array of the rows), at most ``size`` rows in each."""
    rows = numbered(df, size, order)
    return rows.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("metrics"))


#: What JSON escapes in strings, besides control characters without a short form.
ESCAPED = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def _encoder() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose batches follow each other to batch and payload. All inside, so that workers get it whole and need no import."""

    def quoted(word: bytes) -> str:
        text = word.decode("utf-8", "replace")
        return '"' + re.sub(r'[\x00-\x1f"\\]', lambda m: ESCAPED.get(m[0]) or f"\\u{ord(m[0]):04X}", text) + '"'

    def payload(parts: list[pa.RecordBatch]) -> str:
        """The payload of one batch: its rows' strings and their ends, null where a row isn't sent."""
        rows = pa.Table.from_batches(parts).combine_chunks()
        strings, ends = rows["__s"].chunk(0), rows["__end"].chunk(0)
        words = pc.dictionary_encode(strings.flatten())
        order = pc.sort_indices(words.dictionary).to_numpy()  # by bytes, as Spark sorts strings
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = pc.list_value_length(strings).to_numpy()
        at = pc.binary_join_element_wise("", pa.array(rank[words.indices.to_numpy()]).cast(pa.string()), ",")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), at)
        entries = pc.binary_join_element_wise(pa.array(sizes // 2).cast(pa.string()), pc.binary_join(lists, ""), ",", ends, "")
        table = words.dictionary.cast(pa.binary()).take(pa.array(order)).to_pylist()
        return "[" + ",".join([str(len(table)), *map(quoted, table), *entries.drop_null().to_pylist()]) + "]"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """batch and payload of rows whose batches follow each other; a worker holds one batch and what Arrow sends at a time."""
        name, held = None, []
        made = lambda: pa.RecordBatch.from_pydict({"batch": pa.array([name], pa.string()), "payload": pa.array([payload(held)], pa.string())})
        for part in rows:
            runs, start = pc.run_end_encode(part["batch"]), 0
            for end, batch in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if batch != name and held:
                    yield made()
                    held = []
                name = batch
                held.append(part.slice(start, end - start))
                start = end
        if held:
            yield made()

    return run


def string_table(df: DataFrame, size: int, order: list[str], common: dict[str, str] | None = None) -> DataFrame:
    """batch and payload: ``[n, strings..., (number of tags, key, value, ..., op, value) ...]`` with op 0 to add and 10 for a maximum.

    Strings are numbered in sorted order; null, NaN and sums not above 0 aren't sent, nor tags that are null. Rows equal in ``order``
    come by their strings and values. Strings are looked up by a hash table, made once a batch in an Arrow worker.
    """
    stat, value = F.col("tags")["statistic"], F.col("value")
    op = F.when(F.coalesce(stat.isin(*SUMMED), F.lit(False)), 0).otherwise(10)
    own = F.transform(F.array_sort(F.filter(F.map_entries("tags"), lambda e: e["value"].isNotNull())), lambda e: F.array(e["key"], e["value"]))
    named = F.when(F.col("name").isNotNull(), F.array(F.lit("name"), F.col("name")))
    pairs = F.concat(*[F.array(F.lit(k), F.lit(v)) for k, v in sorted((common or {}).items())], *[F.coalesce(x, F.array().cast("array<string>")) for x in (F.flatten(own), named)])
    keys = [f"__o{i}" for i in range(len(order))]
    entries = df.select(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)], pairs.alias("__s"), op.alias("__op"), value.alias("__v"))
    rows = numbered(entries, size, [*keys, "__s", "__op", "__v"])
    sent = F.col("__v").isNotNull() & ~F.isnan("__v") & ((F.col("__v") > 0) | (F.col("__op") == 10))
    return rows.select("batch", "__s", F.when(sent, F.concat_ws(",", "__op", "__v")).alias("__end")).mapInArrow(_encoder(), "batch string, payload string")


#: Letter of the line protocol by meter type.
LETTERS = {"counter": "c", "timer": "t", "summary": "d", "gauge": "g", "max_gauge": "m"}


def line(kind: Column, name: Column, tags: Column, value: Column) -> Column:
    """``type:name,k=v,...:value``."""
    letter = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])[kind]
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(F.lit(","), fix_chars(e["key"]), F.lit("="), fix_chars(e["value"])))
    return F.concat(letter, F.lit(":"), fix_chars(name), F.array_join(pairs, ""), F.lit(":"), value.cast("string"))


def snapshot(df: DataFrame, kind: str = "kind") -> DataFrame:
    """name, kind and values (JSON): measurements by meter name, NaN left out; for reports, where a name has few series."""
    rows = df.where(~F.isnan("value"))
    entry = F.struct(F.map_from_entries(F.array_sort(F.map_entries("tags"))).alias("tags"), F.struct("value", F.col("ts_ms").alias("t")).alias("last"))
    shown = F.struct(F.to_json(F.col("e.tags")).alias("k"), F.to_json("e").alias("j"))
    got = rows.withColumn("e", entry).groupBy("name").agg(F.min(kind).alias("kind"), F.array_sort(F.collect_list(shown)).alias("v"))
    return got.select("name", "kind", F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x["j"]), ","), F.lit("]")).alias("values"))


def accounted(responses: DataFrame) -> DataFrame:
    """Responses (code, sent, errors) with what was accepted and dropped: all for 200, all but errors below 500, none from 500 on."""
    dropped = F.when(F.col("code") == 200, 0).when(F.col("code") < 500, F.least("errors", "sent")).otherwise(F.col("sent"))
    return responses.withColumn("dropped", dropped).withColumn("accepted", F.col("sent") - dropped).withColumn("reason", F.when(F.col("code") == 200, F.lit(None).cast("string")).when(F.col("code") < 500, "validation").otherwise("http-error"))


def write(df: DataFrame, path: str | None, fmt: str = "parquet", mode: str = "append", **options: str) -> None:
    """A file sink; ``path`` None drops everything."""
    out = df.write.mode(mode).options(**options)
    out.format("noop").save() if path is None else out.format(fmt).save(path)


def composite(*sinks: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    """One sink that writes to all."""

    def to_all(df: DataFrame) -> None:
        for s in sinks:
            s(df)

    return to_all


def projected(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only ``keys`` of the tags."""
    return df.withColumn("tags", keep_keys(F.col("tags"), keys))
