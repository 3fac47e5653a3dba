"""Tables as series: measurements, events with tag maps, and tables whose columns are tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEASUREMENT = "name string, tags map<string,string>, ts_ms long, value double"


def measurements(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of measurements; Parquet, ORC, JSON or what Spark reads else."""
    return spark.read.schema(MEASUREMENT).format(fmt).load(path)


def stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = MEASUREMENT) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def lookup(df: DataFrame, name: str, tags: dict[str, str]) -> DataFrame:
    """The rows of one series: the name and exactly these tags. Name and keys are plain comparisons, which reach the scan where columns allow."""
    same = (F.col("name") == name) & (F.size("tags") == len(tags))
    for k, v in sorted(tags.items()):
        same = same & (F.col("tags")[k] == v)
    return df.where(same)


def of_type(df: DataFrame, *kinds: str, kind: str = "kind") -> DataFrame:
    """The rows of some meter types."""
    return df.where(F.col(kind).isin(*kinds))


def to_measurements(df: DataFrame, name: str | Column, tags: dict[str, str | Column], ts_ms: Column, value: str | Column) -> DataFrame:
    """Any table as measurements; null tags are left out."""
    entries = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))])
    return df.select((F.lit(name) if isinstance(name, str) else name).alias("name"), F.map_filter(entries, lambda _, v: v.isNotNull()).alias("tags"), ts_ms.cast("long").alias("ts_ms"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"))


def millis(ts: str | Column) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def subscriptions(df: DataFrame, now_ms: int | None = None) -> list[dict]:
    """A small table of subscriptions (id, expression, frequency; expr_type, expires_at where it has them), those that haven't expired."""
    if now_ms is not None and "expires_at" in df.columns:
        df = df.where(F.col("expires_at") >= now_ms)
    return [r.asDict() for r in df.collect()]


def env_tags(env: dict[str, str], names: dict[str, list[str]], skip: tuple[str, ...] = ()) -> dict[str, str]:
    """Common tags from environment variables: for each key the first variable that is set and not empty.

    Characters that tags can't hold become underscores, in keys and values.
    """
    fixed = lambda s: re.sub(r"[^-._A-Za-z0-9~^]", "_", s)
    found = {k: next((env[v].strip() for v in several if env.get(v, "").strip()), None) for k, several in names.items() if k not in skip}
    return {fixed(k): fixed(v) for k, v in found.items() if v}


def unpivoted(df: DataFrame, ids: list[str], columns: list[str], key: str = "statistic") -> DataFrame:
    """A snapshot with one column for each number to a row for each."""
    return df.unpivot(ids, columns, key, "value").where("value is not null")


def log_counts(df: DataFrame, level: str = "level", exception: str | None = None, file: str | None = None) -> DataFrame:
    """Messages by level; with an exception column, stack traces by level, exception and file."""
    if exception is None:
        return df.groupBy(level).agg(F.count(F.lit(1)).alias("value"))
    return df.where(F.col(exception).isNotNull()).groupBy(level, exception, *([file] if file else [])).agg(F.count(F.lit(1)).alias("value"))


def attempts(header: Column) -> tuple[Column, Column]:
    """(attempt, max) of a header such as ``attempt=1; max=4``."""
    number = lambda k: F.nullif(F.regexp_extract(header, rf"(?:^|[;\s]){k}=(\d+)", 1), F.lit("")).cast("int")
    return number("attempt"), number("max")
