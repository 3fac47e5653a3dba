"""Rollup policies: fewer dimensions by an id mapping or by rules, then aggregates over equal ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import with_tags
from ..plans import ast
from ..plans.compile import Series, predicate
from ..plans.parser import parse_query
from .meters import SUMMED


@dataclass(frozen=True)
class Rule:
    """Rows that match ``query`` lose the tags in ``drop``, or go (operation "drop")."""

    query: str
    drop: tuple[str, ...] = ()
    operation: str = "rollup"


def aggregate(df: DataFrame, extra: list[str] = (), dstype_key: str | None = "dstype") -> DataFrame:
    """Equal (name, tags, ts_ms): NaN-aware sum for summed statistics, else NaN-aware max; the tag ``dstype_key`` says sum there."""
    statistic = F.col("tags")["statistic"]
    summed = F.coalesce(statistic.isin(*SUMMED), F.lit(False))
    tags = F.when(summed, with_tags(F.col("tags"), {dstype_key: "sum"})).otherwise(F.col("tags")) if dstype_key else F.col("tags")
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    rows = df.select(*extra, "name", F.array_sort(F.map_entries(tags)).alias("__e"), "ts_ms", v.alias("__v"), summed.alias("__s"))
    got = rows.groupBy(*extra, "name", "__e", "ts_ms").agg(F.sum("__v").alias("s"), F.max("__v").alias("m"), F.first("__s").alias("f"))
    value = F.coalesce(F.when(F.col("f"), F.col("s")).otherwise(F.col("m")), F.lit(float("nan")))
    return got.select(*extra, "name", F.map_from_entries("__e").alias("tags"), "ts_ms", value.alias("value"))


def by_mapper(df: DataFrame, mapper: Callable[[Column, Column], tuple[Column, Column]], dstype_key: str | None = "dstype") -> DataFrame:
    """``mapper``: (name, tags) to new ones; a null name drops the row."""
    name, tags = mapper(F.col("name"), F.col("tags"))
    return aggregate(df.select(name.alias("name"), tags.alias("tags"), "ts_ms", "value").where("name is not null"), [], dstype_key)


def by_rules(df: DataFrame, rules: list[Rule], common: dict[str, str] | None = None, dstype_key: str | None = "dstype") -> DataFrame:
    """common_tags, name, tags, ts_ms, value.

    Queries see common tags too. A row loses the dimensions of all rules that match it; dimensions that are
    common tags leave the common tags. Rows that no rule matches are aggregated as they are.
    """
    common = common or {}
    queries = [(r, parse_query(r.query).simplify(common)) for r in rules]
    gone = ast.any_of(q for r, q in queries if r.operation == "drop")
    rows = df.where(~predicate(gone, Series()))
    none = F.array().cast("array<string>")
    dims = [F.when(predicate(q, Series()), F.array(*map(F.lit, r.drop))).otherwise(none) for r, q in queries if r.operation == "rollup" and r.drop]
    lost = F.array_distinct(F.concat(*dims)) if dims else none
    rows = rows.withColumn("__lost", lost)
    held = F.create_map(*[F.lit(x) for kv in sorted(common.items()) for x in kv]).cast("map<string,string>") if common else F.create_map().cast("map<string,string>")
    left = lambda m: F.map_filter(m, lambda k, _: ~F.array_contains(F.col("__lost"), k))
    rows = rows.select(F.array_sort(F.map_entries(left(held))).alias("__common"), "name", left(F.col("tags")).alias("tags"), "ts_ms", "value")
    return aggregate(rows, ["__common"], dstype_key).select(F.map_from_entries("__common").alias("common_tags"), "name", "tags", "ts_ms", "value")


def unchanged(df: DataFrame) -> DataFrame:
    return df
