"""Cardinality limiters: values beyond a budget become one marker.

Results are defined by an explicit order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHERS, ROLLED_UP = "--others--", "--auto-rollup--"
#: ``first`` and ``most_frequent`` keep no more values than this; rollups have no such bound.
MOST = 100
IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def _budget(n: int) -> int:
    return min(n, MOST)


def _top(df: DataFrame, value: str, n: int, groups: list[str], order: list) -> DataFrame:
    """The first ``n`` rows of each group; without groups a top-n of every task meets, never all rows."""
    if not groups:
        return df.orderBy(*order).limit(n).select(value, F.lit(True).alias("__kept"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).select(*groups, value, F.lit(True).alias("__kept"))


def first(df: DataFrame, value: str, n: int, order: list[str], groups: list[str] = (), out: str = "limited") -> DataFrame:
    """The first ``n`` distinct values of a group stay; they are ranked by first arrival after a partial aggregate."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.min(F.struct(*order)).alias("__at"))
    return _marked(df, _top(seen, value, _budget(n), list(groups), ["__at", value]), value, list(groups), out)


def most_frequent(df: DataFrame, value: str, n: int, groups: list[str] = (), out: str = "limited") -> DataFrame:
    """The ``n`` most frequent values stay (ties: smaller value)."""
    often = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))
    return _marked(df, _top(often, value, _budget(n), list(groups), [F.desc("__n"), value]), value, list(groups), out)


def _marked(df: DataFrame, kept: DataFrame, value: str, groups: list[str], out: str) -> DataFrame:
    kept = F.broadcast(kept) if not groups else kept  # at most MOST rows without groups
    return df.join(kept, [*groups, value], "left").withColumn(out, F.when(F.col("__kept") | F.col(value).isNull(), F.col(value)).otherwise(OTHERS)).drop("__kept")


def rollup(df: DataFrame, value: str, n: int, groups: list[str] = (), out: str = "limited") -> DataFrame:
    """All values stay while there are at most ``n``; beyond, all become the marker."""
    if groups:
        count = df.groupBy(*groups).agg(F.count_distinct(value).alias("__n"))
        over = df.join(count, list(groups))
    else:
        over = df.crossJoin(F.broadcast(df.agg(F.count_distinct(value).alias("__n"))))  # one row
    return over.withColumn(out, F.when(F.col("__n") > n, F.lit(ROLLED_UP)).otherwise(F.col(value))).drop("__n")


def rollup_in_order(df: DataFrame, value: str, n: int, order: list[str], groups: list[str] = (), out: str = "limited") -> DataFrame:
    """Values pass until the (n + 1)-th distinct one arrives; from then on all become the marker."""
    seen = df.groupBy(*groups, value).agg(F.min(F.struct(*order)).alias("__at"))
    if groups:
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy("__at"))
        turn = seen.withColumn("__r", rank).where(F.col("__r") == n + 1).select(*groups, "__at")
    else:
        turn = seen.orderBy("__at").limit(n + 1).agg(F.max("__at").alias("__at"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > n).select("__at")
    joined = df.join(turn, list(groups), "left") if groups else df.join(F.broadcast(turn), F.lit(True), "left")
    return joined.withColumn(out, F.when(F.col("__at").isNotNull() & (F.struct(*order) >= F.col("__at")), F.lit(ROLLED_UP)).otherwise(F.col(value))).drop("__at")


def is_ip(value: Column) -> Column:
    """IPv4 or a bracketed address."""
    return value.rlike(IPV4) | (value.startswith("[") & value.endswith("]"))


def names_and_ips(df: DataFrame, value: str, n: int, order: list[str], out: str = "limited", ip: Column | None = None) -> DataFrame:
    """Names keep their first ``n``, addresses their first one; ``ip`` says what is an address where it isn't ``is_ip``."""
    ip = F.coalesce(is_ip(F.col(value)) if ip is None else ip, F.lit(False))  # null is no address
    return first(df.where(~ip), value, n, order, out=out).unionByName(first(df.where(ip), value, 1, order, out=out))
