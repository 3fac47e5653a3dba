"""Data expressions over series: sum, min, max, count and all, grouped by keys or rolled up.

One partial and one final aggregate; filters are plain predicates, so they reach the scan where the tags are columns.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import DataExpr
from ..plans.compile import Series, predicate
from ..plans.parser import parse_data_expr

MOST = sys.float_info.max


def reducer(function: str, v: Column) -> Column:
    """The aggregate; null if no row counts. min and max skip NaN and what isn't strictly inside the double range."""
    if function == "sum":
        return F.sum(v)
    if function == "min":
        return F.min(F.when(v < MOST, v))
    if function == "max":
        return F.max(F.when((v > -MOST) & ~F.isnan(v), v))
    if function == "count":
        return F.count(F.lit(1)).cast("double")
    raise ValueError(function)


def literal_map(tags: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(tags.items()) for x in kv]).cast("map<string,string>") if tags else F.create_map().cast("map<string,string>")


def evaluate(df: DataFrame, expr: DataExpr | str, series: Series = Series(), more: tuple[str, ...] = ()) -> DataFrame:
    """tags (map) and value of each group; ``more``: columns that also separate groups (a timestamp, say).

    Exact tags of the query are in all result tags and win over keys; without any and without keys the
    tags are name=unknown. No matching row: no result row.
    """
    expr = parse_data_expr(expr) if isinstance(expr, str) else expr
    rows, exact, v = df.where(predicate(expr.query, series)), expr.exact(), series.amount()
    if expr.function == "all":
        return rows.select(*more, literal_map({}).alias("tags"), v.alias("value"))
    out = reducer(expr.function, v).alias("value")
    if not expr.grouping:
        got = rows.groupBy(*more).agg(out, F.count(F.lit(1)).alias("__n")).where("__n > 0 and value is not null")
        return got.select(*more, literal_map(exact or {"name": "unknown"}).alias("tags"), "value")
    if expr.grouping == "by":
        names = [f"__k{i}" for i in range(len(expr.keys))]
        keyed = rows.select(*more, v.alias("__v"), *[series.tag(k).alias(n) for k, n in zip(expr.keys, names)])
        for n in names:
            keyed = keyed.where(F.col(n).isNotNull())
        got = keyed.groupBy(*more, *names).agg(reducer(expr.function, F.col("__v")).alias("value")).where("value is not null")
        entries = {k: F.lit(x) for k, x in exact.items()} | {k: F.col(n) for k, n in zip(expr.keys, names) if k not in exact}
        return got.select(*more, F.create_map(*[x for k, c in entries.items() for x in (F.lit(k), c)]).alias("tags"), "value")
    keys = [*expr.keys, "name"] if expr.grouping == "rollup-keep" else list(expr.keys)
    keep = (lambda k: k.isin(*keys)) if expr.grouping == "rollup-keep" else (lambda k: ~k.isin(*keys))
    left = F.map_filter(series.all_tags(), lambda k, _: keep(k) & ~k.isin(*exact) if exact else keep(k))
    got = rows.select(*more, F.array_sort(F.map_entries(left)).alias("__g"), v.alias("__v")).groupBy(*more, "__g").agg(reducer(expr.function, F.col("__v")).alias("value")).where("value is not null")
    return got.select(*more, F.map_concat(F.map_from_entries("__g"), literal_map(exact)).alias("tags"), "value")
