"""Many stored queries against a stream of ids.

Few queries are compiled into one wide projection of predicates whose common parts are computed once per
row: map-only, without a join or a shuffle. Of many, those that fix a tag are an inverted index: a table keyed by
the rarest tag they fix, joined with the tags of a row, with what else they ask for as data. So a row meets only the
queries that ask for one of its tags, and the plan doesn't grow with the queries.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ast, regex
from ..plans.compile import Series, predicate
from ..plans.parser import parse_query

#: Queries from which on the index is used, and most of them that it broadcasts.
MANY, BROADCAST = 64, 100_000
#: Most alternatives of a query in the index.
MOST_CLAUSES = 64


def _parsed(queries: dict[str, str]) -> dict[str, ast.Query]:
    return {k: ast.normalise(parse_query(q)) for k, q in queries.items()}


def matches(df: DataFrame, queries: dict[str, str], series: Series = Series(), out: str = "query_id") -> DataFrame:
    """A row for each query that a row matches (each once)."""
    return matched(df, _parsed(queries), series, out)


def matched(df: DataFrame, queries: dict[str, ast.Query], series: Series = Series(), out: str = "query_id") -> DataFrame:
    """``matches`` of parsed queries."""
    indexed = _index(queries) if len(queries) > MANY else []
    held = {r[2] for r in indexed}
    rest = {k: q for k, q in queries.items() if k not in held}
    found = [_joined(df, indexed, series, out)] if indexed else []
    if rest or not found:
        found.append(_projected(df, rest, series, out))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _projected(df: DataFrame, queries: dict[str, ast.Query], series: Series, out: str) -> DataFrame:
    """Queries that fix the name are tried only on rows of that name."""
    by_name: dict[str | None, list[tuple[str, ast.Query]]] = {}
    for k, q in queries.items():
        if q != ast.FALSE:
            by_name.setdefault(q.exact().get("name"), []).append((k, q))
    none = F.array().cast("array<string>")
    hits = []
    for name, group in by_name.items():
        some = F.array_compact(F.array(*[F.when(predicate(q, series), F.lit(k)) for k, q in group]))
        hits.append(some if name is None else F.when(F.coalesce(series.tag("name") == name, F.lit(False)), some).otherwise(none))
    found = F.concat(*hits) if hits else none
    return df.withColumn(out, F.explode(found))


CONDITION = "struct<key:string,op:string,values:array<string>,no:boolean>"


def _condition(q: ast.Query) -> tuple[str, str, list[str], bool] | None:
    """A leaf, or its negation, as data: key, operation, operands, whether it is negated."""
    no = isinstance(q, ast.Not)
    leaf = q.of if no else q
    if isinstance(leaf, ast.Has):
        return leaf.key, "has", [], no
    if isinstance(leaf, ast.Equal):
        return leaf.key, "in", [leaf.value], no
    if isinstance(leaf, ast.In):
        return leaf.key, "in", list(leaf.values), no
    if isinstance(leaf, ast.Compare):
        return leaf.key, leaf.op, [leaf.value], no
    if isinstance(leaf, ast.Matches) and not regex.never(leaf.tree()):
        return leaf.key, "re", [f"(?{'i' if leaf.ignore_case else ''}s){regex.java(leaf.tree())}"], no
    return None


def _index(queries: dict[str, ast.Query]) -> list[tuple[str, str, str, list[list[tuple]]]]:
    """(key, value, query, clauses of conditions) of the queries that fix a tag."""
    often = Counter(kv for q in queries.values() for kv in q.exact().items())
    rows = []
    for k, q in queries.items():
        fixed = q.exact()
        if q == ast.FALSE or not fixed:
            continue
        key, value = min(fixed.items(), key=lambda kv: (often[kv], kv))
        rest = ast.normalise(q).simplify({key: value})
        clauses = [[]] if rest == ast.TRUE else [[_condition(p) for p in c if p != ast.TRUE] for c in ast.clauses(rest)]
        if len(clauses) <= MOST_CLAUSES and all(p is not None for c in clauses for p in c):
            rows.append((key, value, k, clauses))
    return rows


def _joined(df: DataFrame, index: list[tuple], series: Series, out: str) -> DataFrame:
    keys = sorted({r[0] for r in index})
    table = df.sparkSession.createDataFrame(index, f"__k string, __v string, `{out}` string, __clauses array<array<{CONDITION}>>")
    table = F.broadcast(table) if len(index) <= BROADCAST else table
    rows = df.withColumn("__tags", series.all_tags())
    rows = rows.withColumn("__e", F.explode(F.filter(F.map_entries("__tags"), lambda e: e["key"].isin(*keys))))
    rows = rows.join(table, (F.col("__e.key") == F.col("__k")) & (F.col("__e.value") == F.col("__v")))

    def holds(p: Column) -> Column:
        t, first = F.try_element_at(F.col("__tags"), p["key"]), F.get(p["values"], 0)
        yes = F.when(p["op"] == "has", t.isNotNull()).when(p["op"] == "in", F.array_contains(p["values"], t)).when(p["op"] == "re", F.rlike(t, first))
        yes = yes.when(p["op"] == "lt", t < first).when(p["op"] == "le", t <= first).when(p["op"] == "gt", t > first).when(p["op"] == "ge", t >= first)
        return F.coalesce(yes, F.lit(False)) != p["no"]

    return rows.where(F.exists("__clauses", lambda c: F.forall(c, holds))).select(*df.columns, out)


def could_match(df: DataFrame, queries: dict[str, str], known: dict[str, str], series: Series = Series()) -> DataFrame:
    """Rows that may match some query, judged only by exact conditions on the keys at hand: no match is lost,
    but rows without a key, and regular expressions, count as matching."""
    def may(q: ast.Query) -> ast.Query:
        if isinstance(q, ast.Not):
            return q if isinstance(q.of, (ast.Equal, ast.In)) else ast.TRUE
        if isinstance(q, (ast.Equal, ast.In, ast.Compare)):
            return ast.disjunction(ast.Not(ast.Has(q.key)), q)
        return ast.TRUE

    anyone = ast.any_of(ast.all_of(may(p) for p in c) for q in _parsed(queries).values() for c in ast.clauses(q.simplify(known)))
    return df.where(predicate(anyone, series))


def unmatched(df: DataFrame, queries: dict[str, str], series: Series = Series()) -> DataFrame:
    return df.where(~predicate(ast.any_of(_parsed(queries).values()), series))


def hot_spots(queries: dict[str, str], threshold: int) -> list[tuple[str, int]]:
    """Keys that more than ``threshold`` clauses test by something else than equality."""
    count = Counter(k for q in _parsed(queries).values() for c in ast.clauses(q) for p in c if not isinstance(p, ast.Equal) for k in p.keys())
    return sorted((k, n) for k, n in count.items() if n > threshold)


def by_prefix(df: DataFrame, column: str, prefixes: list[str], out: str = "prefix") -> DataFrame:
    """A row for each of ``prefixes`` that the column starts with."""
    hit = F.array_compact(F.array(*[F.when(F.col(column).startswith(p), F.lit(p)) for p in prefixes]))
    return df.withColumn(out, F.explode(hit))
