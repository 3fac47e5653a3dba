"""Queries to Columns.

``Series`` says where the tags of a row stand: in plain columns (predicates then reach the scan), or in a
name column and a map. A missing key is a null.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ast, regex


@dataclass(frozen=True)
class Series:
    """columns: tags in columns of their own (or constants of the table); tag_map: column with all other tags."""

    columns: dict[str, str | Column] = field(default_factory=lambda: {"name": "name"})
    tag_map: str | None = "tags"
    value: str | Column = "value"

    def tag(self, key: str) -> Column:
        if key in self.columns:
            c = self.columns[key]
            return (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.col(self.tag_map)[key] if self.tag_map else F.lit(None).cast("string")

    def amount(self) -> Column:
        return (F.col(self.value) if isinstance(self.value, str) else self.value).cast("double")

    def all_tags(self) -> Column:
        """All tags of a row as a map; a column wins over a tag of its name."""
        own = F.map_filter(F.create_map(*[x for k in self.columns for x in (F.lit(k), self.tag(k))]), lambda k, v: v.isNotNull()) if self.columns else None
        if self.tag_map is None:
            return own
        rest = F.map_filter(F.coalesce(F.col(self.tag_map), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*self.columns) & v.isNotNull()) if self.columns else F.col(self.tag_map)
        return rest if own is None else F.map_concat(rest, own)


def wide(value: str | Column, **tags: str | Column) -> Series:
    """Series of a table whose tags are columns or constants."""
    return Series(tags, None, value)


def predicate(q: ast.Query, series: Series) -> Column:
    """A two-valued Column that is true where ``q`` matches."""
    if isinstance(q, ast.Const):
        return F.lit(q.value)
    if isinstance(q, ast.Not):
        return ~predicate(q.of, series)
    if isinstance(q, ast.And):
        return predicate(q.left, series) & predicate(q.right, series)
    if isinstance(q, ast.Or):
        return predicate(q.left, series) | predicate(q.right, series)
    t = series.tag(q.key)
    if isinstance(q, ast.Has):
        return t.isNotNull()
    return F.coalesce(_leaf(q, t), F.lit(False))


def _leaf(q: ast.Leaf, t: Column) -> Column:
    if isinstance(q, ast.Equal):
        return t == q.value
    if isinstance(q, ast.In):
        return t.isin(*q.values)
    if isinstance(q, ast.Compare):
        return {"lt": t < q.value, "le": t <= q.value, "gt": t > q.value, "ge": t >= q.value}[q.op]
    if isinstance(q, ast.Matches):
        return found(t, q.tree(), q.ignore_case)
    raise TypeError(q)


def found(t: Column, n: regex.Node, ignore_case: bool = False) -> Column:
    """``n`` is found in ``t``: as equality, prefix, suffix, substring or LIKE if it can be, else by Java's engine."""
    if regex.never(n):
        return F.lit(False)
    if not ignore_case:
        several = regex.expand(n, 32) or [n]
        simple = [regex.lowered(x) for x in several]
        if None not in simple:
            equal = [text for how, text in simple if how == "equals"]
            rest = [getattr(t, how)(text) for how, text in simple if how != "equals"]
            return reduce(Column.__or__, ([t.isin(*equal)] if equal else []) + rest)
        like = regex.to_like(n) if n.kind != "or" else None
        if like is not None:
            return t.like(like)
    return t.rlike(f"(?{'i' if ignore_case else ''}s){regex.java(n)}")


def boolean(expr, t: Column) -> Column | None:
    """The Column of a tree from ``regex.to_boolean``."""
    if expr is None:
        return None
    how, of = expr
    if how == "not":
        return ~boolean(of, t)
    if how == "regex":
        return found(t, of)
    return reduce(Column.__and__ if how == "and" else Column.__or__, [boolean(x, t) for x in of])
