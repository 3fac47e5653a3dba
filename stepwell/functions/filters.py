"""Filters of measurements by regular expressions over names and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _full(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})\\z")


def by_regex(name: str = "", key: str = "", value: str = "", name_col: str = "name", tags_col: str = "tags") -> Column:
    """The name matches, and some tag matches by key and value; empty patterns and ``.*`` ask for nothing."""
    free = lambda p: p in ("", ".*")
    ok = F.lit(True) if free(name) else _full(F.col(name_col), name)
    if free(key) and free(value):
        return ok
    one = lambda e: (F.lit(True) if free(key) else _full(e["key"], key)) & (F.lit(True) if free(value) else _full(e["value"], value))
    return ok & F.exists(F.map_entries(tags_col), one)


def by_prototype(spec: dict, name_col: str = "name", tags_col: str = "tags") -> Column:
    """{"include": {name pattern: {"values": [{"tags": [{"key", "value"}]}]}}, "exclude": ...}: a row must be included
    (if there is anything to include) and not excluded. Of an entry one alternative must hold, all its tags."""

    def tag(t: dict) -> Column:
        return F.exists(F.map_entries(tags_col), lambda e: _full(e["key"], t.get("key") or ".*") & _full(e["value"], t.get("value") or ".*"))

    def entry(pattern: str, body: dict) -> Column:
        some = F.lit(False)
        for v in body.get("values", []):
            every = F.lit(True)
            for t in v.get("tags", []):
                every = every & tag(t)
            some = some | every
        return _full(F.col(name_col), pattern) & (some if body.get("values") else F.lit(True))

    def side(entries: dict) -> Column:
        out = F.lit(False)
        for pattern, body in entries.items():
            out = out | entry(pattern, body)
        return out

    include, exclude = spec.get("include") or {}, spec.get("exclude") or {}
    return (side(include) if include else F.lit(True)) & ~side(exclude)
