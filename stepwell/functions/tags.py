"""Columns over tag maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that names and tags may hold by default, as the body of a character class.
ALLOWED = "-._A-Za-z0-9~^"


def with_tags(tags: Column, more: Column | dict[str, str | Column]) -> Column:
    """``tags`` with ``more`` added; the later value of a key wins."""
    if isinstance(more, dict):
        more = F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    kept = F.map_filter(tags, lambda k, _: ~F.map_contains_key(more, k))
    return F.map_concat(kept, more)


def add_missing(tags: Column, defaults: dict[str, str | Column]) -> Column:
    """``defaults`` for the keys that ``tags`` lacks."""
    for k, v in defaults.items():
        v = v if isinstance(v, Column) else F.lit(v)
        tags = F.when(F.map_contains_key(tags, k), tags).otherwise(F.map_concat(tags, F.create_map(F.lit(k), v)))
    return tags


def keep_keys(tags: Column, keys: list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(*keys))


def drop_keys(tags: Column, keys: list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*keys))


def to_map(name: Column, tags: Column) -> Column:
    """All tags with the name under ``name``; the real name wins over a tag called so."""
    return with_tags(tags, {"name": name})


def project(name: Column, tags: Column, keys: list[str]) -> Column:
    """Only ``keys``, and the name if it is one of them."""
    return keep_keys(to_map(name, tags), keys)


def fix_chars(text: Column, allowed: str = ALLOWED) -> Column:
    """Characters that aren't allowed become underscores, one for each UTF-16 unit."""
    wide = F.regexp_replace(text, "[\\x{10000}-\\x{10FFFF}]", "__")
    return F.regexp_replace(wide, f"[^{allowed.replace('^', chr(92) + '^').replace('-.', chr(92) + '-.', 1)}]", "_")


def fix_tags(tags: Column, allowed: str = ALLOWED) -> Column:
    """Keys and values with allowed characters only; of keys that become equal the last in key order wins."""
    fixed = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.struct(fix_chars(e["key"], allowed).alias("key"), fix_chars(e["value"], allowed).alias("value")))
    last = F.aggregate(fixed, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def late_bound(names: list[str], values: list[Column]) -> Column:
    """Tags whose values are known only per row; null values give no tag, the last column of a name wins."""
    by = dict(zip(names, values))
    return F.map_filter(F.create_map(*[x for k, v in by.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def text_of(name: Column, tags: Column) -> Column:
    """``name,k=v,...`` in key order: a stable text of an id."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(",", name, F.array_join(pairs, ","))
