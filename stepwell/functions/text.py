"""String functions over Columns: paths, hosts, headers, server groups, templates, metric names."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Host segments that are kept though they look random; names of a caller's own systems go in ``allowed``.
HOST_SEGMENTS = (
    "dbms", "graphql", "http", "http1", "http2", "mtls", "www2", "af-south-1", "ap-east-1", "ap-northeast-1", "ap-northeast-2", "ap-northeast-3", "ap-south-1", "ap-south-2",
    "ap-southeast-1", "ap-southeast-2", "ap-southeast-3", "ap-southeast-4", "ca-central-1", "ca-west-1", "eu-central-1", "eu-central-2", "eu-north-1", "eu-south-1", "eu-south-2", "eu-west-1", "eu-west-2", "eu-west-3",
    "fips.ca-central-1", "fips.ca-west-1", "fips.us-east-1", "fips.us-east-2", "fips.us-west-1", "fips.us-west-2", "il-central-1", "me-central-1", "me-south-1", "sa-east-1", "us-east-1", "us-east-2", "us-gov-east-1",
    "us-gov-west-1", "us-west-1", "us-west-2",
)
CONSONANTS = "[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{4}"
LONGEST = 120


def random_looking(segment: Column) -> Column:
    """Four consonants in a row, or neither letters only nor a version such as ``v2``."""
    return segment.rlike(CONSONANTS) | ~(segment.rlike(r"^v[0-9]*\z") | segment.rlike(r"^[a-zA-Z]*\z"))


def sanitize_path(path: Column, allowed: tuple[str, ...] = ()) -> Column:
    """``_a_b``: up to five segments without parameters, random-looking ones (and those of two letters) as ``-``."""
    bare = F.substring_index(F.substring_index(path, "?", 1), ";", 1)
    segments = F.slice(F.filter(F.split(bare, "/"), lambda s: s != ""), 1, 5)
    odd = lambda s: ~s.isin("graphql", *allowed) & (random_looking(s) | (F.char_length(s) == 2) & ~s.rlike(r"^v[0-9]*\z"))

    def add(acc: Column, s: Column) -> Column:
        shown, room = F.when(odd(s), "-").otherwise(s), LONGEST - F.char_length(acc) - 1
        return F.when(F.char_length(shown) < room, F.concat(acc, F.lit("_"), shown)).when(room >= 2, F.concat(acc, F.lit("_-"))).otherwise(acc)

    out = F.aggregate(segments, F.lit(""), add)
    return F.when(path.isNotNull(), F.when(out == "", "none").otherwise(out))


def sanitize_host(host: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Up to four segments from the right, without the port; random-looking ones as ``_``, neighbours of these joined."""
    bare = F.when(F.instr(host, ":") > 0, F.regexp_replace(host, r":[^:]*\z", "")).otherwise(host)
    segments = F.filter(F.reverse(F.split(bare, r"\.")), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("length"), F.lit(False).alias("hidden"), F.lit(False).alias("full"))

    def add(acc: Column, s: Column) -> Column:
        shown = F.when(~s.isin(*HOST_SEGMENTS, *allowed) & random_looking(s), "_").otherwise(s)
        fits = (F.size(acc["kept"]) < 4) & (F.char_length(shown) < LONGEST - acc["length"] - 1)
        skip = acc["full"] | (acc["hidden"] & ((shown == "_") | ~fits))
        kept = F.when(skip, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.when(fits, shown).otherwise("_"))))
        length = F.when(skip | ~fits, acc["length"]).otherwise(acc["length"] + F.char_length(shown) + 1)
        hidden = F.when(acc["full"], acc["hidden"]).otherwise(~fits | (shown == "_"))
        return F.struct(kept.alias("kept"), length.alias("length"), hidden.alias("hidden"), (acc["full"] | ~fits).alias("full"))

    out = F.aggregate(segments, start, add, lambda acc: F.array_join(F.reverse(acc["kept"]), "."))
    return F.when(host.isNotNull(), F.when(out == "", "none").otherwise(out))


def sanitize_header(value: Column) -> Column:
    """Without line breaks."""
    return F.translate(value, "\r\n", "")


def server_group(asg: Column) -> dict[str, Column]:
    """app, cluster, asg, stack, detail, shard1, shard2 and sequence of ``app-stack-detail-v000``; null where absent."""
    body = F.regexp_replace(asg, r"-v[0-9]{3,6}\z", "")  # up to the sequence
    sequence = F.nullif(F.regexp_extract(asg, r"-(v[0-9]{3,6})\z", 1), F.lit(""))
    d1, headless = F.instr(asg, "-"), asg.startswith("-")
    own = lambda c: F.when(~headless & asg.isNotNull(), F.nullif(c, F.lit("")))
    parts = F.split(body, "-", 3)
    detail = own(F.coalesce(F.get(parts, 2), F.lit("")))
    stack = own(F.coalesce(F.get(parts, 1), F.lit("")))

    def shard(n: int) -> Column:
        none = F.struct(F.lit(True).alias("on"), F.lit(None).cast("string").alias("value"))

        def step(acc: Column, s: Column) -> Column:
            on = acc["on"] & s.rlike(r"^x[1-9].")
            return F.struct(on.alias("on"), F.when(on & s.rlike(f"^x{n}[^0-9]"), F.substr(s, F.lit(3))).otherwise(acc["value"]).alias("value"))

        return F.aggregate(F.split(F.coalesce(detail, F.lit("")), "-"), none, step, lambda acc: acc["value"])

    return {
        "app": own(F.when(d1 == 0, asg).otherwise(F.substring_index(asg, "-", 1))),
        "cluster": own(body), "asg": own(asg), "stack": stack, "detail": detail, "shard1": shard(1), "shard2": shard(2), "sequence": sequence,
    }


def decapitalized(v: Column) -> Column:
    """First letter in lower case, unless the first two are capitals."""
    return F.when(v.rlike("^[A-Z]{2}"), v).otherwise(F.concat(F.lower(F.substring(v, 1, 1)), F.substr(v, F.lit(2))))


def substitute(pattern: str, attribute: Callable[[str], Column]) -> Column:
    """``{x}`` by the decapitalised attribute x, ``{raw:x}`` by x as it is; unknown ones stay."""
    out, at = [], 0
    for m in re.finditer(r"\{([^}]*)\}", pattern):
        raw = m[1].startswith("raw:")
        v = attribute(m[1].removeprefix("raw:"))
        out += [F.lit(pattern[at : m.start()]), F.coalesce(v if raw else decapitalized(v), F.lit(m[0]))]
        at = m.end()
    return F.concat(*out, F.lit(pattern[at:])) if out else F.lit(pattern)


def divided(a: Column, b: Column) -> Column:
    """Division as in IEEE 754: by zero gives infinities or NaN."""
    inf = float("inf")
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.when(a > 0, inf).otherwise(-inf))


def arithmetic(expr: str, attribute: Callable[[str], Column]) -> Column:
    """Postfix arithmetic over ``{attributes}`` (missing: NaN) with :add, :sub, :mul, :div and :if-changed."""
    stack: list[Column] = []
    ops = {":add": lambda a, b: a + b, ":sub": lambda a, b: a - b, ":mul": lambda a, b: a * b, ":div": divided}
    for part in filter(None, re.split(r"[,\s]+", expr)):
        if part in ops:
            b, a = stack.pop(), stack.pop()
            stack.append(ops[part](a, b))
        elif part == ":if-changed":
            now, before, number = stack.pop(), stack.pop(), stack.pop()
            stack.append(F.when(now.eqNullSafe(before), F.lit(0.0)).otherwise(number))
        elif part.startswith("{") and part.endswith("}"):
            stack.append(F.coalesce(attribute(part[1:-1]).cast("double"), F.lit(math.nan)))
        else:
            stack.append(F.lit(float(part)))
    return stack[-1]


def named(text: Column, patterns: list[tuple[str, int, dict[str, int]]], role: str = "executor") -> Column:
    """(name, tags) by the first pattern (regex, group of the name, groups of tags) that matches all of ``text``, else null.

    Without a tag ``role`` that tag is ``role``.
    """
    out = None
    for regex, name, groups in patterns:
        full = f"^(?:{regex})\\z"
        tags = F.create_map(*[x for k, g in groups.items() for x in (F.lit(k), F.regexp_extract(text, full, g))], *([] if "role" in groups else [F.lit("role"), F.lit(role)]))
        got = F.struct(F.regexp_extract(text, full, name).alias("name"), tags.alias("tags"))
        out = F.when(text.rlike(full), got) if out is None else out.when(text.rlike(full), got)
    return out


def scaled(name: Column, value: Column, factors: list[tuple[str, float]]) -> Column:
    """-1 means unknown (NaN); other values times the factor of the first pattern found in ``name``."""
    by = F.coalesce(*[F.when(name.rlike(p), F.lit(f)) for p, f in factors], F.lit(1.0))
    return F.when(F.abs(value + 1.0) <= 1e-12, F.lit(math.nan)).otherwise(value * by)


def dotted(name: Column, tags: Column) -> Column:
    """``name.k-v.k-v`` in key order."""
    return F.concat(name, F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(F.lit("."), e["key"], F.lit("-"), e["value"])), ""))


def age_seconds(then_ms: Column, now_ms: Column) -> Column:
    return (now_ms - then_ms) / 1000.0


_DURATION = re.compile(r"(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$")


def duration_ms(text: str) -> int:
    """Milliseconds of an ISO 8601 duration such as ``PT5S``."""
    m = _DURATION.match(text.upper())
    if not m or text.upper().rstrip("T").endswith("P"):
        raise ValueError(f"not a duration: {text!r}")
    d, h, minutes, s = (float(x or 0) for x in m.groups()[1:])
    return int((-1 if m[1] else 1) * 1000 * (((d * 24 + h) * 60 + minutes) * 60 + s))
