r"""Secret scans: known forms, and sliding-window Shannon entropy.

Known forms by regular expression (leftmost, non-overlapping for each kind): ``assign`` (a keyword, a separator
and a value of 6 or more characters), ``access`` (``AKIA`` and capitals or digits, 20 or more in all)
and ``hex`` (24 or more lower-case hexadecimal digits). Besides, candidate strings (runs of 20 or
more characters of the base64 alphabets) are scanned with a window of ``WINDOW`` characters. Counts of
the characters in the window are kept up to date as one character leaves and one enters, and with them
the sum of c * log2(c), which gives the window's entropy. A candidate whose highest window reaches the
threshold of its class (hex or base64) is a secret, unless an allow-list pattern suppresses it or
it lacks letters or digits.

Positions come from what lies between matches (``split``) and the matches themselves, whose running
lengths are summed; all of it is DataFrame expressions on one row, without shuffles.

Spans are in code points, end exclusive. Null texts are empty, empty texts have no spans, texts of any
length are scanned whole, repeated rows are scanned each, other columns are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import running_sum
from .common import quoted

KINDS = ("assign", "access", "hex", "entropy-hex", "entropy-base64")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: For these two, runs that are too short can be left out at once: a longer one never begins inside.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_CHARS, BASE64_CHARS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
WINDOW = 20
#: Counts of at most WINDOW + 1 take five bits; twelve of them fit in a long.
BITS, PER_LONG = 5, 12


@dataclass(frozen=True)
class EntropyRules:
    """Thresholds in bits a character (of at most log2(20) = 4.32), and what is never a secret.

    Repeated groups in ``allow`` must be possessive (``(...)++``): Java's engine recurses once for each
    repetition of any other group, which a long candidate turns into a stack overflow.
    """

    hex_bits: float = 3.0
    base64_bits: float = 3.8
    allow: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
        r"(?i)example|sample|placeholder|changeme|dummy",
        r"^(?:[A-Za-z]++[-_/])++[A-Za-z]*+\d{0,4}$",  # words joined by dashes, paths
        r"^(?:[A-Za-z]{1,40}\d{1,4}|\d++[A-Za-z]{1,4})$",  # a word with a number
    )


def found(values: Column, gaps: Column) -> Column:
    """Matches with their positions: array of (start, end, value), code points, end exclusive.

    ``values``: all matches; ``gaps``: what lies before, between and after them. Both are columns, and
    arguments of the functions here, as a lambda would compute them again for each element.
    """
    lengths = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.char_length(v) + F.char_length(g))
    return F.zip_with(running_sum(lengths), values, lambda e, v: F.struct((e - F.char_length(v)).cast("int").alias("start"), e.cast("int").alias("end"), v.alias("value")))


def window_entropy(value: Column, alphabet: str) -> Column:
    """Highest Shannon entropy (bits) of any ``WINDOW`` characters in a row of ``value``; characters outside count as none.

    The counts are kept in longs of ``PER_LONG`` counts of ``BITS`` bits each, so a step costs the same however many
    characters the alphabet has and however long the value is.
    """
    longs = -(-len(alphabet) // PER_LONG)
    chars = F.filter(F.transform(F.split(value, ""), lambda c: F.when(c != "", F.instr(F.lit(alphabet), c) - 1)), lambda c: c >= 0)
    weight = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(WINDOW + 2)])
    none = F.array_repeat(F.lit(-1), WINDOW)
    # each character that enters, with the one that leaves as it does
    moves = F.zip_with(chars, F.slice(F.concat(none, chars), 1, F.size(chars)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("n"))
    shift = lambda code: (code % PER_LONG) * BITS

    def count(acc: Column, code: Column) -> Column:
        at = F.get(acc["counts"], F.floor(code / PER_LONG).cast("int"))
        return F.call_function("shiftright", at, shift(code)).bitwiseAND((1 << BITS) - 1).cast("int")

    def one(code: Column, k: int) -> Column:
        mine = (code >= k * PER_LONG) & (code < (k + 1) * PER_LONG)
        return F.when(mine, F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, move: Column) -> Column:
        enters, leaves = move["enters"], move["leaves"]
        n_in, n_out = count(acc, enters), count(acc, leaves)
        change = F.when(enters == leaves, F.lit(0.0)).otherwise(F.get(weight, n_in + 1) - F.get(weight, n_in) + F.when(leaves >= 0, F.get(weight, n_out - 1) - F.get(weight, n_out)).otherwise(F.lit(0.0)))
        total = acc["sum"] + change
        counts = F.array(*[F.get(acc["counts"], F.lit(k)) + one(enters, k) - one(leaves, k) for k in range(longs)])
        best = F.when(acc["n"] >= WINDOW - 1, F.greatest(acc["best"], math.log2(WINDOW) - total / WINDOW)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"), (acc["n"] + 1).alias("n"))

    return F.aggregate(moves, zero, step, lambda acc: acc["best"])


def scan(df: DataFrame, text_col: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """``df`` with __spans: array of (start, kind_no, end, kind), by start and then kind as in ``KINDS``."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    tagged = lambda no: lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(KINDS[no]).alias("kind"))
    assign = F.transform(F.filter(F.col("__assign"), lambda s: F.char_length(F.regexp_extract(s["value"], "(?s)^" + ASSIGN, 2)) >= 6), tagged(0))

    def plausible(s: Column) -> Column:
        ok = s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        for p in rules.allow:
            ok = ok & ~s["value"].rlike(p)
        return ok

    def dense(s: Column) -> Column:
        hexa = s["value"].rlike("^[0-9a-fA-F]+$")
        bits = F.when(hexa, window_entropy(F.lower(s["value"]), HEX_CHARS) - rules.hex_bits).otherwise(window_entropy(s["value"], BASE64_CHARS) - rules.base64_bits)
        return bits >= 0

    def entropy_span(s: Column) -> Column:
        no = F.when(s["value"].rlike("^[0-9a-fA-F]+$"), 3).otherwise(4)
        return F.struct(s["start"].alias("start"), no.alias("kind_no"), s["end"].alias("end"), F.get(F.array(*[F.lit(k) for k in KINDS]), no).alias("kind"))

    cols = [F.col(quoted(c)) for c in df.columns]
    step = df.select(*cols, text.alias("__text"))
    patterns = {"__assign": ASSIGN, "__access": ACCESS, "__hex": HEX, "__cand": CANDIDATE}
    step = step.select(*cols, "__text", *[F.regexp_extract_all("__text", F.lit(p), F.lit(0)).alias(f"{k}_values") for k, p in patterns.items()])
    # a text is split only where it has a match
    step = step.select(*cols, *[f"{k}_values" for k in patterns], *[F.when(F.size(f"{k}_values") > 0, F.split("__text", p, -1)).otherwise(F.array().cast("array<string>")).alias(f"{k}_gaps") for k, p in patterns.items()])
    step = step.select(*cols, *[found(F.col(f"{k}_values"), F.col(f"{k}_gaps")).alias(k) for k in patterns])
    step = step.withColumn("__cand", F.filter("__cand", plausible))
    spans = F.concat(assign, F.transform("__access", tagged(1)), F.transform("__hex", tagged(2)), F.transform(F.filter("__cand", dense), entropy_span))
    return step.select(*cols, F.array_sort(spans).alias("__spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``; spans sorted by start."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(26)]), lambda s: s < F.size(spans))
    reach = F.aggregate(steps, F.transform(spans, lambda s: s["end"]), lambda acc, s: F.transform(acc, lambda x, i: F.greatest(x, F.when(i >= s, F.get(acc, i - s)))))
    before = F.slice(F.concat(F.array(F.lit(0)), reach), 1, F.size(spans))
    kept = F.zip_with(spans, before, lambda s, b: F.when(s["start"] >= b, F.concat(F.substring(text, b + 1, s["start"] - b), F.lit(mark))).otherwise(F.lit("")))
    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(text)
