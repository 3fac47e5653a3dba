"""Secret spans against Python's regular expressions and a direct computation of entropies."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepwell.llm import queries, secret_scan

from .helpers import EDGE, edge, empty, rows, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def entropy(value, window=20):
    best = 0.0
    for i in range(len(value) - window + 1):
        counts = Counter(value[i : i + window]).values()
        best = max(best, -sum(c / window * math.log2(c / window) for c in counts))
    return best


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_op4_base_spans(spark, small):
    docs = {r["doc_id"]: r["text"] for r in table(small, "documents")}
    got = rows(queries.op4_secret_scan(spark, small))
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        want = base(docs[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in want) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r["spans"].split(","))


@pytest.mark.parametrize("value", ["aGVsbG8gd29ybGQhIHRoaXMgaXMgYSB0ZXN0", "a" * 30, "AbC123" * 10, "0123456789ABCDEFGHIJ", "x1" * 9, ""])
def test_window_entropy(spark, value):
    got = spark.range(1).select(secret_scan.window_entropy(F.lit(value), secret_scan.BASE64_CHARS).alias("e")).first().e
    assert got == pytest.approx(entropy(value), abs=1e-9)


def test_entropy_spans_and_allow_list(spark):
    texts = ["key Zx9Kq2Lm7Pw4Rt8Vb3Nc6Yd1 end", "see 123e4567-e89b-12d3-a456-426614174000 now", "an EXAMPLE: Zx9Kq2Lm7Pw4exampleRt8Vb3Nc6", "yyyyyyyyyyyyyyyyyyyyyyyyy1", "internationalisation-of-words-2024"]
    got = [r["__spans"] for r in rows(secret_scan.scan(spark.createDataFrame([(t,) for t in texts], "text string")))]
    assert [[(s.kind, s.start, s.end) for s in x] for x in got] == [[("entropy-base64", 4, 28)], [], [], [], []]


def candidates(text, rules=secret_scan.EntropyRules()):
    """Entropy spans, said directly."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
        v = m[0]
        if not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or any(re.search(p, v) for p in rules.allow):
            continue
        hexa = re.fullmatch("[0-9a-fA-F]+", v) is not None
        if entropy(v.lower() if hexa else v) >= (rules.hex_bits if hexa else rules.base64_bits):
            out.append((m.start(), 3 if hexa else 4, m.end(), secret_scan.KINDS[3 if hexa else 4]))
    return out


def test_op4_added_spans(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in table(sf, "documents")}
    got, added = rows(queries.op4_secret_scan(spark, sf)), 0
    for r in got:
        text = docs[r["doc_id"]]
        want = sorted(base(text) + candidates(text))
        added += len(want) > len(base(text))
        assert r["spans"] == joined(want)
    assert added


@pytest.mark.parametrize("text", ["ab-" * 100_000 + "1", "a/b_" * 50_000, "a1" * 60_000, "x" * 200_000 + "1", "1" * 100_000 + "a", "password=" + "-a" * 60_000])
def test_very_long_candidates(spark, text):
    got = rows(secret_scan.scan(spark.createDataFrame([(text,)], "text string")).select(secret_scan.joined(F.col("__spans")).alias("s")))[0]["s"]
    assert got == joined(sorted(base(text) + candidates(text)))


def test_awkward_rows(spark):
    got = secret_scan.scan(edge(spark))
    assert got.count() == len(EDGE) and got.where(F.size("__spans") > 0).isEmpty()
    assert rows(secret_scan.scan(empty(spark))) == []
    text = "\U0001f600é password = 'hunter22' " * 2_000
    one = rows(secret_scan.scan(spark.createDataFrame([(text,)], "text string")).select(secret_scan.joined(F.col("__spans")).alias("s"), secret_scan.redact(F.col("text"), F.col("__spans")).alias("t")))[0]
    assert one["s"] == joined(base(text))
    assert one["t"] == ("\U0001f600é [REDACTED]' " * 2_000)


def test_redaction_of_overlapping_spans(spark):
    text = "token=abcdefabcdefabcdefabcdef12 rest"
    got = rows(secret_scan.scan(spark.createDataFrame([(text,)], "text string")).select(secret_scan.redact(F.col("text"), F.col("__spans")).alias("t")))
    assert got[0]["t"] == "[REDACTED] rest"
