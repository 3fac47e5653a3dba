"""Sketches kept as tags of plain series: percentile buckets, distinct-count registers, labelled buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 276
REGISTERS = 64
#: A long whose hash under seed 42 is 0, so that Spark's chained hash goes on from seed 0.
SEED_ZERO = -365884300664092260


def boundaries() -> list[int]:
    """Inclusive upper ends of the 276 buckets: 1 to 14, then nine a power of 4 (16 and up) in steps of a third of it."""
    powers = [4**n for n in range(2, 31)]
    return [*range(1, 15), *(p + k * (p // 3) for p in powers for k in range(9)), 2**63 - 1]


def bucket_index(v: Column) -> Column:
    """Bucket of a long: computed from its highest bit, not by searching the boundaries."""
    v = v.cast("long")
    high = F.length(F.bin(v)) - 1
    even = (high - high % 2).cast("int")
    base = F.call_function("shiftleft", F.lit(1).cast("long"), F.when(v > 4, even).otherwise(2))
    offset = F.when(even == 2, 3).otherwise(14 + 9 * (F.floor(even / 2) - 2))
    place = F.call_function("div", v - base, F.call_function("div", base, F.lit(3).cast("long")))
    return F.when(v <= 0, 0).when(v <= 4, v).otherwise(F.least(F.lit(BUCKETS - 1), 1 + place + offset)).cast("int")


def percentile_tags(v: Column, letter: str = "T") -> Column:
    return F.concat(F.lit(letter), F.lpad(F.hex(bucket_index(v)), 4, "0"))


def percentile_counts(df: DataFrame, ids: list[str], amount: str, letter: str = "T", low: int | None = None, high: int | None = None) -> DataFrame:
    """ids, percentile (tag) and count; amounts are clamped to [low, high], negative ones skipped for summaries."""
    v = F.col(amount).cast("long")
    rows = df.where(v >= 0) if letter == "D" else df.where(v.isNotNull())
    if low is not None:
        v = F.greatest(v, F.lit(low))
    if high is not None:
        v = F.least(v, F.lit(high))
    return rows.groupBy(*ids, percentile_tags(v, letter).alias("percentile")).agg(F.count(F.lit(1)).alias("count"))


def percentiles(counts: DataFrame, ids: list[str], wanted: list[float], index: str = "bucket", count: str = "count", longs: bool = True) -> DataFrame:
    """ids and percentiles (array, in the order wanted) by linear interpolation inside a bucket.

    The lower end is that of the bucket before, empty or not. Past the last count the result is the
    largest long (``longs``), or the last bucket that isn't empty. Percentile 0 is 0. Counts meet per id in an array of at most 276.
    """
    usable = F.col(count).cast("double")
    rows = counts.where((usable > 0) & (usable < float("inf")) & ~F.isnan(usable))
    rows = rows.groupBy(*ids, F.col(index).alias("__b")).agg(F.sum(usable).alias("__n"))
    lists = rows.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("__b", "__n"))).alias("c"))
    ends = F.array(*[F.lit(float(x)) for x in boundaries()])
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["__n"])

    def one(p: float) -> Column:
        if p <= 0:
            return F.lit(0.0)  # reached before the first bucket
        zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("prev"), F.lit(None).cast("double").alias("out"))

        def step(a: Column, x: Column) -> Column:
            run = a["run"] + x["__n"]
            share = 100.0 * run / F.col("__total")
            top = F.get(F.col("__ends"), x["__b"])
            low = F.when(x["__b"] == 0, F.lit(0.0)).otherwise(F.get(F.col("__ends"), x["__b"] - 1))
            before = a["prev"]
            hit = low + (top - low) * ((p - before) / (share - before))
            return F.struct(run.alias("run"), share.alias("prev"), F.coalesce(a["out"], F.when(share >= p, hit)).alias("out"))

        tail = F.lit(float(2**63 - 1)) if longs else F.get(F.col("__ends"), F.element_at("c", -1)["__b"])
        return F.aggregate("c", zero, step, lambda a: F.coalesce(a["out"], tail))

    held = lists.withColumn("__total", total).withColumn("__ends", ends)
    return held.select(*ids, F.array(*[one(float(p)) for p in wanted]).alias("percentiles"))


def hash64(v: Column) -> Column:
    """xxHash64 with seed 0 of a long, a string (its UTF-8) or bytes."""
    return F.xxhash64(F.lit(SEED_ZERO), v)


def register(v: Column) -> tuple[Column, Column]:
    """(index 0 to 63, rho 1 to 59) of a value."""
    h = hash64(v)
    rest = F.shiftrightunsigned(h, 6)
    return h.bitwiseAND(F.lit(63)).cast("int"), F.when(rest == 0, 59).otherwise(59 - F.length(F.bin(rest))).cast("int")


def registers(df: DataFrame, ids: list[str], v: Column) -> DataFrame:
    """ids, idx and rho: the highest rho of each register that was hit."""
    idx, rho = register(v)
    return df.where(v.isNotNull()).select(*ids, idx.alias("idx"), rho.alias("rho")).groupBy(*ids, "idx").agg(F.max("rho").alias("rho"))


def register_tag(idx: Column) -> Column:
    return F.concat(F.lit("R"), F.lpad(F.hex(idx), 2, "0"))


def cardinality(regs: DataFrame, ids: list[str]) -> DataFrame:
    """Estimated distinct count from registers; linear counting where few are hit."""
    m = float(REGISTERS)
    got = regs.groupBy(*ids).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("z"), F.count(F.lit(1)).alias("hit"))
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / (F.col("z") + (m - F.col("hit")))
    empty = m - F.col("hit")
    return got.select(*ids, F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw).alias("cardinality"))


def distinct_native(df: DataFrame, ids: list[str], v: Column, error: float = 0.05) -> DataFrame:
    """Spark's own estimate; its sketch has other registers."""
    return df.groupBy(*ids).agg(F.approx_count_distinct(v, error).alias("cardinality"))


#: Units of labels: suffix, size, and the maximum from which the next unit is used.
_S = 1_000_000_000
TIME_UNITS = (("ns", 1, 8_000), ("us", 1_000, 8_000_000), ("ms", 1_000_000, 8 * _S), ("s", _S, 480 * _S), ("min", 60 * _S, 28_800 * _S), ("h", 3_600 * _S, 691_200 * _S), ("d", 86_400 * _S, None))
BYTE_UNITS = (("_B", 1, 10_000), ("_KiB", 1 << 10, 10_000 << 10), ("_MiB", 1 << 20, 10_000 << 20), ("_GiB", 1 << 30, 10_000 << 30), ("_TiB", 1 << 40, 10_000 << 40), ("_PiB", 1 << 50, None))
DECIMAL_UNITS = (("", 1, 10**4), ("_k", 10**3, 10**7), ("_M", 10**6, 10**10), ("_G", 10**9, 10**13), ("_T", 10**12, 10**16), ("_P", 10**15, 10**18), ("_E", 10**18, None))
#: Kind of label: units, label below 0, label above the maximum, whether bounds lie close to the maximum.
LABELS = {
    "age": (TIME_UNITS, "future", "old", False),
    "age_bias_old": (TIME_UNITS, "future", "old", True),
    "latency": (TIME_UNITS, "negative_latency", "slow", False),
    "latency_bias_slow": (TIME_UNITS, "negative_latency", "slow", True),
    "bytes": (BYTE_UNITS, "negative", "large", False),
    "decimal": (DECIMAL_UNITS, "negative", "large", False),
}


def label_bounds(kind: str, most: int) -> list[tuple[int, str]]:
    """Inclusive upper bounds and their labels, written in a unit of the maximum's size with leading zeros."""
    units, _, _, late = LABELS[kind]
    bounds = [most - most // 2, most - most // 4, most - most // 8, most] if late else [most // 8, most // 4, most // 2, most]
    suffix, size, _ = next(u for u in units if u[2] is None or most < u[2])
    # hours from 100 on aren't padded
    width = 1 if suffix == "h" and most >= 100 * size else len(str(most // size))
    return [(b, f"{b // size:0{width}d}{suffix}") for b in bounds]


def bucket_label(v: Column, kind: str, most: int) -> Column:
    """Label of a value among four buckets up to ``most``."""
    _, below, above, _ = LABELS[kind]
    out = F.when(v < 0, below)
    for b, label in label_bounds(kind, most):
        out = out.when(v <= b, label)
    return F.when(v.isNotNull(), out.otherwise(above))


def bucketed(df: DataFrame, ids: list[str], amount: str, kind: str, most: int) -> DataFrame:
    """ids, bucket, count, total and max of each label: counters, timers and summaries by label."""
    v = F.col(amount)
    return df.where(v.isNotNull()).groupBy(*ids, bucket_label(v, kind, most).alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.greatest(v, F.lit(0))).alias("total"), F.max(v).alias("max"))
