"""Mixing sources to target weights.

Targets by source come from weights and from a bound on repetition (water-filling). Each source's rows
are permuted by a keyed hash; their sizes laid end to end in that order form a line, that goes on with the
same rows once more for what a target exceeds the source. The line up to the target is cut into blocks of
equal width, the source's quota. A splitting tree deals the sources' exact block quotas to output shards: at
each node the block counts of all sources are split between both halves by a multivariate hypergeometric
draw, so every shard is a random sample of the whole mix and quotas are met exactly. Each shard then draws
its blocks from the source's blocks in random order (disjoint, as each is dealt once), and its rows are
shuffled locally. A row is taken as often as its blocks were dealt to a shard.

Running sums are taken in two steps (ranges of the hash, then rows in a range), so a source with a third
of all rows is spread over many tasks; ranges grow in number with the rows. The driver holds numbers for each
source and the dealt blocks: ``blocks_per_shard`` for each shard, and one for each source at least. Small tables of
numbers are broadcast up to a fixed number of rows and joined by key beyond (the plan changes, not the result).
Null sources are a source of their own, rows of size 0 are kept with their source, repeated rows are
rows of their own (very many equal ones are told apart by a number), an empty table gives an empty mix.
Columns may have any names but those that are added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashable, materialise, quoted, small, spread_copies
from .sharding import hypergeometric

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(source: str | None) -> tuple:
    """By code point, null last."""
    return source is None, source or ""


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets that add up to ``share`` of all sizes (or all they may): by weight, at most ``most`` times a source's
    size; what is above is shared again by weight among the rest until none is above."""
    out, left, free = {}, share * sum(sizes.values()), dict(weights)
    while free:
        unit = left / sum(free.values())
        full = [s for s, w in free.items() if unit * w > most * sizes[s]]
        if not full:
            return out | {s: unit * w for s, w in free.items()}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            del free[s]
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) for each shard (row); columns add up to ``quotas``, rows differ by one at most."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.array(quotas, dtype=np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        left = np.zeros_like(q)
        rest = int(q.sum())
        for i, x in enumerate(q):  # the multivariate draw, one margin at a time
            rest -= int(x)
            left[i] = hypergeometric(rng, int(x), rest, n)
            n -= int(left[i])
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def quotas(target: list[float], shards: int, blocks_per_shard: int) -> list[int]:
    """Blocks of each source: in proportion to its target, at least one for a target above 0."""
    width = sum(target) / (shards * blocks_per_shard)
    return [max(1, round(t / width)) if t > 0 else 0 for t in target]


def deal(quota: list[int], shards: int, seed: int) -> list[tuple[int, int, int]]:
    """(source, block, shard) of every block: shards draw the tree's numbers of blocks from each source's permuted blocks."""
    tree, rng = splitting_tree(quota, shards, seed), np.random.default_rng(seed + 1)
    out = []
    for i, q in enumerate(quota):
        out += zip([i] * q, rng.permutation(q).tolist(), np.repeat(np.arange(shards), tree[:, i]).tolist())
    return out


#: What ``mix`` adds to the rows.
ADDED = ("__size", "__source_size", "__target", "__takes")


def mix(df: DataFrame, source: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, blocks_per_shard: int = 64, rows_per_range: int = 2_000, seed: int = 11) -> DataFrame:
    """Each row of ``df`` with the part it plays: __size, __source_size, __target, __takes.

    __takes is an array of structs (epoch, block, shard, position): one for each time the mix takes the
    row, empty if it doesn't. ``drawn`` turns that into the mixed rows. Sources weigh ``weights`` in turn.
    """
    if most > 2:
        raise ValueError("a row is taken twice at most")
    if clash := set(ADDED) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    spark, names_in = df.sparkSession, df.columns
    size = words(F.col("text")) if size is None else size
    # inside, the columns of df go by place in a struct: any name may come
    rows = df.select(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names_in)]).alias("row"), F.xxhash64(F.lit(seed), *[F.col(quoted(c)) for c in hashable(df)]).alias("key"), size.cast("long").alias("size"), F.col(quoted(source)).cast("string").alias("src"))
    rows = spread_copies(rows, "key", 4 * rows_per_range)
    total = {r[0]: (int(r[1]), int(r[2] or 0)) for r in rows.groupBy("src").agg(F.count("*"), F.sum("size")).collect()}
    names = sorted(total, key=source_order)
    target = targets({s: total[s][1] for s in names}, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share, most)
    quota = quotas([target[s] for s in names], shards, blocks_per_shard)
    # ranges of the hash, a power of two of them for each source
    bits = [max(0, math.ceil(math.log2(max(1, total[s][0] / rows_per_range)))) for s in names]
    plan = [(s, i, bits[i], total[s][1], float(target[s]), float(target[s] / max(1, quota[i]))) for i, s in enumerate(names)]
    sources = spark.createDataFrame(plan or [(None, -1, 0, 0, 0.0, 0.0)], "s string, i int, bits int, source_size long, target double, width double")
    rows = rows.join(small(sources, len(names)), F.col("src").eqNullSafe(F.col("s"))).drop("s", "src")
    # the range is the top bits of the key, in unsigned order
    rows = rows.withColumn("range", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(key, 64 - bits)")))
    before = Window.partitionBy("ri").orderBy("rr").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("i").alias("ri"), F.col("range").alias("rr")).agg(F.sum("size").alias("n"))
    starts = materialise(sums.select("ri", "rr", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "mix-ranges")
    order = Window.partitionBy("i", "range").orderBy(F.expr("key ^ (-9223372036854775807L - 1L)"), "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("in", F.coalesce(F.sum("size").over(order), F.lit(0))).join(small(starts, starts.count()), (F.col("i") == F.col("ri")) & (F.col("range") == F.col("rr")))
    mid = F.col("before") + F.col("in") + F.col("size") / 2.0
    dealt = deal(quota, shards, seed)
    blocks = spark.createDataFrame(dealt or [(-1, -1, -1)], "di int, db long, shard int")
    takes = []
    for epoch in range(2):
        b, got = f"block{epoch}", f"shard{epoch}"
        laid = laid.withColumn(b, F.when(F.col("width") > 0, F.floor((mid + epoch * F.col("source_size")) / F.col("width"))).otherwise(-1))
        mine = blocks.select("di", "db", F.col("shard").alias(got))
        laid = laid.join(small(mine, len(dealt)), (F.col("i") == F.col("di")) & (F.col(b) == F.col("db")), "left").drop("di", "db")
        takes.append(F.when(F.col(got).isNotNull(), F.struct(F.lit(epoch).alias("epoch"), F.col(b).alias("block"), F.col(got).alias("shard"), F.xxhash64("key", F.lit(seed + 1 + epoch)).alias("position"))))
    takes_of = F.filter(F.array(*takes), lambda x: x.isNotNull())
    return laid.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names_in)], *[c.alias(a) for c, a in zip((F.col("size"), F.col("source_size"), F.col("target"), takes_of), ADDED)])


def drawn(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each time a row is taken, in the order of the mix, with __shard and __position.

    Partitions ascend with (shard, position) and are sorted by it: a shard is a run of rows, shuffled locally.
    A large shard spans several partitions.
    """
    cols = [c for c in mixed.columns if c not in ADDED]
    rows = mixed.select(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(cols)]).alias("row"), F.explode("__takes").alias("t"))
    order = [F.col("t.shard"), F.col("t.position")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)], F.col("t.shard").alias("__shard"), F.col("t.position").alias("__position"))
