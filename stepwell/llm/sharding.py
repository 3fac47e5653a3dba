"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes, in two exchanges. Rows are dealt to blocks by a hash of
their content, so a block holds the same rows in every run and after any lost executor. Of a uniform
random order of all rows, the number of rows of block b among the places of shard c is
hypergeometric; the driver draws that matrix exactly, row by row, from block sizes alone.
Each block is permuted locally (a keyed hash), its rows take the shards the matrix gives them, and
after the exchange each shard is permuted again: by another hash, in ranges of that hash whose sizes are
known from a first pass over the keys alone, so a shard of any size is spread over many tasks.
All work on rows is DataFrame expressions.

Blocks and ranges grow in number with the rows. The matrix has at most ``max_cells`` numbers (the driver's share);
at its default and 16 shards blocks reach 100,000 rows only beyond 26 thousand million rows. Null and repeated rows are rows
like any other; very many rows equal in all columns are told apart by a number; an empty table gives an empty one. Columns
named like the added ones (shard, slot) are refused.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashable, materialise, quoted, small, spread_copies


def even_sizes(total: int, parts: int) -> list[int]:
    """Sizes at most one apart that add up to ``total``."""
    return [(i + 1) * total // parts - i * total // parts for i in range(parts)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, bound: int = 10**9) -> int:
    """How many of ``n`` drawn without replacement are good.

    numpy draws from populations below 10^9; beyond ``bound`` the distribution itself is inverted, over all
    values whose probability a double can tell from zero.
    """
    if not good or not n:
        return 0
    if not bad or n == good + bad:
        return min(good, n)
    if good + bad < bound:
        return int(rng.hypergeometric(good, bad, n))
    everything = good + bad
    mode = (n + 1) * (good + 1) // (everything + 2)
    width = int(40 * math.sqrt(n * (good / everything) * (bad / everything) * (everything - n) / (everything - 1))) + 40
    lo, hi = max(0, n - bad, mode - width), min(good, n, mode + width)
    k = np.arange(lo, hi, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(chances, rng.random() * chances[-1], "right"))


def communication_matrix(blocks: list[int], places: list[int], seed: int, bound: int = 10**9) -> np.ndarray:
    """Exact draw: row b says how many rows of block b go to each shard; column sums are ``places``."""
    if sum(blocks) != sum(places):
        raise ValueError("blocks and places must hold the same number of rows")
    rng, left = np.random.default_rng(seed), [int(x) for x in places]
    out = np.zeros((len(blocks), len(places)), dtype=np.int64)
    rest = sum(left)
    for b, todo in enumerate(blocks):
        others, after = rest, rest - todo
        for c, room in enumerate(left):
            if not todo:
                break
            others -= room
            k = hypergeometric(rng, room, others, todo, bound)
            out[b, c] = k
            left[c] -= k
            todo -= k
        rest = after
    return out


def shard(df: DataFrame, shards: int = 16, seed: int = 7, rows_per_block: int = 256, rows_per_range: int = 2_000, max_cells: int = 1 << 22) -> DataFrame:
    """``df`` with shard (0 to ``shards`` - 1, row counts at most one apart) and slot (gapless from 0)."""
    if clash := {"shard", "slot"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    spark, cols = df.sparkSession, [F.col(quoted(c)) for c in df.columns]
    content = F.xxhash64(F.lit(seed), *[F.col(quoted(c)) for c in hashable(df)]) if df.columns else F.lit(0).cast("long")
    rows = spread_copies(df.withColumn("__key", content), "__key", 4 * rows_per_block)
    total = df.count()
    n_blocks = max(1, min(max_cells // shards, total // rows_per_block))
    block = F.pmod("__key", F.lit(n_blocks)).cast("int").alias("__block")
    sizes = {r[0]: r[1] for r in rows.select(block).groupBy("__block").count().collect()}
    matrix = communication_matrix([sizes.get(b, 0) for b in range(n_blocks)], even_sizes(total, shards), seed)
    ends = spark.createDataFrame([(b, [int(x) for x in row]) for b, row in enumerate(np.cumsum(matrix, axis=1))], "__b int, __ends array<bigint>")
    bits = max(0, math.ceil(math.log2(max(1, total / shards / rows_per_range))))
    again: Column = F.xxhash64("__key", F.lit(seed + 2)).alias("__again")
    # the range is the top bits of that hash, in unsigned order
    of_range = F.lit(0) if not bits else F.expr(f"cast(shiftrightunsigned(__again, {64 - bits}) as int)")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, shards.bit_length())))])
    # binary search: how many shards end at or before this rank
    found = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= shards) & (F.try_element_at("__ends", a + s) <= F.col("__rank")), a + s).otherwise(a))

    def placed(keyed: DataFrame) -> DataFrame:
        local = Window.partitionBy("__block").orderBy(F.xxhash64("__key", F.lit(seed + 1)), "__key")
        ranked = keyed.withColumn("__rank", F.row_number().over(local) - 1).join(small(ends, n_blocks), F.col("__block") == F.col("__b"))
        return ranked.withColumn("shard", found).drop("__ends", "__rank", "__b", "__block").withColumn("__range", of_range)

    # first pass, over keys alone: the sizes of all ranges
    counts = placed(rows.select("__key", block, again)).groupBy(F.col("shard").alias("__s"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select("__s", "__r", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before")), "shard-ranges")
    order = Window.partitionBy("shard", "__range").orderBy(F.expr("__again ^ (-9223372036854775807L - 1L)"), "__key")
    wide = placed(rows.select(*cols, "__key", block, again)).withColumn("__place", F.row_number().over(order) - 1)
    wide = wide.join(small(starts, starts.count()), (F.col("shard") == F.col("__s")) & (F.col("__range") == F.col("__r")))
    return wide.select(*cols, "shard", (F.col("__before") + F.col("__place")).alias("slot"))
