"""The publish path: measurements of a short step to batches of consolidated, rolled-up ones.

Each function is a plan over a DataFrame, so that the path runs over a table or inside ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.consolidate import consolidate, kind_of
from ..operators.rollup import Rule, by_rules
from ..sources.sinks import measurement_json, numbered


def prepared(points: DataFrame, step_ms: int, publish_step_ms: int, rules: list[Rule] = (), common: dict[str, str] | None = None, dstype_key: str = "dstype") -> DataFrame:
    """common_tags, name, tags, ts_ms and value: series consolidated by their statistic, then rolled up by ``rules``.

    The longer step must be a multiple of the shorter. Intervals with NaN only send nothing.
    """
    if publish_step_ms % step_ms:
        raise ValueError(f"{publish_step_ms} is no multiple of {step_ms}")
    multiple = publish_step_ms // step_ms
    keyed = points.select("name", F.array_sort(F.map_entries("tags")).alias("__e"), F.col("tags")["statistic"].alias("__stat"), "ts_ms", "value")
    long = consolidate(keyed, ["name", "__e"], step_ms, multiple, kind_of(F.col("__stat"), multiple))
    return by_rules(long.select("name", F.map_from_entries("__e").alias("tags"), "ts_ms", "value"), list(rules), common, dstype_key)


def batched(rows: DataFrame, size: int = 10_000, dstype_key: str = "dstype") -> DataFrame:
    """tags (common, JSON), metrics (JSON array) and n, at most ``size`` rows of equal common tags in each."""
    shared = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("common_tags"))))
    entry = measurement_json(F.col("name"), F.col("tags"), F.col("ts_ms"), F.col("value"), dstype_key=dstype_key)
    flat = rows.select(shared.alias("shared"), entry.alias("entry"))
    made = numbered(flat, size, ["shared", "entry"]).groupBy("shared", "batch").agg(F.array_sort(F.collect_list("entry")).alias("e"))
    return made.select(F.col("shared").alias("tags"), F.concat(F.lit("["), F.array_join("e", ","), F.lit("]")).alias("metrics"), F.size("e").alias("n"))


def publish(points: DataFrame, sink: Callable[[DataFrame], None], step_ms: int, publish_step_ms: int, rules: list[Rule] = (), common: dict[str, str] | None = None, size: int = 10_000) -> None:
    """``sink`` gets all batches of ``points``."""
    sink(batched(prepared(points, step_ms, publish_step_ms, rules, common), size))
