"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import discard, new_path, shared_dir, written  # noqa: F401

_ROW_BITS = 33  # monotonically_increasing_id() keeps the row of a partition in its low 33 bits


_kept: dict[str, Any] = {}  # of this Python worker


def kept(owner: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task of `owner` to the next.

    Workers outlive an operator. So that they never hold the tables of two, what another owner kept goes first.
    """
    if owner not in _kept:
        _kept.clear()
        gc.collect()
        _kept[owner] = make()
    return _kept[owner]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, partitions: int | None = None) -> DataFrame:
    """Add a 0-based gapless row number within `group`, following `order`, without one task per group.

    One range exchange on (group, order) splits any group over as many tasks as its rows need; each partition
    numbers its own rows, and a small table of (partition, group) counts gives the offsets. Rows equal in every
    sort column are numbered in an arbitrary but fixed order, because the numbered rows are written first.
    """
    spark = df.sparkSession
    n = partitions or parallelism(spark)
    keys = [*group, *order]
    numbered = written(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id()),
        "ranked",
    )
    pid = F.shiftright("_row", _ROW_BITS).alias("_pid")
    # a group column may be null; joining on a hash-free struct with <=> keeps such rows
    named = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    firsts = numbered.groupBy(pid, *named).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = firsts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on: Column = F.shiftright(numbered["_row"], _ROW_BITS) == offsets["_pid"]
    for i, c in enumerate(group):
        on = on & numbered[c].eqNullSafe(offsets[f"_g{i}"])
    return numbered.join(offsets, on).select(
        *[numbered[c] for c in df.columns], (F.col("_before") + F.col("_row") - F.col("_first")).alias(rank)
    )


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether any two rows share an id (null counts as one)."""
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A name that no column of `df` has (whatever the case) for each of the wanted ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
