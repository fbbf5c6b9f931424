"""Ordered passes over one row's array, for rules in which each item depends on those before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """[emit(state before the item, item)] for each item in order, where `step` gives the state after it and `kind` is the type of what is emitted.

    Results are gathered in chunks, so that a long array is not copied once for every item.
    """
    empty = F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("chunk"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def take(acc: Column, x: Column) -> Column:
        one, full = F.array(emit(acc["state"], x).cast(kind)), F.size(acc["chunk"]) >= _CHUNK
        return F.struct(
            step(acc["state"], x).alias("state"), F.when(full, one).otherwise(F.concat(acc["chunk"], one)).alias("chunk"),
            F.when(full, F.concat(acc["done"], F.array(acc["chunk"]))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(items, empty, take, lambda acc: F.concat(F.flatten(acc["done"]), acc["chunk"]))


def starts(lengths: Column, first: int = 0) -> Column:
    """Where each of some pieces begins, from their lengths."""
    return scan(lengths, F.lit(first), lambda at, n: at + n, lambda at, n: at, "int")
