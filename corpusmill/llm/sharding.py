"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters fit.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS, OVERHEAD, TOLERANCE, PROBE_BITS = 24, 8, 0.002, 10
KEYS = ("_k0", "_k1", "_k2")
Key = tuple[int, ...]


def sort_keys(text: Column, doc_id: Column) -> dict[str, Column]:
    """The key, three longs from 0 on: hash of the text, so equal texts lie side by side, hash of the id, which splits a hot
    text, and hash of the row's place in the table, which splits rows that are equal in both."""
    hashes = (F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64(doc_id), F.xxhash64(F.monotonically_increasing_id()))
    return {k: F.shiftrightunsigned(h, 1) for k, h in zip(KEYS, hashes)}


def row_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("bigint")


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probe_bits: int = PROBE_BITS) -> list[Key]:
    """Lower boundaries of the shards after the first, as keys, over `keys` (the key columns and `size`).

    A boundary is looked for between two keys. A round cuts the stretches that hold open boundaries into equal slices and counts
    the exact bytes in each, with its least and greatest key: at most (shards-1) * 2**probe_bits counts come to the driver,
    whatever the input. A boundary is met when a slice's edge lies within `tolerance` of a shard's size from its target, or when
    the target falls inside one row; else its slice, from least to greatest key, is the next stretch. Where all keys of a
    stretch share a component, such as one hot text's hash, the next component is cut.
    """
    head = keys.agg(F.sum("size").alias("total"), F.min(F.struct(*KEYS)).alias("low"), F.max(F.struct(*KEYS)).alias("high")).first()
    if head["total"] is None:
        return [(0,) * len(KEYS)] * (shards - 1)
    slack = tolerance * head["total"] / shards
    targets = [head["total"] * (i + 1) / shards for i in range(shards - 1)]
    start = (tuple(head["low"]), tuple(head["high"]), 0)
    open_at: dict[int, tuple[Key, Key, int]] = dict.fromkeys(range(shards - 1), start)  # least key, greatest key, bytes before
    edges: dict[int, Key] = {}
    while open_at:
        stretches = sorted({(low, high) for low, high, _ in open_at.values()})
        number = slot = F.lit(None).cast("bigint")
        for n, (low, high) in enumerate(stretches):
            level = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), len(KEYS) - 1)
            shift = max(0, (high[level] - low[level]).bit_length() - probe_bits)
            inside = F.col(KEYS[level]).between(low[level], high[level])
            for k, value in zip(KEYS[:level], low):
                inside = inside & (F.col(k) == value)
            number = F.when(inside, F.lit(n).cast("bigint")).otherwise(number)
            slot = F.when(inside, F.shiftright(F.col(KEYS[level]) - low[level], shift)).otherwise(slot)
        counted = keys.select(number.alias("n"), slot.alias("s"), "size", F.struct(*KEYS).alias("key")).filter("n IS NOT NULL")
        rows = counted.groupBy("n", "s").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        slices: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["n"], r["s"])):
            slices.setdefault(r["n"], []).append((r["bytes"], tuple(r["low"]), tuple(r["high"])))
        for i, (low, high, below) in list(open_at.items()):
            for held, first, last in slices[stretches.index((low, high))]:
                if below + held < targets[i] and last != high:
                    below += held
                    continue
                before, after = targets[i] - below, below + held - targets[i]
                if min(abs(before), abs(after)) <= slack or first == last:
                    edges[i] = first if abs(before) <= abs(after) else (*last[:-1], last[-1] + 1)
                    del open_at[i]
                else:
                    open_at[i] = (first, last, below)
                break
    return [edges[i] for i in range(shards - 1)]


def _at_least(edge: Key) -> Column:
    """The row's key >= edge."""
    found = F.col(KEYS[-1]) >= edge[-1]
    for k, value in zip(KEYS[-2::-1], edge[-2::-1]):
        found = (F.col(k) > value) | (F.col(k) == value) & found
    return found


def shard_number(edges: list[Key]) -> Column:
    number = F.lit(0)
    for e in edges:
        number = number + _at_least(e).cast("int")
    return number


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law).

    Size is the text's UTF-8 bytes plus 8; a null or empty text has none. Sizes of shards differ by the tolerance or by one row,
    whichever is larger, so a very long text may fill a shard. Equal texts lie side by side in the order of shards and slots, and so
    share a shard unless a boundary falls inside their group. A null id hashes like any value; repeated rows each get a slot,
    and a group of them is split as any other. Other columns, whatever their names, play no part. An empty table gives an
    empty result. The key table carries no text; texts never move for the splitters.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = common.written(
        docs.select(
            F.col(id_col).alias("id"), row_size(text).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            *[c.alias(k) for k, c in sort_keys(text, F.col(id_col)).items()],
        ),
        "shard-keys",
    )
    placed = keys.withColumn("shard", shard_number(splitters(keys, shards, tolerance)))
    slots = common.ranked(placed, ["shard"], list(KEYS), "slot")
    return slots.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard"
) -> None:
    """Write the rows of `docs` under `path`, one exchange, each shard a folder `shard_col`=number of its own.

    Every column is kept; `docs` must have none that is called `shard_col`.
    """
    if shard_col in docs.columns:
        raise ValueError(f"a column is called {shard_col} already")
    sort = sort_keys(F.col(text_col), F.col(id_col))
    keys = common.written(docs.select(row_size(F.col(text_col)).alias("size"), *[c.alias(k) for k, c in sort.items()]), "shard-keys")
    edges = splitters(keys, shards)
    taken = [k for k in KEYS if k in docs.columns]
    if taken:
        raise ValueError(f"columns {taken} clash with the keys")
    keyed = docs.withColumns(sort).withColumn(shard_col, shard_number(edges))
    out = keyed.repartitionByRange(shards * files_per_shard, shard_col, *KEYS).sortWithinPartitions(shard_col, *KEYS)
    out.drop(*KEYS).write.partitionBy(shard_col).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(common.documents(spark, sf_dir))
