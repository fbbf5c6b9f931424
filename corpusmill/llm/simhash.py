"""SimHash near-duplicates: fingerprints linked through BK-trees of bounded shards, then connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS, RADIUS, SEED, BITS = 3, 2, 42, 64
SHARD_ROWS = 2048  # a larger shard is split
HASHES = 1 << 16  # of a text, held at once


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no word."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined, n = b" ".join(words), max(1, len(words) - shingle_words + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + HASHES], last[at : at + HASHES])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class BkTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's node; its place is found by following the one edge of its distance at each node."""
        node, new = 0, len(self.values)
        while self.values:
            distance = (self.values[node] ^ value).bit_count()
            if distance == 0:
                return node
            child = self.children[node].get(distance)
            if child is None:
                self.children[node][distance] = new
                break
            node = child
        self.values.append(value)
        self.children.append({})
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most `radius` from the value; only edges whose distance lies within the radius are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            todo += [c for d, c in self.children[node].items() if distance - radius <= d <= distance + radius]
        return found


def tree_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius: a spanning forest, fewer links than values."""
    tree, parent, links = BkTree(), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        near = tree.within(value, radius)
        node = tree.add(value)
        if node < len(parent):
            continue
        parent.append(node)
        for other in near:
            a, b = root(node), root(other)
            if a != b:
                parent[a] = b
                links.append((value, tree.values[other]))
    return links


def _fields(n_bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of `parts` fields that cover n_bits."""
    edges = [n_bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links_within(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that keep all connections at `radius` or fewer differing bits.

    Fingerprints are sharded by radius + 1 bit fields: two that differ in at most `radius` bits agree in one whole field. A
    shard with more than `shard_rows` rows is sharded again by the fields of its other bits, for which the same holds, until its
    rows share all but a few bits and, being distinct, cannot be many: no tree outgrows a task, whatever the data. Each
    shard's BK-tree lives in the task that holds the shard.
    """
    parts = radius + 1
    n = common.parallelism(fps.sparkSession)
    # `rest`: the bits not yet fixed, right-aligned; `shard`: the fields fixed so far
    todo = fps.select("fp", F.lit("").alias("shard"), F.col("fp").alias("rest"))
    ready, width = [], BITS
    while True:
        sharded = todo.select(
            "fp",
            F.explode(F.array(*[
                F.struct(
                    F.concat_ws("/", F.col("shard"), F.lit(str(i)), F.shiftrightunsigned("rest", first).bitwiseAND((1 << bits) - 1).cast("string")).alias("shard"),
                    _without(F.col("rest"), first, bits).alias("rest"),
                )
                for i, (first, bits) in enumerate(_fields(width, parts))
            ])).alias("s"),
        ).select("fp", "s.shard", "s.rest")
        width -= min(bits for _, bits in _fields(width, parts))  # a longer field leaves a zero on top
        sharded = common.written(sharded, "shards")
        sizes = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if (1 << width) <= shard_rows:
            ready.append(sharded.join(sizes, "shard").select("shard", "fp"))
            break
        sizes = common.written(sizes, "shard-sizes")
        ready.append(sharded.join(sizes.filter(F.col("n") <= shard_rows), "shard").select("shard", "fp"))
        large = sizes.filter(F.col("n") > shard_rows)
        if large.isEmpty():
            break
        todo = sharded.join(large, "shard").select("fp", "shard", "rest")
    shards = ready[0]
    for more in ready[1:]:
        shards = shards.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> pa.RecordBatch:
            links = tree_links(held, radius)
            return pa.RecordBatch.from_arrays([pa.array(np.array([x[i] for x in links], "u8").view("i8"), pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for shard, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != at:
                    if len(held) > 1:
                        yield flush()
                    at, held = shard, []
                held.append(fp & (2**64 - 1))
        if len(held) > 1:
            yield flush()

    dealt = shards.repartition(n, "shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _without(value, first: int, bits: int):
    """The value with the field cut out and the bits above moved down."""
    low = value.bitwiseAND((1 << first) - 1) if first else F.lit(0).cast("bigint")
    high = F.shiftleft(F.shiftrightunsigned(value, first + bits), first) if first + bits < BITS else F.lit(0).cast("bigint")
    return low.bitwiseOR(high)


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): each node of the links (a, b) with the smallest node that it is connected to.

    Each round replaces a node's links with links to its smallest neighbour, first from its larger neighbours, then from
    all; the number of links never grows, and stars remain. Rounds are written tables, so nothing gathers on the driver.
    """
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.written(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        small = common.written(small.filter("u <> v").distinct(), "small-star")
        same = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        if small.agg(F.count(F.lit(1)), same).first() == edges.agg(F.count(F.lit(1)), same).first():
            break
        edges = small
    else:
        raise RuntimeError("connected components need more rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    Null and empty texts, and texts of white space alone, have fingerprint zero and link like any other. Equal fingerprints are one
    node, so copies cost one shard row however many they are. A null id never is a component's smallest unless all are
    null. Repeated rows each get a row; very long texts are hashed whole, some shingles at a time. Other columns, whatever their
    names, play no part. An empty table gives an empty result.
    """
    found = common.written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = common.written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(links_within(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    return found.join(named, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id.

    Fingerprints, three-word shingles and radius are those of `near_duplicates`: copies with few changed words go, while most pairs of a
    Jaccard similarity of 0.8 to 0.95 differ in more bits and stay.

    Where rows share an id (nulls count as one id), rows are numbered, and the first of a component stays. Texts without words are one
    component. Other columns may have any names; an empty table stays empty.
    """
    id_col, columns = "doc_id", docs.columns
    row, out = common.free_names(docs, "row", "gone")
    if common.ids_repeat(docs):
        id_col, docs = row, common.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(docs, id_col)
    gone = found.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(out))
    return docs.join(gone, docs[id_col].eqNullSafe(gone[out]), "left_anti").select(*columns)
