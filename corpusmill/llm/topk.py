"""Exact top-k inner products: vectors in order of falling length, rotated, pruned by Cauchy-Schwarz bounds on what is left."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, SCALE, EVERY = 10, 1024, 100
SAMPLE, SEEDS = 5000, 1024  # vectors that the rotation is fitted on; longest vectors that give first thresholds
QUERY_BLOCK, STEP, TILE = 32_768, 2048, 256  # queries broadcast at once; vectors and queries multiplied at once
EXACT = 2**53  # sums of doubles below this are exact for integers


def _floors(vectors: list[list[float]], width: int) -> np.ndarray:
    """The scaled components' floors, shorter vectors padded with zeros; Python integers where doubles aren't exact."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * SCALE)
    top = np.abs(out).max(initial=0.0)
    return out if width * top * top < EXACT else np.array([[int(x) for x in row] for row in out.tolist()], object).reshape(out.shape)


def _length(m: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    return np.sqrt((m * m).sum(axis=1))


@dataclass
class Queries:
    ids: np.ndarray
    rows: np.ndarray  # numbers of the vectors' rows; ids may repeat
    vectors: np.ndarray
    limits: np.ndarray  # a score that the k-th best is known to reach


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(queries: Queries, rotation: np.ndarray, cut: int, k: int, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
    """The best k of the batches for each query; vectors come in order of falling length.

    A batch whose longest vector cannot reach a query's limit is skipped for it. For the others the first `cut` rotated
    components give a partial sum, and the rest is at most the product of the two remaining lengths.
    """
    n = len(queries.ids)
    limits, lengths = queries.limits.copy(), _length(queries.vectors)
    turned = queries.vectors.astype(float) @ rotation
    head, rest = turned[:, :cut], _length(turned[:, cut:])
    found_ids = [np.zeros(0, np.int64)] * n
    found_scores = [np.zeros(0, queries.vectors.dtype)] * n
    for rows, ids, vectors in batches:
        size = _length(vectors)
        slack = 1e-9 * size.max(initial=0.0)
        live = np.nonzero(lengths * size.max(initial=0.0) * (1 + 1e-9) + 1 >= limits)[0]
        if not len(live):
            continue
        spun = vectors.astype(float) @ rotation
        first, left = spun[:, :cut].T, _length(spun[:, cut:])
        for at in range(0, len(live), TILE):
            tile = live[at : at + TILE]
            reach = head[tile] @ first + rest[tile][:, None] * left + (slack * lengths[tile] + 1)[:, None]
            may = reach >= limits[tile][:, None]
            may &= rows[None, :] != queries.rows[tile][:, None]
            if may.mean() > 0.05:
                scores = queries.vectors[tile] @ vectors.T
                pick = lambda row, cols: scores[row, cols]  # noqa: E731, B023
            else:
                pick = lambda row, cols: vectors[cols] @ queries.vectors[tile[row]]  # noqa: E731, B023
            for row in np.nonzero(may.any(axis=1))[0]:
                q, cols = tile[row], np.nonzero(may[row])[0]
                both = np.concatenate((found_ids[q], ids[cols])), np.concatenate((found_scores[q], pick(row, cols)))
                keep = _best(*both, k)
                found_ids[q], found_scores[q] = both[0][keep], both[1][keep]
                if len(keep) == k:
                    limits[q] = max(limits[q], float(found_scores[q][-1]))
    for q in range(n):
        for i, s in zip(found_ids[q].tolist(), found_scores[q].tolist()):
            yield int(queries.rows[q]), int(queries.ids[q]), i, max(-(2**63), min(2**63 - 1, int(s)))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id divides by `every`, its k best rows by integer inner product.

    Components are floor(1024 * x) in doubles. Vectors that are null or hold null or non-finite components, and null ids, take
    no part. A shorter vector counts as padded with zeros. A row never meets itself, but others of its id; where an id
    occurs in several rows, each is a query of its own with ranks of its own, and each a candidate. Ties go to the smaller id. Scores beyond a long are cut to its range. An empty table gives an empty result.
    Queries are broadcast in blocks of a fixed number; each block meets all vectors in one pass, in parallel over lengths.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    sound = x.isNotNull() & F.col("id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(sound)
    squares = F.aggregate(F.transform(x, lambda c: F.floor(c * SCALE).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    rows = common.written(rows.withColumn("length", F.sqrt(squares)).withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    schema = "row bigint, query_id bigint, vec_id bigint, score bigint"
    if not width:
        width = 1
    # the rotation only decides how much is pruned
    sample = _floors([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toLocalIterator()], width).astype(float)
    energy, rotation = np.linalg.eigh(sample.T @ sample)
    energy, rotation = energy[::-1], rotation[:, ::-1]
    cut = int(np.searchsorted(np.cumsum(energy), 0.7 * energy.sum())) + 1
    cut = min(max(cut, 1), width)
    longest = [(r["row"], r["v"]) for r in rows.orderBy(F.desc("length"), "id").limit(SEEDS).toLocalIterator()]
    seeds = spark.sparkContext.broadcast((np.array([i for i, _ in longest], np.int64), _floors([v for _, v in longest], width)))

    def first_limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_rows, seed_vectors = seeds.value
        for batch in batches:
            asking, found = batch.column(0).to_numpy(), _floors(batch.column(2).to_pylist(), width)
            limits = []
            for at in range(0, len(asking), TILE):
                scores = (found[at : at + TILE] @ seed_vectors.T).astype(float)
                scores[asking[at : at + TILE][:, None] == seed_rows[None, :]] = -np.inf
                limits += np.sort(scores, axis=1)[:, -k].tolist() if scores.shape[1] >= k else [-np.inf] * len(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(limits, pa.float64())], ["row", "id", "v", "limit"])

    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).select("row", "id", "v")
    asked = asked.mapInArrow(first_limits, "row bigint, id bigint, v array<double>, limit double")
    n_queries = rows.filter(F.pmod("id", F.lit(every)) == 0).count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    asked = common.written(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(2 * blocks - 1)).cast("int")), "queries")
    ordered = rows.repartitionByRange(common.parallelism(spark), F.desc("length")).sortWithinPartitions(F.desc("length"), "id").select("row", "id", "v")
    parts = []
    for block in range(2 * blocks - 1):
        mine = list(asked.filter(F.col("block") == block).toLocalIterator())  # some QUERY_BLOCK rows, by the hash
        if not mine:
            continue
        queries = spark.sparkContext.broadcast(Queries(*(np.array([r[c] for r in mine], np.int64) for c in ("id", "row")), _floors([r["v"] for r in mine], width), np.array([r["limit"] for r in mine])))

        def run(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            def steps() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for batch in batches:
                    for at in range(0, batch.num_rows, STEP):
                        part = batch.slice(at, STEP)
                        yield part.column(0).to_numpy(), part.column(1).to_numpy(), _floors(part.column(2).to_pylist(), width)

            got = list(_search(queries.value, rotation, cut, k, steps()))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(4)], ["row", "query_id", "vec_id", "score"])

        parts.append(ordered.mapInArrow(run, schema))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for more in parts[1:]:
        found = found.union(more)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH v AS (SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY rank <= {K}
"""
