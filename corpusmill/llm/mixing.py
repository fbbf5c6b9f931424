"""Mixing sources to target weights by Pfair windows and earliest-deadline-first.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS, PERIOD, EXPONENT = 16, 1000, 0.5

#: Block k (from 0) of a source with w blocks in a period of p slots may run in slots [release, deadline).
RELEASE, DEADLINE = "CAST(({k}) * p DIV ({w}) AS BIGINT)", "CAST((({k} + 1) * p + ({w}) - 1) DIV ({w}) AS BIGINT)"

#: One period: at each slot, of the sources whose next block is released, the one with the earliest deadline runs.
#: ws: weights in order of source; the state holds how often each ran and who ran in each slot.
_BEST = """array_min(filter(transform(ws, (w, i) -> IF({release} <= t AND st.ran[i] < w, struct({deadline} AS d, i AS i), NULL)), x -> x IS NOT NULL)).i""".format(
    release=RELEASE.format(k="st.ran[i]", w="w"), deadline=DEADLINE.format(k="st.ran[i]", w="w")
)
PATTERN = f"""
aggregate(
  sequence(0L, p - 1),
  named_struct('ran', transform(ws, w -> 0L), 'who', CAST(array() AS ARRAY<INT>), 'now', -1),
  (st0, t) -> aggregate(array(st0), st0, (acc, st) -> named_struct('ran', st.ran, 'who', st.who, 'now', {_BEST}),
    st -> named_struct('ran', transform(st.ran, (r, j) -> IF(j = st.now, r + 1, r)), 'who', concat(st.who, array(st.now)), 'now', st.now)),
  st -> st.who)
"""


def target_weights(docs: DataFrame, weights: dict[str, int] | None, source_col: str, period: int, exponent: float) -> DataFrame:
    """One row per source: source, rows, w (blocks a period), pooled.

    Without given weights each source, however many there are, has a weight of its own: its share of the period goes with its row count
    to the power `exponent`, and it gets one block at least. With given weights all unnamed ones queue up together as one
    pooled source of the total weight 1 (null name, pooled true); none of their rows is lost.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        shares = counts.withColumn("share", F.pow("rows", F.lit(exponent)))
        whole = shares.agg(F.sum("share").alias("whole"))
        named = shares.join(F.broadcast(whole), F.lit(True)).withColumn("w", F.greatest(F.lit(1), F.floor(F.col("share") / F.col("whole") * period)).cast("bigint"))
        return named.select("source", "rows", "w", F.lit(False).alias("pooled"))
    table = docs.sparkSession.createDataFrame([(s, int(w)) for s, w in weights.items()], "source string, w bigint")
    named = counts.join(F.broadcast(table), "source").select("source", "rows", "w", F.lit(False).alias("pooled"))
    rest = counts.join(F.broadcast(named.select(F.col("source").alias("_s"))), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
    pooled = rest.agg(F.sum("rows").alias("rows")).filter("rows > 0").select(F.lit(None).cast("string").alias("source"), "rows", F.lit(1).cast("bigint").alias("w"), F.lit(True).alias("pooled"))
    return named.unionByName(pooled)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    exponent: float = EXPONENT,
) -> DataFrame:
    """One row per input row: id, source, weight, period_slots, block, release, deadline, slot, position.

    Each source's rows, in order of id (null first), are cut into blocks. Block k of a source with w of the period's p slots has
    release floor(k*p/w) and deadline ceil((k+1)*p/w); earliest-deadline-first, ties to the source that sorts first, gives
    it a slot between the two, so a source is never a whole block ahead of or behind its share. As the weights fill
    the period exactly, the schedule repeats each period, and a block's slot follows from one period's pattern. Slots of a
    source that has run out stay empty; `position` (gapless from 0) numbers the rows in order of slot without them. No row is
    dropped or repeated. A null source is a source of its own. Rows that tie on id are ordered arbitrarily. An empty
    table gives an empty result.
    """
    chosen = target_weights(docs, weights, source_col, period, exponent)
    targets = common.written(chosen.coalesce(1), "targets")  # a row for each source
    ordered = F.sort_array(F.collect_list(F.struct("pooled", "source", "w", "rows"))).alias("all")
    plan = targets.agg(ordered).select(
        "all", F.expr("transform(all, x -> x.w)").alias("ws"), F.expr("aggregate(all, 0L, (a, x) -> a + x.w)").alias("p")
    ).filter("p > 0").withColumn("who", F.expr(PATTERN))
    plan = common.written(plan, "mix-period")  # else the optimizer puts the pattern's expression inside the lambda below
    # slots[i]: the slots of source i within a period, in order
    plan = plan.withColumn("slots", F.expr("transform(all, (x, i) -> filter(sequence(0, CAST(p AS INT) - 1), t -> who[t] = i))"))
    plan = common.written(plan.select("all", "p", "slots"), "mix-plan")
    per_source = plan.select("p", F.posexplode("all").alias("i", "x"), "slots").select(
        "p", F.col("x.source").alias("_source"), F.col("x.pooled").alias("_pooled"), F.col("x.w").alias("w"), F.expr("slots[i]").alias("mine")
    )
    named = per_source.filter(~F.col("_pooled")).select(F.col("_source").alias("_named"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source_name"))
    queued = rows.join(F.broadcast(named), F.col("_source_name").eqNullSafe(F.col("_named")), "left")
    # a null source that has a weight matches the null name, so the pool is told by weights, not by null
    has_null = named.filter(F.col("_named").isNull()).select(F.lit(True).alias("_has_null"))
    queued = queued.join(F.broadcast(has_null), F.lit(True), "left").select(
        "_id", "_source_name",
        (F.col("_named").isNull() & ~(F.col("_source_name").isNull() & F.coalesce("_has_null", F.lit(False)))).alias("_pool"),
        F.col("_named").alias("_queue"),
    )
    order = common.ranked(queued, ["_pool", "_queue"], ["_id"], "_rank")
    joined = order.join(F.broadcast(per_source), (F.col("_pool") == F.col("_pooled")) & F.col("_queue").eqNullSafe(F.col("_source")))
    block = F.floor(F.col("_rank") / block_rows).cast("bigint")
    slotted = joined.withColumn("block", block).withColumns({
        "release": F.expr(RELEASE.format(k="block", w="w")),
        "deadline": F.expr(DEADLINE.format(k="block", w="w")),
        "slot": F.expr("block DIV w * p + mine[CAST(block % w AS INT)]"),
    })
    # rows in earlier slots: of each source, its blocks there, but no more rows than it has; one value per block
    ahead = f"""aggregate(zip_with(all, slots, (x, s) -> least(x.rows, {block_rows} * (slot DIV p * x.w + size(filter(s, t -> t < slot % p))))), 0L, (a, n) -> a + n)"""
    blocks = slotted.select("slot").distinct().join(F.broadcast(plan), F.lit(True)).select("slot", F.expr(ahead).alias("_ahead"))
    return slotted.join(blocks, "slot").select(
        F.col("_id").alias(id_col), F.col("_source_name").alias(source_col), F.col("w").alias("weight"), F.col("p").alias("period_slots"),
        "block", "release", "deadline", "slot", (F.col("_ahead") + F.col("_rank") % block_rows).alias("position"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(common.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of `docs`, laid out in the order of the mix: file after file, row after row.

    Rows find their position by id; where rows share an id (nulls count as one id), they are numbered first. Texts of any length and
    other columns of any names stay as they are; an empty table stays empty.
    """
    row, id_, position = common.free_names(docs, "row", "id", "position")
    if not common.ids_repeat(docs):
        positions = common.written(mix_sources(docs).select(F.col("doc_id").alias(id_), F.col("position").alias(position)), "positions")
        placed = docs.join(positions, docs["doc_id"].eqNullSafe(positions[id_]))
    else:
        numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
        positions = mix_sources(numbered, id_col=row).select(F.col(row).alias(id_), F.col("position").alias(position))
        placed = numbered.join(positions, numbered[row] == positions[id_])
    return placed.repartitionByRange(common.parallelism(spark), position).sortWithinPartitions(position).select(*docs.columns)


#: The same schedule from a recursive walk over one period.
ORACLE = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, greatest(1, CAST(floor(pow(n, {EXPONENT}) / (SELECT sum(pow(n, {EXPONENT})) FROM c) * {PERIOD}) AS BIGINT)) AS w,
      row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM c),
p AS (SELECT CAST(sum(w) AS BIGINT) AS p FROM w),
a AS (SELECT list(w ORDER BY i) AS ws FROM w),
walk AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS who, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS ran, ws, CAST(p AS BIGINT) AS p FROM a, p
  UNION ALL
  SELECT t + 1, k.who, list_transform(ran, lambda r, j: CASE WHEN j - 1 = k.who THEN r + 1 ELSE r END), ws, p
  FROM walk, LATERAL (SELECT g.i AS who FROM (SELECT unnest(range(len(ws))) AS i) g
    WHERE ran[g.i + 1] * p // ws[g.i + 1] <= t + 1 AND ran[g.i + 1] < ws[g.i + 1]
    ORDER BY ((ran[g.i + 1] + 1) * p + ws[g.i + 1] - 1) // ws[g.i + 1], g.i LIMIT 1) k
  WHERE t + 1 < p),
pattern AS (SELECT who, t, row_number() OVER (PARTITION BY who ORDER BY t) - 1 AS k FROM walk WHERE t >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents),
s AS (SELECT d.doc_id, d.source, w.w, p.p, d.r, d.r // {BLOCK_ROWS} AS block, w.i FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, p),
x AS (SELECT s.*, block // s.w * p + t AS slot FROM s JOIN pattern ON pattern.who = s.i AND pattern.k = s.block % s.w)
SELECT doc_id, source, w AS weight, p AS period_slots, block, CAST(block * p // w AS BIGINT) AS release,
       CAST(((block + 1) * p + w - 1) // w AS BIGINT) AS deadline, slot,
       row_number() OVER (ORDER BY slot, r) - 1 AS position
FROM x
"""
