"""Filter interaction audit: what each filter removes at every place of every order in which the filters can be applied.

A row's fate under any order follows from the set of filters that it fails, so the table is read once and reduced to mask cells: how many
rows of each part fail exactly which filters. A recursive query then extends prefixes of filters by each letter not yet used; every level
of the recursion joins the cells, carries the bits applied so far and emits the figures of the step that it adds.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WHITE = r"[\x20\x09-\x0D]+"
#: The letter that stands for "the same text occurs under a smaller id"; it needs the whole table, unlike the others.
COPY = "E"
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure condition of each filter that looks at one text alone.

    A: under 200 words; B: fewer than half of the words are different; C: over 2 % of the code points are A-Z; D: one of #$%&*| occurs.
    An empty text fails A alone.
    """
    words = F.filter(F.split(text, WHITE, -1), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200, "B": F.size(F.array_distinct(words)).cast("bigint") * 100 < F.size(words).cast("bigint") * 50,
        "C": capitals.cast("bigint") * 100 > F.length(text).cast("bigint") * 2, "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each source that fail exactly the filters whose bits the mask has; the copy filter's is the last.

    Texts leave the scan as SHA-256 digests and bits. Rows are first counted by digest, source, labels and id, so copies meet in one
    window only as counts, at most one for each source and pair of labels, however large their group is.

    A null text is empty, a null source the part ''. A row without a label is neither good nor toxic; of several labels of an id, any with 1
    counts. An id that occurs twice does not make its own rows copies. A null id is compared with nothing: its row is no copy and
    makes none. Other columns are not read.
    """
    text, names = F.coalesce("text", F.lit("")), {"id": "doc_id", "part": F.coalesce("source", F.lit(""))}
    conditions = text_filters(F.col("text")) if filters is None else filters
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(conditions.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    copy = 1 << len(bits)
    rows = docs.select(F.col(names["id"]).alias("id"), names["part"].alias("part"), text.alias("text")).select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("g"), F.max(F.col("toxic") == 1).alias("t"))
    known = rows.join(marks, "id", "left").select("id", "part", "digest", "mask", F.coalesce("g", F.lit(False)).alias("g"), F.coalesce("t", F.lit(False)).alias("t"))
    group = ["digest", "mask", "part", "g", "t"]
    by_id = known.groupBy(*group, "id").agg(F.count(F.lit(1)).alias("c"))
    groups = by_id.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("c"))).alias("with_id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c"))).alias("first"))
    met = groups.withColumn("smallest", F.min("first.id").over(Window.partitionBy("digest")))
    copies = F.coalesce(F.col("with_id") - F.when(F.col("first.id") == F.col("smallest"), F.col("first.c")).otherwise(0), F.lit(0))
    parted = met.select("part", "mask", "g", "t", F.explode(F.array(F.struct(F.lit(0).alias("bit"), (F.col("n") - copies).alias("n")), F.struct(F.lit(copy).alias("bit"), copies.alias("n")))).alias("x")).filter("x.n > 0")
    n = F.sum("x.n")
    counted = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("x.n"))), F.lit(0)).cast("bigint")
    return parted.groupBy("part", F.col("mask").bitwiseOR(F.col("x.bit")).alias("mask")).agg(n.cast("bigint").alias("n"), counted("g").alias("good"), counted("t").alias("toxic"))


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from mask cells.

    The i-th letter's bit is 1 << i. A part has one row in the recursion for each prefix (325 for five letters), whatever its cells count.
    An empty table of cells gives no rows.
    """
    spark = cells.sparkSession
    packed = common.written(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")), "mask-cells")
    choices = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))
    summed = lambda value, where: f"aggregate(c.cells, 0L, (a, x) -> a + IF({where}, x.{value}, 0L))"
    lost = "x.mask & w.applied = 0 AND x.mask & l.bit <> 0"
    walk = f"""
        WITH RECURSIVE walk(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
            SELECT part, CAST('' AS STRING), 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
            UNION ALL
            SELECT w.part, concat(w.prefix, l.letter), w.applied | l.bit, w.step + 1, {summed("n", "x.mask & (w.applied | l.bit) = 0")}, {summed("n", lost)},
                   {summed("n", "x.mask & w.applied <> 0 AND x.mask & l.bit <> 0")}, {summed("n", "x.mask = l.bit")}, {summed("good", lost)}, {summed("toxic", lost)}
            FROM walk w JOIN {{cells}} c ON c.part = w.part LATERAL VIEW explode(filter(array({choices}), x -> w.applied & x.bit = 0)) v AS l
        ) SELECT * FROM walk WHERE step > 0"""
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")  # the rows are bounded by parts and prefixes, not by a number
    try:
        steps = common.written(spark.sql(walk, cells=packed), "filter-steps")
    finally:
        spark.conf.unset(_ROW_LIMIT) if before is None else spark.conf.set(_ROW_LIMIT, before)
    # a prefix of s letters begins (k - s)! orders
    weight = F.element_at(F.array(*(F.lit(math.factorial(len(letters) - s)) for s in range(1, len(letters) + 1))), F.col("step"))
    letter = F.substring("prefix", -1, 1)
    shares = steps.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * weight).alias("shapley"))
    orders = steps.filter(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    found = orders.join(steps.drop("step", "applied"), ["part", "prefix"]).withColumn("letter", letter).join(shares, ["part", "letter"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E; see `mask_cells` for nulls, copies and repeated ids. Empty documents give no rows."""
    return interactions(mask_cells(docs, labels), "ABCD" + COPY)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
    SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
           regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
lab AS (SELECT doc_id, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id),
m AS (
    SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, count(*) AS n, count(*) FILTER (g) AS good, count(*) FILTER (t) AS toxic
    FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL),
letters AS (SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM range(5) r(i)),
walk AS (
    SELECT '' AS prefix, 0 AS applied, 0 AS step, '' AS letter, 0 AS bit, 0 AS earlier
    UNION ALL SELECT prefix || l.letter, applied | l.bit, step + 1, l.letter, l.bit, applied FROM walk JOIN letters l ON applied & l.bit = 0),
s AS (
    SELECT part, prefix, letter, step, sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM walk, m WHERE step > 0 GROUP BY ALL),
o AS (SELECT prefix AS filter_order FROM walk WHERE step = 5),
r AS (SELECT part, filter_order, s.* EXCLUDE (part) FROM o JOIN s ON starts_with(filter_order, prefix)),
sh AS (SELECT part, letter, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM r JOIN sh USING (part, letter)"""
