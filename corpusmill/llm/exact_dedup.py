"""Exact duplicate removal through a log-structured merge index of text digests.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


class DigestIndex:
    """Sorted runs of (digest, smallest id, count) in the shared folder, merged by compaction.

    `flush` turns one batch into a run: the map-side partial aggregate is the memtable (bounded memory, spills), and its
    merged content is written sorted by digest with a Parquet Bloom filter, so a later probe skips files that cannot hold
    its digest. `compact` replaces all runs with one in which the smallest identifier of each digest stays.
    """

    SCHEMA = "digest binary, head struct<id: bigint, row: bigint>, n bigint"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.runs = spark, []

    def _write(self, entries: DataFrame) -> str:
        path = common.new_path(self.spark, "run")
        (
            entries.sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(path)
        )
        return path

    def flush(self, batch: DataFrame) -> None:
        """`batch`: digest, id, row."""
        head = F.min(F.struct(F.col("id"), F.col("row"))).alias("head")
        self.runs.append(self._write(batch.groupBy("digest").agg(head, F.count(F.lit(1)).alias("n"))))

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*self.runs)

    def compact(self) -> None:
        if len(self.runs) > 1:
            merged = self.entries().groupBy("digest").agg(F.min("head").alias("head"), F.sum("n").alias("n"))
            self.runs = [self._write(merged)]

    def lookup(self, probes: DataFrame) -> DataFrame:
        """Rows of `probes` (with `digest`) that hit, with the merged head and n."""
        self.compact()
        return probes.join(self.entries(), "digest")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    memtables: int = 2,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space. Null text counts as empty.
    Texts of any length are digested whole. The smallest id of a group stays; a null id counts as larger than any other. If several rows share the smallest id,
    exactly one of them is kept. An empty table gives an empty result. Other columns play no part. Each hit is verified on
    bytes: the smallest and the largest text under a digest must be identical; where they differ, the rows under that
    digest are grouped by the text itself.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), normalised(F.col(text_col)).alias("norm"))
    keyed = common.written(
        source.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            digest(F.col("norm")).alias("digest"),
            F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256") if digest is not sha256 else F.lit(None).cast("string").alias("text_sha256"),
        ),
        "keyed",
    )
    # nulls sort first in a minimum; a null id is replaced for the comparison only
    entries = keyed.select("digest", F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "row")
    index = DigestIndex(spark)
    for m in range(memtables):
        index.flush(entries.filter(F.pmod("row", F.lit(memtables)) == m))
    index.compact()
    # byte verification: partial minima and maxima meet per digest, so a hot group costs a row for each map task
    texts = source.select(digest(F.col("norm")).alias("digest"), "norm")
    clashes = (
        texts.groupBy("digest")
        .agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("digest")
    )
    clashes = common.written(clashes, "clashes")
    if not clashes.isEmpty():
        # within a clash the text itself is the key: its digest gets the text appended
        again = docs.select(
            F.monotonically_increasing_id().alias("row"), normalised(F.col(text_col)).alias("norm")
        ).withColumn("digest", digest(F.col("norm")))
        split = again.join(clashes, "digest", "left_semi").select(
            "row", F.concat("digest", F.lit(b"\0"), F.encode("norm", "UTF-8")).alias("longer")
        )
        keyed = common.written(
            keyed.join(split, "row", "left").withColumn("digest", F.coalesce("longer", "digest")).drop("longer"), "keyed"
        )
        index = DigestIndex(spark)
        index.flush(keyed.select("digest", F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "row"))
    hits = index.lookup(keyed)
    return hits.select(
        F.col("id").alias(id_col),
        F.nullif(F.col("head.id"), F.lit(2**63 - 1)).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("head.row")).alias("kept"),
        F.coalesce("text_sha256", F.lower(F.hex("digest"))).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows of `docs` that exact_dedup keeps, all columns unchanged.

    The decision carries the text's digest, so rows sharing an id but not a text are told apart; repeated rows of one id
    and text are the same row, of which one stays. Null texts and empty ones are equal. Other columns may have any names; an
    empty table stays empty.
    """
    id_, sha, key = common.free_names(docs, "id", "sha", "key")
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    tagged = docs.withColumn(key, F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))
    joined = tagged.join(kept, tagged["doc_id"].eqNullSafe(kept[id_]) & (tagged[key] == kept[sha]), "left_semi")
    if common.ids_repeat(docs):
        joined = joined.dropDuplicates(["doc_id", key])
    return joined.select(*docs.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
