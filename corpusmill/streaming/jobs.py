"""Structured Streaming jobs: files become documents, documents become occurrences, occurrences become counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusmill.operators import analytics, keywords
from corpusmill.sources import files, tables

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
OCCURRENCE = "doc_id bigint, keyword string, extractor string, score double, category string"
COUNTS = "doc_id bigint, keyword string, n bigint"


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Files dropped in a folder as rows; other extensions are skipped, undecodable ones are flagged, not dropped."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).load(folder)
    named = raw.withColumn("filename", F.substring_index("path", "/", -1))
    valid = F.expr("is_valid_utf8(cast(content AS STRING))")
    return files.allowed_files(named).select("path", F.expr("make_valid_utf8(cast(content AS STRING))").alias("text"), F.when(valid, "success").otherwise("failed").alias("parse_status"))


def stream_documents(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


BUCKETS = 64


def _written(spark: SparkSession, table: str) -> set[tuple[int, int]]:
    """(bucket, batch) of all versions still noted; a few for each bucket."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/touched")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return set()
    return {(r.bucket, r.batch) for r in spark.read.schema("bucket int, batch bigint").parquet(f"{table}/touched").collect()}


def _newest(versions: set[tuple[int, int]]) -> dict[int, int]:
    """The last batch of each bucket."""
    return dict(sorted(versions))


def _state(spark: SparkSession, table: str, schema: StructType, versions: dict[int, int]) -> DataFrame:
    """The rows of the given version of each bucket; no file of another version is opened."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{table}/rows/batch={batch}/bucket={bucket}") for bucket, batch in versions.items()]
    found = [p.toString() for p in paths if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]  # a bucket without rows has no folder
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def replace_slices(batch: DataFrame, rows: DataFrame, table: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Write one batch into a table keyed by document: the rows of the batch's documents (doc_id) replace all that the table has of them.

    Documents are dealt into buckets by their id; only buckets with documents of the batch are written anew, under the batch's number. A
    document whose rows are gone is gone from its bucket. A batch that is repeated starts from the versions before it and overwrites its own, so it
    counts once. Versions that two later ones have replaced are removed.
    """
    spark = batch.sparkSession
    place = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    ids = tables.written(batch.select("doc_id").distinct(), "batch-ids")
    hit = [r[0] for r in ids.select(place.alias("bucket")).distinct().collect()]  # at most `buckets` numbers
    if not hit:
        return
    earlier = {v for v in _written(spark, table) if v[1] < batch_id and v[0] in hit}
    before = _newest(earlier)
    merged = _state(spark, table, rows.schema, before).join(ids, "doc_id", "left_anti").select(*rows.columns).unionByName(rows)
    merged.withColumn("bucket", place).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/rows/batch={batch_id}")
    # from here on readers take the new versions
    spark.createDataFrame([(b, batch_id) for b in hit], "bucket int, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{table}/touched/written={batch_id}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket, batch_of in earlier - set(before.items()):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/rows/batch={batch_of}/bucket={bucket}"), True)


def stream_upsert(documents: DataFrame, table: str, checkpoint: str, methods: tuple[str, ...] = ("simple", "pattern")) -> StreamingQuery:
    """Each batch replaces its documents' occurrences in a keyed table; of a document that comes twice in one batch both versions' rows stay."""

    def write(batch: DataFrame, batch_id: int) -> None:
        replace_slices(batch, keywords.multi_extract(batch, list(methods)), table, batch_id)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str, schema: str = OCCURRENCE) -> DataFrame:
    """The table's rows as of its last batch; only the last version of each bucket is read."""
    return _state(spark, table, spark.createDataFrame([], schema).schema, _newest(_written(spark, table)))


def stream_stats(documents: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Counts of words of each document in a keyed table, so that a document that comes again counts with its new text alone; `totals` adds them up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = keywords.tokens(batch).groupBy("doc_id", analytics.norm("w").alias("keyword")).agg(F.count(F.lit(1)).alias("n"))
        replace_slices(batch, counts, table, batch_id)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, table: str) -> DataFrame:
    return latest(spark, table, COUNTS).groupBy("keyword").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))
