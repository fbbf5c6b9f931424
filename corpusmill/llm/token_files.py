"""Token ids as compressed binary files with a shared dictionary and an offset index.

The files are Parquet rows called segments: runs of documents in ascending id order. A segment holds one zstandard frame per
document, back to back, all made with one dictionary; the index has each document's id, frame offset and number of ids. One short
document is read by one segment row, one slice and one small frame.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pieces import TextEncoder, Vocabulary, tokenizer_path

END_ID = 0
SAMPLE_DOCS, SAMPLE_TEXT_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 8192, 65536, 3
SEGMENT_BYTES = 1 << 20
TEXTS_TOGETHER, CHARS_TOGETHER = 2048, 8_000_000  # a chunk is looked up once in so many texts
CHUNKS_KEPT = 300_000  # entries of one generation of a worker's remembered chunks
SEGMENT = "bucket int, segment int, earlier bigint, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint, width int, dictionary_sha256 string, doc_ids binary, offsets binary, counts binary, frames binary"


class IdEncoder:
    """Texts to serialized ids (little-endian, 2 or 4 bytes each) with the tokenizers library, new chunks of many texts at once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        vocabulary = Vocabulary(path)
        self.width, self.tokenizer = vocabulary.width, Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.texts, self.end = TextEncoder(self._encode, vocabulary, CHUNKS_KEPT, TEXTS_TOGETHER, CHARS_TOGETHER), np.array([END_ID], f"<u{self.width}").tobytes()

    def _encode(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        for packed in self.texts.many(texts):
            yield packed + self.end

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))


def encoder(path: str) -> IdEncoder:
    """The one of this Python worker."""
    return common.kept(f"token files {path}", lambda: IdEncoder(path))


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, text_bytes: int = SAMPLE_TEXT_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from the id arrays of at most `sample_docs` texts of at most `text_bytes` bytes each.

    The sample is those short texts with the smallest hashes, so a rerun takes the same; it bounds only what the dictionary learns
    from, and every document is written with it. Too few or too small texts give no dictionary (empty).
    """
    import zstandard

    short = docs.filter(F.octet_length("text").between(1, text_bytes)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    sample = [encoder(path)(r["text"]) for r in short.orderBy("h", "text").limit(sample_docs).toLocalIterator()]
    try:
        return zstandard.train_dictionary(min(size, max(sum(map(len, sample)) // 8, 256)), sample, k=200, d=8).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def write_ids(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, segment_bytes: int = SEGMENT_BYTES, level: int = LEVEL) -> None:
    """Write under `out` the segments and the dictionary of all texts, in ascending id order.

    Encoding comes before the one exchange, so frames are shuffled, not texts. The exchange deals by buckets of the id whose bounds
    are quantiles of the id column, each bucket to the task of its number; a task writes its segments as rows come in, and each
    segment knows the number of ids before it in its bucket. Very long texts make segments of their own.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(rows, path)
    sha = hashlib.sha256(dictionary).hexdigest()
    n = common.parallelism(spark)
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    edges = np.array(bounds, "i8")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, compress = encoder(path), _compressor(dictionary, level).compress
        for batch in batches:
            counts, frames = [], []
            for ids in encode_text.many(batch.column(1).to_pylist()):
                counts.append(len(ids) // encode_text.width)
                frames.append(compress(ids))
            ids = batch.column(0)
            bucket = np.searchsorted(edges, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), ids, pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["bucket", "doc_id", "n", "frame"])

    width = Vocabulary(path).width

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, at, number, earlier = [], 0, None, 0, 0

        def flush() -> pa.RecordBatch:
            ids, counts, frames = zip(*held, strict=True)
            offsets = np.cumsum([0, *map(len, frames)], dtype="<i8")
            known = [i for i in ids if i is not None]
            row = {"bucket": at, "segment": number, "earlier": earlier, "first_id": min(known, default=None), "last_id": max(known, default=None), "n_docs": len(ids), "n_ids": sum(counts), "width": width, "dictionary_sha256": sha,
                   "doc_ids": _ids_bytes(ids), "offsets": offsets.tobytes(), "counts": np.array(counts, "<i8").tobytes(), "frames": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], _arrow_schema())

        for batch in batches:
            for bucket, doc_id, count, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (bucket != at or held_bytes >= segment_bytes):
                    yield flush()
                    number, earlier = (number + 1, earlier + sum(n for _, n, _ in held)) if bucket == at else (0, 0)
                    held, held_bytes = [], 0
                at = bucket
                held.append((doc_id, count, frame))
                held_bytes += len(frame)
        if held:
            yield flush()

    frames = rows.mapInArrow(encode, "bucket int, doc_id bigint, n bigint, frame binary")
    dealt = frames.repartitionById(n, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"))
    dealt.mapInArrow(segments, SEGMENT).write.option("compression", "none").parquet(f"{out}/segments")
    spark.createDataFrame([(sha, bytearray(dictionary))], "sha256 string, content binary").write.parquet(f"{out}/dictionary")


def _ids_bytes(ids: tuple) -> bytes:
    """The ids as 64-bit integers after a byte for each that says whether it is null."""
    return bytes(i is None for i in ids) + np.array([i or 0 for i in ids], "<i8").tobytes()


def _ids_list(data: bytes, n: int) -> list:
    return [None if null else int(i) for null, i in zip(data[:n], np.frombuffer(data[n:], "<i8"), strict=True)]


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SEGMENT.split(", ")])


def _dictionary(spark: SparkSession, out: str) -> tuple[str, bytes]:
    sha, content = spark.read.schema("sha256 string, content binary").parquet(f"{out}/dictionary").first()
    return sha, bytes(content)


def read_ids(spark: SparkSession, out: str, doc_id: int | None = None, digest_only: bool = False) -> DataFrame:
    """Rows of the files: doc_id, start (ids of all documents before it), n_tokens, ids (or their crc32 as ids_crc32).

    With `doc_id` only the segments that may hold it are read and only its frame is decompressed.
    """
    sha, dictionary = _dictionary(spark, out)
    rows = spark.read.schema(SEGMENT).parquet(f"{out}/segments")
    sums = rows.groupBy("bucket").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each bucket
    bases = sums.select("bucket", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    if doc_id is not None:
        rows = rows.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    # there are as many buckets as shuffle partitions, so their table is small, however many segments there are
    placed = rows.join(F.broadcast(bases), "bucket").select(
        (F.col("_base") + F.col("earlier")).alias("start"), "n_docs", "width", "dictionary_sha256", "doc_ids", "offsets", "counts", "frames"
    )
    last, kind = ("ids_crc32 bigint", pa.int64()) if digest_only else ("ids array<bigint>", pa.list_(pa.int64()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        expand = _decompressor(dictionary).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError("a segment was written with another dictionary")
                n, frames = row["n_docs"], memoryview(row["frames"])
                ids, offsets, counts = _ids_list(row["doc_ids"], n), np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["counts"], "<i8")
                starts = row["start"] + np.cumsum(counts) - counts
                take = [i for i in range(n) if doc_id is None or ids[i] == doc_id]
                values = (np.frombuffer(expand(bytes(frames[offsets[i] : offsets[i + 1]])), f"<u{row['width']}") for i in take)
                found = [zlib.crc32(v.astype("<u4").tobytes()) if digest_only else v.astype("i8") for v in values]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in take], pa.int64()), pa.array(starts[take], pa.int64()), pa.array(counts[take], pa.int64()), pa.array(found, kind)],
                    ["doc_id", "start", "n_tokens", last.split()[0]],
                )

    return placed.mapInArrow(decode, f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def token_file_round_trip(docs: DataFrame, out: str | None = None) -> DataFrame:
    """Write the ids of every whole text (null: empty) with an end id 0, and return what the files hold.

    doc_id, start, n_tokens (with the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit integers). Null ids come
    first; rows that share an id follow each other in any order; an empty table writes empty files.
    """
    out = out or common.new_path(docs.sparkSession, "token-files")
    write_ids(docs, out)
    return read_ids(docs.sparkSession, out, digest_only=True)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(common.documents(spark, sf_dir))
