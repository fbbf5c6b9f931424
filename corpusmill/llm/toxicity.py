"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary texts, with shared backoff counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DISCOUNT, ORDER, SHARED_ORDER = 0.75, 8, 2  # longest sequence of characters; up to which length both classes share their counts
CLEAR = 2.0  # a word whose log-likelihood ratio is above this is clearly toxic
TABLE_BITS = 20  # sizes of the hashed count tables: they bound what is broadcast
SAMPLE = 20_000  # labelled documents of each class, at most, that the models and the calibration learn from
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
WORD = re.compile(r"[^\W_]+")
START, END = "\x02", "\x03"
_MEMO = 250_000  # remembered words of a worker


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the character sequences in marked words that end at each character, for lengths 0 to ORDER, and each one's place.

    Row k of the first array has sequences of length k (0: nothing), valid where the place in the word is at least k - 1. The last array
    numbers the word that a character is in.
    """
    data = np.frombuffer("".join([START + w + END for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = np.zeros((ORDER + 1, len(data)), np.uint64)
    for k in range(1, ORDER + 1):
        hashes[k][k - 1 :] = hashes[k - 1][k - 2 : -1 if k > 1 else None] if k > 1 else 0
        hashes[k] = (hashes[k] + data + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(hashes + np.arange(ORDER + 1, dtype=np.uint64)[:, None]), place, word


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


@dataclass
class Models:
    """Kneser-Ney counts by class (0 ordinary, 1 toxic) in tables of fixed size, keyed by hashes of sequence or context."""

    grams: np.ndarray  # [2, 2**TABLE_BITS] count of a sequence
    seen: np.ndarray  # [2, 2**TABLE_BITS] count of a context
    kinds: np.ndarray  # [2, 2**TABLE_BITS] different characters after it

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """For each word the log-likelihood ratio of its characters, toxic to ordinary."""
        hashes, place, word = sequences(words)
        p = np.full((2, len(place)), 1 / 256)
        for k in range(1, ORDER + 1):
            at = np.nonzero(place >= max(k - 1, 1))[0]  # the mark that starts a word is given
            gram, context = _slot(hashes[k][at]), _slot(hashes[k - 1][at - 1] if k > 1 else hashes[0][at])
            for c in (0, 1):
                n, seen, kinds = (t[0] + t[1] if k <= SHARED_ORDER else t[c] for t in ([x[0][i], x[1][i]] for x, i in ((self.grams, gram), (self.seen, context), (self.kinds, context))))
                some = np.maximum(seen, 1)
                mixed = np.maximum(n - DISCOUNT, 0) / some + DISCOUNT * kinds / some * p[c][at]
                p[c][at] = np.where(seen > 0, np.maximum(mixed, 1e-12), p[c][at])
        logs = np.log(p[1]) - np.log(p[0])
        return np.bincount(word, logs, len(words))

    def ratios(self, texts: list[str | None], known: dict[str, float]) -> tuple[list[float], list[float], list[int]]:
        """For each text the mean ratio of its words, the mean excess over CLEAR, and the number of words. `known` remembers words."""
        split = [WORD.findall((t or "").lower()) for t in texts]
        if len(known) > _MEMO:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        for i in range(0, len(new), 20_000):
            known.update(zip(new[i : i + 20_000], self.word_ratios(new[i : i + 20_000]).tolist()))
        found = [list(map(known.__getitem__, words)) for words in split]
        n = [max(len(f), 1) for f in found]
        return [sum(f) / k for f, k in zip(found, n)], [sum([x - CLEAR for x in f if x > CLEAR]) / k for f, k in zip(found, n)], [len(f) for f in found]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, part) of labelled rows outside the held-out part; several labels of one id count as their largest."""
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return rows.withColumn("part", remainder(F.col("doc_id"), FOLDS)).filter(F.col("part") != HELD_OUT)


def _sample(rows: DataFrame, toxic: int, n: int) -> DataFrame:
    return rows.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def _texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample holds at most 2 * SAMPLE short rows, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Models, np.ndarray] | float:
    """The models and the calibration's weights, or the one constant score if a class has no training rows.

    The models count the character sequences of words in as many ordinary as toxic documents. The calibration, on labelled rows that the models have not seen,
    turns the mean ratio and the mean excess of clearly toxic words, plain and times the square root of the length, into a
    probability. Where SAMPLE cuts one class more than the other, the intercept gets the log ratio of the two sampling rates back, so
    that probabilities are those of all labelled rows at any size.
    """
    spark = docs.sparkSession
    rows = common.written(_labelled(docs, labels), "labelled")
    fit, check = rows.filter(F.col("part") != CALIBRATION), rows.filter(F.col("part") == CALIBRATION)
    sizes = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return 1.0 if sizes.get(1) else 0.0
    n = min(SAMPLE, *sizes.values())
    chosen = common.written(_sample(fit, 1, n).union(_sample(fit, 0, n)), "toxicity-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("toxicity", dict)  # the tables of other operators go
        for batch in batches:
            counts = Counter((c, w) for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in WORD.findall((t or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["c", "word", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each sequence, with its context and its own suffix; full: its count is of occurrences."""
        for batch in batches:
            classes, counts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            hashes, place, word = sequences(batch.column(1).to_pylist())
            for k in range(1, ORDER + 1):
                at = np.nonzero(place >= max(k - 1, 1))[0]
                context = hashes[k - 1][at - 1] if k > 1 else hashes[0][at]
                shorter = hashes[k - 2][at - 1] if k > 2 else hashes[0][at]
                full = (place[at] == k - 1) | (k == ORDER)
                columns = [classes[word[at]], hashes[k][at].view("i8"), context.view("i8"), hashes[k - 1][at].view("i8"), shorter.view("i8"), full, counts[word[at]]]
                table = pa.table([pa.array(np.ascontiguousarray(x)) for x in columns], ["c", "gram", "context", "suffix", "shorter", "full", "n"]).append_column("k", pa.array(np.full(len(at), k, np.int32)))
                yield from table.group_by(table.column_names[:6] + ["k"]).aggregate([("n", "sum")]).rename_columns([*table.column_names[:6], "k", "n"]).combine_chunks().to_batches()

    typed = _texts(docs, chosen).select("text", "toxic").mapInArrow(words, "c int, word string, n bigint").groupBy("c", "word").agg(F.sum("n").alias("n"))
    kinds = "c int, gram bigint, context bigint, suffix bigint, shorter bigint, full boolean, k int, n bigint"
    found = common.written(typed.mapInArrow(grams, kinds).groupBy("c", "gram", "context", "suffix", "shorter", "full", "k").agg(F.sum("n").alias("n")), "sequences")
    # below the longest, a sequence counts the different characters that precede it; one at a word's start has none and counts itself
    counted = found.filter("full").select("c", "gram", "context", "n").union(
        found.filter("k > 1").select("c", F.col("suffix").alias("gram"), F.col("shorter").alias("context"), F.lit(1).cast("bigint").alias("n"))
    ).groupBy("c", "gram", "context").agg(F.sum("n").alias("n"))
    counted = common.written(counted, "sequence-counts")

    def table(key: str, value: Column) -> np.ndarray:
        """At most 2 * 2**TABLE_BITS rows come to the driver."""
        slots = counted.groupBy("c", F.col(key).bitwiseAND((1 << TABLE_BITS) - 1).cast("int").alias("k")).agg(value.cast("float").alias("v"))
        out, got = np.zeros((2, 1 << TABLE_BITS), np.float32), slots.toArrow()
        out[got["c"].to_numpy(), got["k"].to_numpy()] = got["v"].to_numpy()
        return out

    models = Models(table("gram", F.sum("n")), table("context", F.sum("n")), table("context", F.count(F.lit(1))))
    whole = {r["toxic"]: r["n"] for r in check.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    check = common.written(_sample(check, 1, SAMPLE).union(_sample(check, 0, SAMPLE)), "calibration-sample")
    seen = ratios(_texts(docs, check).select("doc_id", "text"), models).join(F.broadcast(check.select(F.col("doc_id").alias("id"), "toxic")), "id").toArrow()
    truth = seen["toxic"].to_numpy()
    if truth.size == 0 or truth.min() == truth.max():
        return models, np.array([0.0, 0.0, 1.0, 0.0, 0.0])
    weights = logistic_fit(_features(*(seen[c].to_numpy() for c in ("ratio", "excess", "words"))), truth)
    rate = {c: min(SAMPLE, whole[c]) / whole[c] for c in (0, 1)}
    weights[0] += np.log(rate[0] / rate[1])
    return models, weights


def _features(ratio: np.ndarray, excess: np.ndarray, words: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.minimum(words, 10_000))
    return np.stack([np.ones(len(ratio)), ratio, ratio * root, excess, excess * root], axis=1)


def _logit(weights: np.ndarray) -> Column:
    root = F.sqrt(F.least("words", F.lit(10_000)))
    one, a, b, c, d = (F.lit(float(w)) for w in weights)
    return one + F.col("ratio") * (a + b * root) + F.col("excess") * (c + d * root)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method with damped steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def ratios(docs: DataFrame, models: Models) -> DataFrame:
    """(id, ratio, excess, words) of each row of `docs` (doc_id, text); no shuffle. The broadcast tables have a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("toxicity", dict)  # the tables of other operators go
        known: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ratio, excess, words = shared.value.ratios(part.column(1).to_pylist(), known)
                columns = [part.column(0), pa.array(ratio, pa.float64()), pa.array(excess, pa.float64()), pa.array(words, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "ratio", "excess", "words"])

    return docs.mapInArrow(run, "id bigint, ratio double, excess double, words bigint")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Only `text` enters a score; null and empty texts have ratio 0 and get the score of that. Held out are ids whose crc32 (as
    text) leaves 0 modulo 5; their labels are not read. With no toxic or no ordinary training label all scores are 0 or 1.
    Repeated rows each get a row; very long texts are scored whole; other columns play no part. An empty table gives an empty result.
    """
    two = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    learned = train(two, labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic"))
    if isinstance(learned, float):
        scored = two.select(F.col("doc_id").alias("id"), F.lit(learned).alias("score"))
    else:
        models, weights = learned
        scored = ratios(two, models).select("id", (1 / (1 + F.exp(-_logit(weights)))).alias("score"))
    return scored.select(
        F.col("id").alias(id_col), (remainder(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns unchanged.

    Null and empty texts get the score of no word. Where rows share an id (nulls count as one id), each row's verdict comes from its own
    text. Very long texts are scored whole. Other columns may have any names; an empty table stays empty.
    """
    labels, columns = spark.read.parquet(f"{sf_dir}/labels.parquet"), docs.columns
    id_col = "doc_id"
    row, out = common.free_names(docs, "row", "bad")
    if common.ids_repeat(docs):
        id_col, docs = row, common.written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        two = docs.select("doc_id", "text")
        learned = train(two, labels)
        if isinstance(learned, float):
            return docs.filter(F.lit(learned < 0.5)).select(*columns)
        models, weights = learned
        bad = ratios(docs.select(row, "text"), models).filter(_logit(weights) >= 0).select(F.col("id").alias(out))
    else:
        bad = score_toxicity(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias(out))
    bad = common.written(bad, "toxic")
    return docs.join(bad, docs[id_col].eqNullSafe(bad[out]), "left_anti").select(*columns)
