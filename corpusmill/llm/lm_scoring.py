"""Language-model scores by logistic context mixing over the bits of word codes.

Each token is spelled as the bits of a Huffman code over the frequent tokens, so a word costs some ten binary predictions. Three
predictors see a bit's place in the code alone, with the previous token, and with the two before; the latter two keep their counts in
hashed tables of fixed size, filled from all training documents. A gate, chosen by how much the hashed contexts have
seen, selects the weights that mix the predictors; the weights and a last refinement of the probability adapt with each bit.
Rare tokens cost an escape symbol and their share of the rare tokens' counts.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, count_arrays
from .count_arrays import CHUNK
from .toxicity import remainder

FOLDS, HELD_OUT = 7, 2
WEIGHT_FOLDS = 7  # one such part of the training documents adapts the weights, on counts that lack it
FREQUENT = 1 << 16  # tokens with a code of their own: bounds what is broadcast
TABLE_BITS = 21
SEGMENT_TOKENS, BATCH_TOKENS = 128, 150_000  # weights start anew with each segment of a text, so that segments go in step
GATES, INPUTS, BUCKETS = 12, 3, 32
RATE, REFINE_RATE = 0.02, 0.02
END = b"\n"  # no word holds white space


def tokens(text: str | None) -> list[bytes]:
    """ASCII letters in lower case, split at ASCII white space, and one end."""
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


@dataclass
class Code:
    """Huffman code of the frequent tokens and of the escape symbol, the last."""

    symbols: dict[bytes, int]
    start: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, frequent: list[tuple[bytes, int]], rare: int) -> Code:
        counts = [max(n, 1) for _, n in frequent] + [max(rare, 1)]
        heap = [(n, i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        new = len(counts)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = (new, 0), (new, 1)
            heapq.heappush(heap, (a + b, new))
            new += 1
        nodes, bits, lengths = [], [], []
        for i in range(len(counts)):
            path, at = [], i
            while at in up:
                at, bit = up[at]
                path.append((new - 1 - at, bit))  # the root is node 0
            lengths.append(len(path))
            nodes += [n for n, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
        length = np.array(lengths, np.int64)
        return cls({w: i for i, (w, _) in enumerate(frequent)}, np.cumsum(length) - length, length, np.array(nodes, np.uint32), np.array(bits, np.uint8))

    def events(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Of all bits of the texts: node, bit, slots in the two tables; then the number of bits and the symbol of each token."""
        known, escape = self.symbols.get, len(self.symbols)
        symbols = np.array([known(w, escape) for t in texts for w in t], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        one, two = np.roll(symbols, 1), np.roll(symbols, 2)
        starts = np.cumsum(lengths) - lengths
        one[starts], two[starts] = escape + 1, escape + 1
        two[starts[lengths > 1] + 1] = escape + 1
        n = self.length[symbols]
        at = np.repeat((self.start[symbols] - (np.cumsum(n) - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        nodes, bits = self.nodes.take(at), self.bits.take(at)
        del at
        h1 = (one.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h2 = (h1 ^ (two.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        slots = []
        for h in (h1, h2):
            mixed = np.repeat((h >> np.uint64(20)).astype(np.uint32), n)
            mixed ^= nodes * np.uint32(0x85EBCA6B)
            mixed *= np.uint32(0x9E3779B1)
            mixed >>= np.uint32(32 - TABLE_BITS)
            slots.append(mixed.view(np.int32))
        return nodes, bits, slots[0], slots[1], n, symbols


@dataclass
class Tables:
    """By predictor: log odds of a one, and how much was seen, in steps; slots of the first are the code's nodes."""

    odds: list[np.ndarray]
    steps: list[np.ndarray]

    @classmethod
    def of(cls, counts: list[np.ndarray]) -> Tables:
        odds = [np.log((c[1] + 0.4) / (c[0] + 0.4)).astype(np.float32) for c in counts]
        return cls(odds, [np.digitize(c.sum(axis=0), (1, 4, 16)).astype(np.uint8) for c in counts])

    def inputs(self, nodes: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        x = [t.take(i) for t, i in zip(self.odds, (nodes, one, two))]
        return x, self.steps[1].take(one) * np.uint8(3) + np.minimum(self.steps[2].take(two), 2)


def _segments(bits: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First bit and number of bits of each segment; `bits`: of each token, `lengths`: tokens of each text."""
    ends = np.concatenate(([0], np.cumsum(bits)))
    cuts, at = [], 0
    for n in lengths:
        cuts += range(at, at + n, SEGMENT_TOKENS)
        at += n
    first = ends[np.array(cuts, np.int64)]
    return first, np.diff(np.concatenate((first, ends[-1:])))


def mix(x: list[np.ndarray], gates: np.ndarray, bits: np.ndarray, first: np.ndarray, count: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The probability of each actual bit; then weights summed over segments and how often each gate was used.

    Segments advance together, one bit at a time; each adapts its own copy of the weights.
    """
    order = np.argsort(-count, kind="stable")
    first, count, n = first[order], count[order], len(count)
    active = np.searchsorted(-count, -np.arange(count[0] if n else 0), side="left")  # segments with more than t bits
    ends = np.cumsum(active)
    # all bits in the order of steps: every step is then a slice; four bytes a number, as a worker holds some ten such columns
    lane = np.arange(len(bits), dtype=np.int32)
    lane -= np.repeat((ends - active).astype(np.int32), active)
    at = first.astype(np.int32).take(lane)
    at += np.repeat(np.arange(len(active), dtype=np.int32), active)
    inputs, ones = [column.take(at) for column in x], bits.take(at).astype(np.float32)
    lane *= np.int32(GATES)
    lane += gates.take(at)
    slots = lane
    own = [np.tile(column.astype(np.float32), n) for column in weights.T]
    centres = (np.arange(BUCKETS + 1) - BUCKETS / 2) / 2
    refine = np.tile((1 / (1 + np.exp(-centres))).astype(np.float32), n)
    lane_bucket = (np.arange(n) * (BUCKETS + 1)).astype(np.int64)
    seen = np.empty(len(bits), np.float32)
    half, rate, refine_rate, one = np.float32(0.5), np.float32(RATE), np.float32(REFINE_RATE), np.float32(1)
    low, high, two, middle = np.float32(-7.9), np.float32(7.9), np.float32(2), np.float32(BUCKETS / 2 + 0.5)
    begin = 0
    for a, end in zip(active.tolist(), ends.tolist()):
        # in place where it can be: new arrays cost as much as the sums
        slot, y = slots[begin:end].astype(np.int64), ones[begin:end]
        xs = [column[begin:end] for column in inputs]
        ws = [column.take(slot) for column in own]
        z = ws[0] * xs[0]
        z += ws[1] * xs[1]
        z += ws[2] * xs[2]
        np.maximum(z, low, out=z)
        np.minimum(z, high, out=z)
        p = np.negative(z)
        np.exp(p, out=p)
        p += one
        np.divide(one, p, out=p)
        z *= two
        z += middle
        place = z.astype(np.int64)
        place += lane_bucket[:a]
        r = refine.take(place)
        np.add(p, r, out=z)
        np.multiply(z, half, out=seen[begin:end])
        np.subtract(y, p, out=p)
        p *= rate
        for column, w, v in zip(own, ws, xs):
            w += p * v
            column[slot] = w
        np.subtract(y, r, out=z)
        z *= refine_rate
        z += r
        refine[place] = z
        begin = end
    used = np.bincount(slots, minlength=n * GATES).reshape(n, GATES)
    del inputs, slots, lane
    np.subtract(one, seen, out=seen, where=ones == 0)
    out = np.empty(len(bits), np.float32)
    out[at] = seen
    return np.maximum(out, np.float32(1e-6), out=out), np.stack([(c.reshape(n, GATES) * used).sum(axis=0) for c in own], axis=1), used.sum(axis=0)


def _mixed(held: list[list[bytes]], code: Code, tables: Tables, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts' bits: what `mix` gives; then the number of bits and the symbol of each token. All else goes on return."""
    nodes, bits, one, two, n, symbols = code.events(held)
    x, gates = tables.inputs(nodes, one, two)
    del nodes, one, two
    return *mix(x, gates, bits, *_segments(n, [len(t) for t in held]), weights), n, symbols


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of consecutive runs of values."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))[ends]
    return np.diff(np.concatenate(([0.0], total)))


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices with some BATCH_TOKENS tokens each, or one longer text."""
    for batch in batches:
        at, held, n = 0, [], 0
        for i, t in enumerate(batch.column(text)):
            held.append(tokens(t.as_py()))
            n += len(held[-1])
            if n >= BATCH_TOKENS or i == batch.num_rows - 1:
                yield batch.slice(at, len(held)), held
                at, held, n = i + 1, [], 0


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, n) over all `text`; tasks hand over bounded partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                held.update(tokens(t.as_py()))
                if len(held) > 300_000:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_bits(texts: DataFrame, code) -> DataFrame:
    """(part, chunk, counts): zeros and ones of CHUNK slots, summed over all rows of `texts` (text, part).

    Tasks add to arrays of fixed size.
    """
    size = 2 * (2 << TABLE_BITS) + 2 * (FREQUENT + CHUNK)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        nodes_at = 2 * (2 << TABLE_BITS)
        for batch, texts in _batches(batches, 0):
            parts = np.array(batch.column(1).to_pylist(), np.int8)
            for part in set(parts.tolist()):
                nodes, bits, one, two, _, _ = code.value.events([t for t, p in zip(texts, parts) if p == part])
                total = sums.setdefault(part, np.zeros(size, np.uint32))
                for base, slot, n in ((0, one, 1 << TABLE_BITS), (2 << TABLE_BITS, two, 1 << TABLE_BITS), (nodes_at, nodes, FREQUENT + CHUNK)):
                    np.add.at(total, slot + (bits * np.int64(n) + base), np.uint32(1))
        for part, total in sums.items():
            yield from count_arrays.chunks(part, total)

    return count_arrays.summed(texts.mapInArrow(fill, count_arrays.SCHEMA))


def _tables(rows: list) -> Tables:
    """Tables from chunk rows, of which there is a fixed number at most."""
    n = 1 << TABLE_BITS
    total = count_arrays.filled(rows, 2 * (2 << TABLE_BITS) + 2 * (FREQUENT + CHUNK))
    cut = lambda base, n: total[base : base + 2 * n].reshape(2, n).astype(np.float32)
    return Tables.of([cut(4 * n, FREQUENT + CHUNK), cut(0, n), cut(2 * n, n)])


def fit_weights(texts: DataFrame, code, tables) -> np.ndarray:
    """The gates' weights after adapting over all rows of `texts`, averaged over segments."""
    start = np.full((GATES, INPUTS), 0.4, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, uses, now = np.zeros((GATES, INPUTS)), np.zeros(GATES), start
        for _, held in _batches(batches, 0):
            s, u = _mixed(held, code.value, tables.value, now)[1:3]
            sums, uses = sums + s, uses + u
            now = np.where(uses[:, None] > 0, sums / np.maximum(uses, 1)[:, None], start)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(GATES, dtype=np.int32), INPUTS)), pa.array(np.tile(np.arange(INPUTS, dtype=np.int32), GATES)), pa.array(sums.ravel()), pa.array(np.repeat(uses, INPUTS))], ["gate", "input", "total", "uses"])

    got = texts.mapInArrow(run, "gate int, input int, total double, uses double").groupBy("gate", "input").agg(F.sum("total").alias("total"), F.sum("uses").alias("uses"))
    weights = start.copy()
    for r in got.collect():  # one row for each weight
        if r["uses"]:
            weights[r["gate"], r["input"]] = r["total"] / r["uses"]
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Training documents are those whose crc32 of the id as text leaves other than 2 modulo 7 (a null id counts as empty text). A null
    text is empty and holds the end token alone. `base_score` has the add-one unigram log10 probabilities; `score` is the mixed
    model's log10 probability; bits_per_byte its cost over the UTF-8 bytes and the end. Repeated rows each get a row. An empty
    table gives an empty result; with no training rows every token is rare and unseen.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), remainder(F.col(id_col), FOLDS).cast("int").alias("part"))
    training = rows.filter(F.col("part") != HELD_OUT)
    counts = common.written(count_tokens(training.select("text")), "token-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toLocalIterator()]
    rare_n, rare_v = total["n"] - sum(n for _, n in frequent), total["v"] - len(frequent)
    log_base = np.log10(total["n"] + total["v"] + 1)
    log_rare = np.log10(rare_n + rare_v + 1)
    context = spark.sparkContext
    code = context.broadcast(Code.of(frequent, rare_n))
    logs = context.broadcast(np.append(np.log10(np.array([n for _, n in frequent]) + 1.0) - log_base, 0.0))  # a rare token's comes later
    learned = training.select("text", (remainder(F.col("id"), WEIGHT_FOLDS) == 0).cast("int").alias("part"))
    chunks = common.written(count_bits(learned, code), "bit-counts").collect()  # a fixed number of chunks, two parts
    first = context.broadcast(_tables([r for r in chunks if r["part"] == 0]))
    weights = fit_weights(learned.filter("part = 1").select("text"), code, first)
    first.unpersist()
    tables = context.broadcast(_tables(chunks))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = len(logs.value) - 1
        for batch, held in _batches(batches, 2):
            p, _, _, n, symbols = _mixed(held, code.value, tables.value, weights)
            lengths = np.array([len(t) for t in held], np.int64)
            ends = np.cumsum(lengths)
            model = _sums(np.log10(p, out=p), np.cumsum(n)[ends - 1])
            del p
            base, seen = _sums(logs.value[symbols], ends), _sums(symbols != escape, ends)
            rare: list[Counter] = [Counter() for _ in held]
            text, ends_list = 0, ends.tolist()
            for at in np.nonzero(symbols == escape)[0].tolist():
                while at >= ends_list[text]:
                    text += 1
                rare[text][held[text][at - ends_list[text]]] += 1  # counted from the end
            size = [len((t.as_py() or "").encode()) + 1 for t in batch.column(2)]
            kind = pa.list_(pa.struct([("word", pa.binary()), ("m", pa.int64())]))
            rare_rows = pa.array([[{"word": w, "m": m} for w, m in r.items()] for r in rare], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(lengths), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(model), pa.array(size, pa.int64()), rare_rows],
                ["row", "id", "part", "n_tokens", "seen", "base", "model", "size", "rare"],
            )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text", "part")
    scored = common.written(numbered.mapInArrow(score, "row bigint, id bigint, part int, n_tokens bigint, seen bigint, base double, model double, size bigint, rare array<struct<word: binary, m: bigint>>"), "scored")
    for used in (code, logs, tables):
        used.unpersist()
    parts = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.m")
    c = F.coalesce("n", F.lit(0))
    sums = (
        parts.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("m") * F.log10(c + 1)).alias("logs"), F.sum("m").alias("rare_tokens"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("rare_seen"))
    )
    zero = F.lit(0)
    tokens_rare, value = F.coalesce("rare_tokens", zero), F.coalesce("logs", F.lit(0.0))
    out = scored.drop("rare").join(sums, "row", "left")
    score_col = F.col("model") + value - tokens_rare * float(log_rare)
    return out.select(
        F.col("id").alias(id_col),
        (F.col("part") == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("seen") + F.coalesce("rare_seen", zero)).alias("n_known"),
        F.lit(total["n"]).cast("bigint").alias("train_tokens"),
        (F.col("base") + value - tokens_rare * float(log_base)).alias("base_score"),
        score_col.alias("score"),
        (-score_col / float(np.log10(2)) / F.col("size")).alias("bits_per_byte"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(common.documents(spark, sf_dir))
