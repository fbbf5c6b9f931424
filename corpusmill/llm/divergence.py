"""Source divergence audit: how far each source's terms are from those of the other sources of its language, in exact integers.

The first pass counts in how many documents of a language each term occurs and keeps those in at least three. The kept terms are dealt into
shards, each with a minimal perfect hash that is built in the shard's own task and stores its keys. The second pass broadcasts these hashes,
turns each known token into its slot and increments the slots of the token's (language, source) group; only slots and counts are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .perfect_hash import Shard

LEAST_DOCUMENTS = 3
TERM_RANKS = 200
#: Terms of all languages up to which their hashes are broadcast (some 100 MB in a worker); beyond, tokens are joined with the terms instead.
MOST_BROADCAST = 4_000_000
#: Terms of a shard, fewer where a language has many sources: a shard's task holds a table of its terms by the sources.
SHARD_TERMS, SHARD_CELLS = 50_000, 2_000_000
#: Tokens that a task collects before it counts them by slot, and entries of its document counts before it passes them on.
MOST_TOKENS, MOST_ENTRIES, TEXT_BYTES = 8_000_000, 500_000, 4_000_000
#: Languages up to which a row for each is broadcast.
MOST_LANGUAGES = 100_000
#: As bytes, the letters A-Z and a-z and every code point beyond 0x7F.
_TOKEN = re.compile(rb"[a-z\x80-\xff]+")
_HASHED = 42


def _tokens(text: str) -> list[bytes]:
    return _TOKEN.findall(text.encode().lower())  # lower() of bytes changes A-Z alone


def _clean(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text"))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many of the task's documents each term occurs."""
    found: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, terms in found.items():
            if terms:
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(terms), pa.string()), "term": pa.array(list(terms), pa.binary()).cast(pa.string()), "n": pa.array(list(terms.values()), pa.int64())})
        found.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            found.setdefault(lang, Counter()).update(set(_tokens(text.as_py())))
            if len(found[lang]) > MOST_ENTRIES:
                yield from out()
    yield from out()


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term): terms in three or more documents of a language, by exact counts."""
    counted = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS).select("lang", "term")


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), _HASHED)


def _hashes(lang: str, terms) -> np.ndarray:
    """As xxhash64(lang, term) of the SQL functions."""
    seed, digest = _seed(lang), xxhash.xxh64_intdigest
    return np.fromiter((digest(t, seed) for t in terms), np.uint64, len(terms))


def _build_shard(table: pa.Table) -> pa.Table:
    lang, shard, shards = (table[c][0].as_py() for c in ("lang", "shard", "shards"))
    terms = [t.encode() for t in table["term"].to_pylist()]
    sizes, words, keys, clashing = Shard.pack(terms, _hashes(lang, terms))
    return pa.table({
        "lang": pa.array([lang], pa.string()), "shard": pa.array([shard], pa.int32()), "shards": pa.array([shards], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
        "words": pa.array([words], pa.binary()), "keys": pa.array([keys], pa.list_(pa.binary())), "clashing": pa.array([clashing], pa.int32()),
    })


_SHARDS = "lang string, shard int, shards int, sizes array<int>, words binary, keys array<binary>, clashing int"


def build_shards(terms: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """One row for each shard of a language's terms: the perfect hash's levels and bits, and its keys in slot order."""
    sizes = terms.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_terms).cast("int").alias("shards"))
    small = F.broadcast(sizes) if sizes.count() <= MOST_LANGUAGES else sizes
    dealt = terms.join(small, "lang").withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.col("shards")).cast("int"))
    # dealt by shard, also where the join has dealt by language
    return dealt.repartition("lang", "shard").groupBy("lang", "shard").applyInArrow(_build_shard, _SHARDS)


class _Lookup:
    """The shards of all languages, from one Arrow stream."""

    def __init__(self, stream: bytes):
        self.langs: dict[str, dict[int, Shard]] = {}
        self.shards: dict[str, int] = {}
        for r in pa.ipc.open_stream(stream).read_all().to_pylist():
            self.langs.setdefault(r["lang"], {})[r["shard"]] = Shard(r["sizes"], r["words"], r["keys"], r["clashing"])
            self.shards[r["lang"]] = r["shards"]

    def find(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """shard << 32 | slot of each term, -1 for terms that are not kept."""
        out = np.full(len(terms), -1, np.int64)
        if lang in self.langs:
            hashes, keys = _hashes(lang, terms), np.empty(len(terms), object)
            keys[:] = terms
            shard = hashes.view(np.int64) % self.shards[lang]
            for number, held in self.langs[lang].items():
                mine = np.flatnonzero(shard == number)
                slots = held.find(keys[mine], hashes[mine])
                out[mine] = np.where(slots >= 0, slots | number << 32, -1)
        return out


def _slot_counts(lookup: _Lookup, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, shard, slot, n): the task's occurrences of each kept term in each group."""
    held: dict[tuple[str, str], list[np.ndarray]] = {}
    waiting: dict[str, list[tuple[str, list[bytes]]]] = {}
    n_tokens = n_bytes = 0

    def look_up() -> None:
        for lang, texts in waiting.items():
            terms = list(set().union(*(t for _, t in texts)))
            slot = dict(zip(terms, lookup.find(lang, terms).tolist(), strict=True))
            for source, tokens in texts:
                slots = np.fromiter(map(slot.__getitem__, tokens), np.int64, len(tokens))
                held.setdefault((lang, source), []).append(slots[slots >= 0])
        waiting.clear()

    def out() -> Iterator[pa.RecordBatch]:
        look_up()
        for (lang, source), parts in held.items():
            slots = np.concatenate(parts)
            shards = slots >> 32
            for number in np.unique(shards):
                dense = np.bincount(slots[shards == number] & 0xFFFFFFFF, minlength=lookup.langs[lang][number].n)
                used = np.flatnonzero(dense)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(used), pa.string()), "source": pa.array([source] * len(used), pa.string()), "shard": pa.array(np.full(len(used), number), pa.int32()),
                    "slot": pa.array(used, pa.int32()), "n": pa.array(dense[used], pa.int64()),
                })
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
            tokens = _tokens(text.as_py())
            waiting.setdefault(lang, []).append((source, tokens))
            n_tokens, n_bytes = n_tokens + len(tokens), n_bytes + len(text.as_buffer())
            if n_bytes > TEXT_BYTES:
                look_up()
                n_bytes = 0
            if n_tokens > MOST_TOKENS:
                yield from out()
                n_tokens = n_bytes = 0
    yield from out()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n): the task's occurrences of every term in each group."""
    found: dict[tuple[str, str], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in found.items():
            if terms:
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()), "term": pa.array(list(terms), pa.binary()).cast(pa.string()), "n": pa.array(list(terms.values()), pa.int64())})
        found.clear()

    for batch in batches:
        entries = 0
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
            found.setdefault((lang, source), Counter()).update(_tokens(text.as_py()))
            entries += len(text.as_py())
            if entries > MOST_ENTRIES * 8:
                yield from out()
                entries = 0
    yield from out()


_COUNTS = "lang string, source string, shard int, slot int, n bigint"


def slot_counts(docs: DataFrame, shards: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(lang, source, shard, slot, n): occurrences of each kept term in each group, groups without any left out.

    Up to `most_broadcast` terms, tasks look tokens up in the broadcast hashes. Beyond, each task's counts by term are joined with the terms.
    """
    spark = docs.sparkSession
    if (shards.agg(F.sum(F.size("keys"))).first()[0] or 0) <= most_broadcast:
        sink = pa.BufferOutputStream()
        table = shards.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        counted = docs.mapInArrow(lambda batches: _slot_counts(_Lookup(sent.value), batches), _COUNTS)
    else:
        by_term = docs.mapInArrow(_term_counts, "lang string, source string, term string, n bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        known = shards.select("lang", "shard", F.posexplode("keys").alias("slot", "key")).select("lang", "shard", "slot", F.decode("key", "UTF-8").alias("term"))
        counted = by_term.join(known, ["lang", "term"]).select("lang", "source", "shard", "slot", "n")
    return counted.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def scaled(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(1000000000 * counts / total) by long division in thousands, so that no product leaves 64 bits."""
    whole, rest = np.divmod(counts, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def _compare(key: tuple, counts: pa.Table, shard: pa.Table) -> pa.Table:
    """(lang, source, part, item, value): a shard's share of each pair's sum, and its best terms of each source."""
    lang = key[0].as_py()
    row = shard.slice(0, 1).to_pylist()[0]
    names, totals = [g["source"] for g in row["groups"]], np.array([g["n"] for g in row["groups"]], np.int64)
    keys, v = row["keys"], row["v"]
    table = np.zeros((len(names), len(keys)), np.int64)
    if counts.num_rows:
        at = pc.index_in(counts["source"], pa.array(names, pa.string())).to_numpy()
        table[at, counts["slot"].to_numpy()] = counts["n"].to_numpy()
    q = scaled(table.sum(0) + 1, int(totals.sum()) + v)
    p = scaled(table + 1, (totals + v)[:, None])
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
    for x, name in enumerate(names):
        apart = (np.square(p[x] - p) // p).sum(1)
        others = [y for y in range(len(names)) if y != x]
        found = [("pair", names[y], int(apart[y])) for y in others]
        above = np.flatnonzero((table[x] > 0) & (p[x] > q))
        value = np.square(p[x, above] - q[above]) // q[above]
        if len(above) > TERM_RANKS:
            enough = value >= np.partition(value, -TERM_RANKS)[-TERM_RANKS]
            above, value = above[enough], value[enough]
        best = sorted((-int(f), keys[s]) for f, s in zip(value, above, strict=True))[:TERM_RANKS]
        found += [("term", k.decode(), -f) for f, k in best]
        for part, item, f in found:
            out["source"].append(name), out["part"].append(part), out["item"].append(item), out["value"].append(f)
    return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), **{c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()}})


def divergence(docs: DataFrame, most_broadcast: int = MOST_BROADCAST, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: part `pair` for each other source of its language, `term` for its 200 best terms.

    A null text, language or source is ''. A group without terms has every p = 1 + floor(1000000000 / V); where a language keeps no term
    (V = 0) its pairs have the value 0 and it has no term rows, and a language of one source no pair rows. Equal values are ranked by item in UTF-8
    order. Rows that repeat count each time, texts of any length count whole, empty documents give no rows, other columns are not read.
    A language's pairs are as many as its sources squared, since all are returned.
    """
    docs = _clean(docs)
    groups = common.written(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")), "groups")
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    terms = common.written(kept_terms(docs), "kept-terms")
    shards = common.written(build_shards(terms, min(shard_terms, max(1, SHARD_CELLS // most))), "term-shards")
    counts = common.written(slot_counts(docs, shards, most_broadcast), "slot-counts")
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    listed = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    sizes = shards.groupBy("lang").agg(F.sum(F.size("keys")).alias("v"))
    known = shards.select("lang", "shard", "keys").join(sizes, "lang").join(listed, "lang").repartition("lang", "shard")
    parts = common.written(counts.groupBy("lang", "shard").cogroup(known.groupBy("lang", "shard")).applyInArrow(_compare, "lang string, source string, part string, item string, value bigint"), "divergence")
    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = parts.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= TERM_RANKS)
    return pairs.withColumn("rank", rank).unionByName(best)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(common.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
    SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v) AS p
    FROM kept JOIN gn USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(p.n) + 1)) // (ln.n + v) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM gn GROUP BY lang) ln USING (lang) GROUP BY lang, term, ln.n, v),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
best AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
o AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM best),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""
