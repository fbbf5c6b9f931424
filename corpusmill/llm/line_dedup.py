"""Line dedup as an exact set-similarity join: prefixes of rare tokens, sizes, parity bits, verified Jaccard.

All steps are DataFrame operations. A line's tokens are hashed, ordered and summed up within its row, so no token is shuffled but those
of the prefixes; tokens are counted with map-side partial aggregates over a fixed number of hash slots.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

THRESHOLD = (4, 5)  # similarity of 0.8 or more, as a fraction
SLOT_BITS = 20  # tokens are counted by hash slot: any order is right, a rare-first order is fast
HASH_BITS = 56  # of a token's key; the bits above hold the step of its slot's count
ONCE = 1  # the step of a slot that was counted once
NEAR, OFTEN = 6, 25  # by how many prefix tokens a set meets the first ones with them, and the step of 64 times
PLACE_BITS = 23  # of the filter that keeps lines no pair names from being shuffled
NOT_BLANK = ("\t", "\x0b", "\f", "\r")  # white space within a line, other than a blank


def words_of(line: Column) -> Column:
    """The line's tokens, and empty strings among them. Lines with blanks alone are split without a pattern, in a quarter of the time."""
    other = reduce(or_, (F.contains(line, F.lit(c)) for c in NOT_BLANK))
    return F.when(other, F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))


def token_steps(texts: DataFrame) -> DataFrame:
    """One row with an array: by slot of a token's hash, how frequent it is over all `text`, in steps of a quarter of an octave up to 127."""
    words = texts.select(F.explode(words_of(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("word"))
    counts = words.groupBy(_slot(F.xxhash64("word")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.select("slot", F.least(F.lit(127), F.floor(F.log2("n") * 4) + ONCE).cast("tinyint").alias("step")).toArrow()  # a fixed number of slots at most
    steps = np.zeros(1 << SLOT_BITS, np.int8)
    steps[found["slot"].to_numpy()] = found["step"].to_numpy()
    return texts.sparkSession.createDataFrame(pa.table({"steps": pa.ListArray.from_arrays(pa.array([0, len(steps)], pa.int32()), pa.array(steps))}))


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")


def _step(key: Column) -> Column:
    return F.shiftright(key, HASH_BITS)


def _parity(keys: Column) -> Column:
    """64 bits, each turned over by every token that falls on it."""
    bit = lambda key: F.call_function("shiftleft", F.lit(1).cast("bigint"), key.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda bits, key: bits.bitwiseXOR(bit(key)))


def line_keys(texts: DataFrame, steps: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """For each line with tokens: doc, line_no, size (different tokens), k1 and k2 (a digest of the set), b1 and b2 (parity bits), prefix.

    `prefix` has the keys of the rarest tokens, rarest first, as many as a similar set must share one of, less those counted once, which no
    other line has. `texts`: doc, text.
    """
    num, den = threshold
    lines = texts.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    step = lambda h: F.coalesce(F.get("steps", _slot(h)).cast("bigint"), F.lit(0).cast("bigint"))
    key = lambda h: F.call_function("shiftleft", step(h), F.lit(HASH_BITS)).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))
    keys = F.transform(F.array_remove(words_of(F.col("line")), ""), lambda w: key(F.xxhash64(w)))
    keyed = lines.withColumn("steps", steps.scalar()).select("doc", "line_no", F.sort_array(F.array_distinct(keys)).alias("keys"))
    # an array of one element: the keys are worked out once, however often they are named, and what names them is compiled
    sized = keyed.select("doc", "line_no", F.explode(F.array("keys")).alias("keys")).select("doc", "line_no", "keys", F.size("keys").alias("size")).filter("size > 0")
    digests = (F.xxhash64("keys").alias("k1"), F.xxhash64(F.lit(1), "keys").alias("k2"))
    prefix = F.slice("keys", 1, F.col("size") - _at_least(F.col("size"), num, den) + 1)
    upper = F.filter("keys", lambda k: k.bitwiseAND(F.lit(64)) != 0)
    found = sized.select(
        "doc", "line_no", "size", *digests, _parity(F.col("keys")).alias("all"), _parity(upper).alias("b2"), F.filter(prefix, lambda k: _step(k) > ONCE).alias("prefix")
    )
    # 128 bits of two halves: two sets differ in no more bits than in tokens, whatever their size
    return found.select("doc", "line_no", "size", "k1", "k2", F.col("all").bitwiseXOR(F.col("b2")).alias("b1"), "b2", "prefix")


def line_words(line: Column) -> Column:
    """The line's different tokens."""
    return F.array_remove(F.array_distinct(words_of(line)), "")


def _at_least(n: Column, num: int, den: int) -> Column:
    """ceil(n * num / den) of whole numbers."""
    return F.floor((n.cast("bigint") * num + (den - 1)) / den).cast("int")


def _shareable(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Sets that may have a similar one; smaller ones are similar to their copies alone."""
    num, den = threshold
    return sets.filter((F.col("size") >= num // (den - num)) & (F.size("prefix") > 0))


def _room(a: str, b: str, threshold: tuple[int, int]) -> Column:
    """Sizes and bits leave room for the similarity: the bits differ in no more places than the sets may differ in tokens."""
    num, den = threshold
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    need = _at_least(size_a + size_b, num, num + den)
    differ = F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1"))) + F.bit_count(F.col(f"{a}.b2").bitwiseXOR(F.col(f"{b}.b2")))
    return (size_a * den >= size_b * num) & (size_b * den >= size_a * num) & (differ <= size_a + size_b - need * 2)


def near(prefix: Column) -> Column:
    """The tokens by which a set meets the first ones with them: the rarest of those counted often enough for a large group, then others.

    In a large group of near copies the rarest of all are those that a copy alone was given; pairs by rare tokens are few anyway.
    """
    often = F.filter(prefix, lambda k: _step(k) >= OFTEN)
    return F.slice(F.concat(often, F.filter(prefix, lambda k: _step(k) < OFTEN)), 1, NEAR)


def first_pairs(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of each set with the earliest ones of about its size with the tokens `near` names: doc_a, line_a, doc_b, line_b, the earlier set first.

    In a group of near copies these remove all but a few members before any two meet.
    """
    num, den = threshold
    band = F.floor(F.log("size") / float(np.log(den / num)))
    rows = _shareable(sets, threshold).select("doc", "line_no", "size", "b1", "b2", F.explode(near(F.col("prefix"))).alias("token"))
    rows = rows.select("doc", "line_no", "size", "b1", "b2", F.xxhash64("token", band).alias("digest"))
    # one shuffle and one sort by token, where a join with the first ones takes two of each
    of_token = Window.partitionBy("digest").orderBy("doc", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("head", F.first(F.struct("doc", "line_no", "size", "b1", "b2")).over(of_token)).alias("row")
    met = met.filter((F.struct("doc", "line_no") > F.struct("head.doc", "head.line_no")) & _room("head", "row", threshold))
    return met.select(F.col("head.doc").alias("doc_a"), F.col("head.line_no").alias("line_a"), F.col("doc").alias("doc_b"), F.col("line_no").alias("line_b")).distinct()


def candidate_pairs(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of sets (doc, line_no, size, b1, b2, prefix, open) that may be similar and of which the later is open: doc_a, line_a, doc_b, line_b, the earlier set first.

    Sets meet at a shared token of their prefixes; fewer tokens are enough on the side of the smaller set. Pairs go whose sizes or bits
    leave no room, and meetings after which too few tokens are left: similar sets have enough from their first shared token on.
    """
    num, den = threshold
    # the tokens counted once stood before the others: `spare` of them
    length = F.col("size") - _at_least(F.col("size"), num, den) + 1
    short = F.col("size") - _at_least(F.col("size") * 2, num, num + den) + 1
    rows = _shareable(sets, threshold).select("doc", "line_no", "size", "b1", "b2", "open", (length - F.size("prefix")).alias("spare"), short.alias("short"), F.posexplode("prefix").alias("place", "token"))
    before = F.col("place") + F.col("spare")
    left = F.when(F.col("open"), F.col("size") - before).otherwise(before - F.col("size"))  # at least 1; below 0 where the set is not open
    rows = rows.select("token", "doc", "line_no", "size", "b1", "b2", (before < F.col("short")).alias("early"), left.alias("left"))
    a, b = rows.alias("a"), rows.alias("b")
    sa, sb = F.col("a.size"), F.col("b.size")
    first = (F.col("a.doc") < F.col("b.doc")) | (F.col("a.doc") == F.col("b.doc")) & (F.col("a.line_no") < F.col("b.line_no"))
    enough = F.least(F.abs("a.left"), F.abs("b.left")) >= _at_least(sa + sb, num, num + den)
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token")) & F.col("a.early") & ((sa < sb) | ((sa == sb) & first)) & F.when(first, F.col("b.left") > 0).otherwise(F.col("a.left") > 0) & enough & _room("a", "b", threshold),
    )
    pair = lambda x, y: F.struct(F.col(f"{x}.doc").alias("doc_a"), F.col(f"{x}.line_no").alias("line_a"), F.col(f"{y}.doc").alias("doc_b"), F.col(f"{y}.line_no").alias("line_b"))
    return met.select(F.when(first, pair("a", "b")).otherwise(pair("b", "a")).alias("pair")).select("pair.*").distinct()


def _named(places: DataFrame) -> Column:
    """Whether a row's place (doc, line_no) may be one of `places`, by the bits at their slots; false only if it is none."""
    slot = F.shiftrightunsigned(F.xxhash64("doc", "line_no"), 64 - PLACE_BITS)
    within = slot.bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), within)
    found = places.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # a fixed number of words at most
    bits = np.zeros(1 << PLACE_BITS - 6, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    row = places.sparkSession.createDataFrame(pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))}))
    word = F.coalesce(F.get(row.scalar(), F.shiftright(slot, 6).cast("int")), F.lit(0).cast("bigint"))
    return F.call_function("shiftrightunsigned", word, within).bitwiseAND(F.lit(1)) == 1


def later_of_similar(texts: DataFrame, pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The later line (doc, line_no) of each pair whose words have the similarity, as a written table; `pairs` is one, the earlier line first, and goes."""
    num, den = threshold
    wanted = common.written(pairs.select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line_no")).union(pairs.select("doc_b", "line_b")).distinct(), "pair-places")
    lines = texts.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.filter(_named(wanted))  # only spares the shuffle lines; the join decides
    found = common.written(lines.join(wanted, ["doc", "line_no"], "left_semi").select("doc", "line_no", line_words(F.col("line")).alias("words")), "pair-lines")
    left, right = (found.select(F.col("doc").alias(f"doc_{x}"), F.col("line_no").alias(f"line_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    both = pairs.join(left, ["doc_a", "line_a"]).join(right, ["doc_b", "line_b"])
    alike = both.filter(F.size(F.array_intersect("words_a", "words_b")) * (num + den) >= (F.size("words_a") + F.size("words_b")) * num)
    out = common.written(alike.select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line_no")).distinct(), "lines-later")
    common.discard(found, wanted, pairs)
    return out


def with_open(sets: DataFrame, gone: DataFrame) -> DataFrame:
    """`sets` with a column open: not among the places (doc, line_no) of `gone`. Those that the places' bits rule out are not shuffled."""
    named = _named(gone)
    maybe = sets.filter(named).join(gone.withColumn("gone", F.lit(True)), ["doc", "line_no"], "left").withColumn("open", F.col("gone").isNull()).drop("gone")
    return sets.filter(~named).withColumn("open", F.lit(True)).unionByName(maybe)


def similar_lines(texts: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The lines (doc, line_no from 0) of `texts` (doc, text) that have an earlier line of the same tokens or of a Jaccard similarity at the threshold.

    Earlier means a smaller (doc, line_no). Lines of equal token sets are one set, placed where the first of them is. Each set is held
    against the first ones of about its size with some tokens of its prefix; those that these don't remove are held against all that their prefixes leave room for.
    """
    of_set = Window.partitionBy("k1", "k2").orderBy("doc", "line_no")
    keyed = line_keys(texts, token_steps(texts), threshold)
    marked = common.written(keyed.withColumn("copy", F.row_number().over(of_set) > 1).drop("k1", "k2"), "line-sets")
    copies = common.written(marked.filter("copy").select("doc", "line_no"), "line-copies")
    sets = marked.filter("NOT copy").drop("copy")
    gone = later_of_similar(texts, common.written(first_pairs(sets, threshold), "line-pairs"), threshold)
    flagged = common.written(with_open(_shareable(sets, threshold), gone), "line-sets")
    common.discard(marked)
    pairs = common.written(candidate_pairs(flagged, threshold), "line-pairs")
    common.discard(flagged)
    # every copy of a removed set goes too; copies are already there
    return copies.union(gone).union(later_of_similar(texts, pairs, threshold))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_lines, n_removed, removed (line numbers from 0, in order).

    A line goes if an earlier line, in its document or in one with a smaller id, has the same tokens or tokens with a Jaccard similarity
    of 0.8 or more, whether or not that line goes too. Tokens are runs without ASCII white space, case kept. Lines
    without tokens always stay. A null text counts as empty, with one empty line. A null id comes before any other. Rows that
    share an id are told apart by the sha256 of their texts, and equal ones are numbered in any order. Very long texts and lines are
    taken whole. Other columns, whatever their names, play no part. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if common.ids_repeat(rows, "id"):
        rows = common.ranked(rows.withColumn("sha", F.sha2("text", 256)), [], ["id", "sha"], "doc").drop("sha")
    else:
        rows = rows.withColumn("doc", F.coalesce(F.col("id"), F.lit(-(2**63))))
    removed = similar_lines(rows.select("doc", "text"), threshold)
    by_doc = removed.groupBy("doc").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))
    sized = rows.select("doc", "id", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    return sized.join(by_doc, "doc", "left").select(
        F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )


def remove_lines(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the removed lines cut out of their texts; ids must not repeat, other columns may have any names."""
    row, gone = common.free_names(docs, "row", "gone")
    taken = decisions.filter("n_removed > 0").select(F.col(id_col).alias(row), F.col("removed").alias(gone))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i)), "\n")
    joined = docs.join(taken, docs[id_col].eqNullSafe(taken[row]), "left").withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept))
    return joined.select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(common.documents(spark, sf_dir))
    return found.withColumn("removed", F.concat_ws(",", F.transform("removed", lambda i: i.cast("string"))))
