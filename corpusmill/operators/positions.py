"""Lines, offsets, pages, sentences and profiles of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t

from . import keywords

PAGE_CHARS, PAGES, MOST_BREAKS = 3000, 10, 19
#: What marks the end of a page.
PAGE_MARKS = (r"\f", r"\n\s*\n\s*\n\s*\n", r"페이지\s*\d+", r"(?i)Page\s*\d+", r"\n\s*-\s*\d+\s*-\s*\n", r"\n\s*=+\s*\n", r"\n\s*#{3,}\s*\n")


def word_positions(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Number, first and last place of each keyword in its document, in any case, overlapping places too.

    Cutting before every hit gives the places as sums of lengths; that is linear in the text. A document's keywords meet its text in one row.
    """
    both = keywords.per_document(rows.select("doc_id", "keyword"), docs).select("doc_id", F.lower("text").alias("low"), "found")

    def places(x: Column) -> Column:
        word = F.lower(x["keyword"])
        lengths = F.transform(F.split(F.col("low"), F.concat(F.lit("(?=\\Q"), word, F.lit("\\E)")), -1), F.length)
        return F.struct(x["keyword"].alias("keyword"), lengths.alias("l"), F.startswith(F.col("low"), word).alias("at_once"))

    cut = both.select("doc_id", F.explode(F.transform("found", places)).alias("r")).select("doc_id", "r.*")
    total = F.aggregate("l", F.lit(0), lambda a, x: a + x)
    return cut.filter((F.size("l") > 1) | F.col("at_once")).select(
        "doc_id", "keyword", (F.size("l") - 1 + F.col("at_once").cast("int")).cast("bigint").alias("n"),
        F.when(F.col("at_once"), 0).otherwise(F.col("l")[0]).cast("bigint").alias("first"),
        F.when(F.size("l") > 1, total - F.element_at("l", -1)).otherwise(0).cast("bigint").alias("last"),
    )


def line_index(docs: DataFrame) -> DataFrame:
    """One row a line with the offset where it starts; lines are numbered from 1."""
    lines = F.split("text", "\n", -1)
    rows = docs.select("doc_id", F.posexplode(lines).alias("i", "line"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", (F.col("i") + 1).alias("line_no"), F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("bigint").alias("line_start"), "line")


def offset_to_line(offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """Line and column of each (doc_id, offset): the last line that starts at or before it."""
    hit = offsets.join(lines, "doc_id").filter(F.col("line_start") <= F.col("offset"))
    best = hit.groupBy("doc_id", "offset").agg(F.max(F.struct("line_no", "line_start")).alias("l"))
    return best.select("doc_id", "offset", F.col("l.line_no").alias("line_number"), (F.col("offset") - F.col("l.line_start") + 1).alias("column_number"))


def page_breaks(docs: DataFrame) -> DataFrame:
    """Sorted offsets of page marks; in a long text without one, short lines after each 3000 characters."""
    text = F.col("text")
    places = []
    for mark in PAGE_MARKS:
        # cut before every match: the lengths of the pieces add up to the places
        pieces = F.split(F.regexp_replace(text, f"({mark})", "\u0001$1"), "\u0001", -1)
        ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x))))
        places.append(F.slice(ends, F.lit(1), F.size(ends) - 1))
    marked = F.array_sort(F.array_distinct(F.concat(*places)))
    state = F.struct(F.lit(0).alias("at"), F.lit(PAGE_CHARS).alias("next"), F.array().cast("array<int>").alias("out"))
    most = F.least(F.floor(F.length(text) / PAGE_CHARS).cast("int"), F.lit(PAGES)) - 1

    def step(st: Column, line: Column) -> Column:
        cut = (st["at"] > st["next"]) & (F.size(st["out"]) < most) & (F.length(F.trim(line)) < 20)
        return F.struct(
            (st["at"] + F.length(line) + 1).alias("at"), F.when(cut, st["next"] + PAGE_CHARS).otherwise(st["next"]).alias("next"),
            F.when(cut, F.concat(st["out"], F.array(st["at"]))).otherwise(st["out"]).alias("out"),
        )

    guessed = F.aggregate(F.split(text, "\n", -1), state, step, lambda st: st["out"])
    found = docs.select("doc_id", "text", marked.alias("marked"))
    chosen = F.when(F.size("marked") > 0, F.col("marked")).when(F.length(text) > PAGE_CHARS, guessed).otherwise(F.array().cast("array<int>"))
    return found.select("doc_id", F.slice(chosen, 1, MOST_BREAKS).alias("breaks"))


def offset_to_page(offset: Column, breaks: Column) -> Column:
    return F.size(F.filter(breaks, lambda b: b <= offset)) + 1


def rule_summary(docs: DataFrame) -> DataFrame:
    """First, last and longest sentence of a document with three or more, long ones cut and marked with dots."""
    clean = F.transform(F.split("text", "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    s = docs.select("doc_id", F.filter(clean, lambda x: F.length(x) > 10).alias("s")).filter(F.size("s") >= 3)
    s = s.withColumn("most", F.array_max(F.transform("s", F.length)))
    cut = lambda x, n: F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)
    longest = F.when(F.col("most") > 50, cut(F.filter("s", lambda x: F.length(x) == F.col("most"))[0], 120))
    row = lambda category, score, keyword: F.struct(F.lit(category).alias("category"), F.lit(score).alias("score"), keyword.alias("keyword"))
    rows = F.array(row("summary_intro", 0.8, cut(F.col("s")[0], 100)), row("summary_conclusion", 0.8, cut(F.element_at("s", -1), 100)), row("summary_core", 0.9, longest))
    return s.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.category", "r.score", "r.keyword").filter("keyword IS NOT NULL")


def summary_topics(docs: DataFrame) -> DataFrame:
    """The three most repeated words of the first ten sentences."""
    head = F.array_join(F.slice(F.split("text", "[.!?]+"), 1, 10), " ")
    words = keywords.tokens(docs.select("doc_id", head.alias("text"))).filter(t.is_meaningful(F.col("w")))
    counts = words.groupBy("doc_id", F.lower("w").alias("keyword")).agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")).filter("n >= 2")
    return keywords.top(counts, [F.desc("n"), "first"], 3).select("doc_id", "keyword", F.round(F.least(F.lit(0.7), 0.4 + 0.1 * F.col("n")), 6).alias("score"))


def _bucket(value: Column, cuts: list[tuple[int, str]], rest: str) -> Column:
    out = F.when(value < cuts[0][0], cuts[0][1])
    for cut, label in cuts[1:]:
        out = out.when(value < cut, label)
    return out.otherwise(rest)


def stat_labels(docs: DataFrame) -> DataFrame:
    """Length, words, sentences, paragraphs, words a sentence and characters a word of a document as labels with their scores."""
    c, w, s, p = (F.col(x) for x in "cwsp")
    counts = docs.select(
        "doc_id", F.length("text").alias("c"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("w"), F.size(F.split("text", "[.!?]+", -1)).alias("s"),
        F.size(F.filter(F.split("text", "\n\n", -1), lambda x: x.rlike(r"\S"))).alias("p"),
    )
    #: Bounds and names of the labels.
    labels = [
        ("doc_length", 0.7, c, [(1000, "매우짧음"), (5000, "짧음"), (20000, "보통"), (50000, "김")], "매우김"),
        ("word_count", 0.6, w, [(100, "소량"), (500, "적음"), (2000, "보통"), (5000, "많음")], "대량"),
        ("sentence_count", 0.5, s, [(10, "단순"), (50, "보통"), (200, "복잡")], "매우복잡"),
        ("paragraph_count", 0.5, p, [(5, "단순구조"), (20, "보통구조")], "복잡구조"),
        ("sentence_length", 0.4, w / F.greatest(s, F.lit(1)), [(8, "짧은문장"), (15, "보통문장"), (25, "긴문장")], "매우긴문장"),
        ("complexity", 0.6, c / F.greatest(w, F.lit(1)), [(4, "단순"), (6, "보통"), (8, "복잡")], "매우복잡"),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(score).alias("score"), _bucket(v, cuts, rest).alias("label")) for n, score, v, cuts, rest in labels])
    return counts.select("doc_id", F.explode(rows).alias("l")).select("doc_id", "l.category", "l.score", "l.label")


def text_profile(docs: DataFrame) -> DataFrame:
    best = keywords.simple_keywords(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword", "n"))).alias("k"))
    top = F.array_join(F.transform("k", lambda x: F.concat(x["keyword"], F.lit(":"), x["n"].cast("string"))), ",")
    counts = docs.select("doc_id", F.length("text").alias("chars"), F.regexp_count("text", F.lit("[A-Za-z]")).alias("latin"), F.regexp_count("text", F.lit("[가-힣]")).alias("hangul"))
    return counts.join(best.select("doc_id", top.alias("top")), "doc_id", "left").withColumn("top", F.coalesce("top", F.lit("")))
