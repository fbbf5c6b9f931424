"""Items of Markdown texts: headings, list items, tables with their cells, counts of elements; and the mark of scanned texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores of headings by depth, of bullets and of numbered items.
HEADING_SCORES = {1: ("title_h1", 1.0), 2: ("title_h2", 0.9), 3: ("title_h3", 0.8)}
DEEP_HEADING, BULLET, NUMBERED = ("title_h4_h6", 0.7), ("list_item", 0.5), ("numbered_item", 0.6)
IMAGE_TAG = "<!-- image -->"


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def heading_and_list_items(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, keyword, category, score, start_position, end_position) of headings and list items.

    The place is where the bare line first occurs in the text. Titles have two or more characters, items three or more.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), _bare(x).alias("s")))
    marked = F.filter(lines, lambda x: x["s"].rlike(r"^#{1,6}\s+.|^[-*+]\s+.|^\d+\.\s+."))

    def item(x: Column) -> Column:
        s = x["s"]
        depth = F.length(F.regexp_extract(s, "^#*", 0))
        label, score = F.lit(DEEP_HEADING[0]), F.lit(DEEP_HEADING[1])
        for level, (name, value) in HEADING_SCORES.items():
            label, score = F.when(depth == level, name).otherwise(label), F.when(depth == level, value).otherwise(score)
        numbered = s.rlike(r"^\d")
        keyword = _bare(F.regexp_extract(s, r"^(?:#{1,6}|[-*+]|\d+\.)\s+(.+)$", 1))
        return F.struct(
            x["line_no"].alias("line_no"), keyword.alias("keyword"),
            F.when(depth > 0, label).when(numbered, NUMBERED[0]).otherwise(BULLET[0]).alias("category"),
            F.when(depth > 0, score).when(numbered, NUMBERED[1]).otherwise(BULLET[1]).alias("score"),
            (F.position(s, F.col("text")) - 1).alias("start_position"), (depth > 0).alias("heading"),
        )

    rows = docs.select("doc_id", F.explode(F.transform(marked, item)).alias("r")).select("doc_id", "r.*")
    long_enough = rows.filter(F.length("keyword") >= F.when(F.col("heading"), 2).otherwise(3))
    return long_enough.drop("heading").withColumn("end_position", F.col("start_position") + F.length("keyword"))


def md_structure(docs: DataFrame) -> DataFrame:
    """Headings (level:title, in order) and the numbers of links, images, code blocks, tables and list items of each text.

    Tables are half the number of different table lines.
    """
    found = lambda p, g=0: F.regexp_extract_all("text", F.lit(p), g)
    heads = F.zip_with(found(r"(?m)^(#+)\s+(.+)$", 1), found(r"(?m)^(#+)\s+(.+)$", 2), lambda a, b: F.concat(F.length(a).cast("string"), F.lit(":"), _bare(b)))
    counts = docs.select(
        "doc_id", F.array_join(heads, "|").alias("headings"), F.size(found(r"\[([^\]]+)\]\(([^)]+)\)")).alias("links"), F.size(found(r"!\[([^\]]*)\]\(([^)]+)\)")).alias("images"),
        F.size(found(r"(?s)```(\w+)?\n(.*?)```")).alias("code_blocks"), F.floor(F.size(F.array_distinct(found(r"(?m)^\|.+\|$"))) / 2).cast("int").alias("tables"),
        F.size(found(r"(?m)^\s*[-*+]\s+")).alias("unordered"), F.size(found(r"(?m)^\s*\d+\.\s+")).alias("ordered"),
    )
    return counts.withColumn("total", F.col("unordered") + F.col("ordered"))


def markdown_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, line_no, header, body): each run of table lines; `body` holds the rows' cells without header and rule."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), _bare(x).alias("s"))), lambda x: x["s"].rlike(r"^\|.*\|$"))
    rows = docs.select("doc_id", F.explode(lines).alias("l")).select("doc_id", "l.*")
    run = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    cells = F.transform(F.split(F.expr("substring(s, 2, length(s) - 2)"), r"\|", -1), _bare)
    listed = rows.withColumn("run", run).groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "s", cells.alias("cells")))).alias("rows"))
    body = F.transform(F.filter(F.expr("slice(rows, 2, size(rows))"), lambda r: ~r["s"].rlike(r"^\|[\s:|-]*\|$")), lambda r: r["cells"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run"))
    return listed.select("doc_id", number.alias("table_no"), F.col("rows")[0]["line_no"].alias("line_no"), F.col("rows")[0]["cells"].alias("header"), body.alias("body"))


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, column_no, column_name, value), rows and columns from 0; a cell beyond the header has no name."""
    rows = tables.select("doc_id", "table_no", "header", F.posexplode("body").alias("row_no", "cells"))
    cells = rows.select("doc_id", "table_no", "row_no", "header", F.posexplode("cells").alias("column_no", "value"))
    return cells.select("doc_id", "table_no", "row_no", "column_no", F.get("header", F.col("column_no")).alias("column_name"), "value")


def table_lookup(tables: DataFrame, label: str, column: str) -> DataFrame:
    """(doc_id, table_no, value): the cells of a named column in the rows whose first cell is the label."""
    at = F.array_position("header", column).cast("int")
    rows = tables.filter(at > 0).select("doc_id", "table_no", F.explode("body").alias("cells"), at.alias("at"))
    return rows.filter(F.get("cells", F.lit(0)) == label).select("doc_id", "table_no", F.get("cells", F.col("at") - 1).alias("value"))


def scanned_flag(docs: DataFrame) -> DataFrame:
    """Whether a text is a scan's: under 30 % of it beside image tags, ten tags or more, under 500 characters beside them."""
    rest = F.replace("text", F.lit(IMAGE_TAG), F.lit(""))
    tags = ((F.length("text") - F.length(rest)) / len(IMAGE_TAG)).cast("int")
    sizes = docs.select("doc_id", F.length(_bare(F.col("text"))).alias("chars"), F.length(_bare(rest)).alias("actual"), tags.alias("tags"))
    density = F.when(F.col("chars") > 0, F.col("actual") / F.col("chars")).otherwise(0.0)
    return sizes.select("doc_id", "chars", "actual", "tags", F.round(density, 6).alias("density"), ((density < 0.3) & (F.col("tags") >= 10) & (F.col("actual") < 500)).alias("is_scanned"))


def parse_summaries(replies: DataFrame) -> DataFrame:
    """(doc_id, keyword, category, score) of a stored summary reply (doc_id, reply), whose JSON object may stand in a code fence.

    Introduction, conclusion and core are cut at 150 characters, the tone at 50; the first five topics count. An empty or missing part
    gives no row; a reply that holds no such object gives none.
    """
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    parsed = replies.select("doc_id", F.from_json(body, "intro string, conclusion string, core string, topics array<string>, tone string").alias("p"))
    row = lambda category, score, keyword: F.struct(F.lit(category).alias("category"), F.lit(score).alias("score"), keyword.alias("keyword"))
    topics = F.transform(F.slice(F.coalesce("p.topics", F.array().cast("array<string>")), 1, 5), lambda x: row("summary_topic", 0.8, x))
    parts = F.array(
        row("summary_intro", 0.9, F.substring("p.intro", 1, 150)), row("summary_conclusion", 0.9, F.substring("p.conclusion", 1, 150)),
        row("summary_core", 1.0, F.substring("p.core", 1, 150)), row("summary_tone", 0.7, F.substring("p.tone", 1, 50)),
    )
    return parsed.select("doc_id", F.explode(F.concat(parts, topics)).alias("r")).select("doc_id", "r.*").filter("keyword <> ''")


def structure_keywords(lines: DataFrame, sections: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, line_no, extractor, word): each word of `words` (doc_id, extractor, keyword) with the sections that contain it, in lower case.

    A word that no section contains goes to the document's first section. A document's words meet its sections as one array.
    """
    starts = sections.select("doc_id", "line_no", F.col("line_no").alias("start"))
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.select("doc_id", "line_no", "line").join(starts, ["doc_id", "line_no"], "left").withColumn("start", F.last("start", ignorenulls=True).over(so_far))
    content = placed.filter("start IS NOT NULL").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    content = content.select("doc_id", F.col("start").alias("line_no"), F.lower(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content"))
    lowered = words.select("doc_id", "extractor", F.lower("keyword").alias("word")).distinct()
    listed = lowered.groupBy("doc_id").agg(F.collect_list(F.struct("extractor", "word")).alias("words"))
    hits = content.join(listed, "doc_id").select("doc_id", "line_no", F.explode(F.filter("words", lambda w: F.col("content").contains(w["word"]))).alias("w")).select("doc_id", "line_no", "w.*")
    first = sections.groupBy("doc_id").agg(F.min("line_no").alias("line_no"))
    rest = lowered.join(hits.select("doc_id", "extractor", "word").distinct(), ["doc_id", "extractor", "word"], "left_anti").join(first, "doc_id")
    return hits.unionByName(rest)
