"""Sections, elements and chunks of documents, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import arrays
from corpusmill.functions import text as t

#: What shows a table, figure, reference, footnote or list line.
ELEMENTS = {
    "tables": r"\|.*\||[<\[]?\s*표\s*\d+|[표表]\s*[\d一二三四五六七八九十]+|(?i:Table\s*\d+|<table)|┌|├|└|─|│",
    "figures": r"(?i:그림\s*\d+|Figure\s*\d+|Fig\.\s*\d+|차트\s*\d+|Chart\s*\d+|도표\s*\d+|사진\s*\d+|이미지\s*\d+)|!\[.*\]\(.*\)",
    "references": r"^\[\d+\]|참고문헌|(?i:References|Bibliography)",
    "footnotes": r"\[\^\d+\]|주\s*\d+[:\)]",
    "lists": r"^\s*[-*•]\s+|^\s*\d+[.)]\s+|^\s*[A-Za-z][.)]\s+",
}


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line, stripped, and the neighbours' stripped texts."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line", F.trim("line").alias("s"))
    return rows.withColumn("before", F.coalesce(F.lag("s").over(w), F.lit(""))).withColumn("after", F.coalesce(F.lead("s").over(w), F.lit("")))


def section_style(s: Column, before: Column, after: Column) -> Column:
    """The first kind of heading that a line fits, or null."""
    n = F.length(s)
    alone = (before == "") & (after == "")
    return (
        F.when(s == "", None)
        .when(s.rlike(r"^\d+(\.\d+)*\s*[.)]?\s+."), "numbered")
        .when(s.rlike(r"^제?\s*\d+\s*[장절항]\s*[.:]?\s*."), "korean")
        .when(s.rlike(r"^[IVXLCDM]{1,4}\s*[.)]?\s+."), "roman")
        .when(s.rlike(r"^#{1,6}\s+."), "markdown")
        .when(s.rlike(r"^[A-Z][A-Z\s]{2,}$") & (n < 50) & ((before == "") | (after == "")), "uppercase")
        .when(s.rlike(r"^[가-힣A-Za-z0-9\s]+\s*[:：-]$"), "separator")
        .when((n > 5) & (n < 50) & alone & ~s.rlike("[.。!?！？]$") & s.rlike("^[가-힣A-Za-z]"), "isolated")
    )


def section_number(style: Column, s: Column) -> Column:
    return F.when(style == "numbered", F.regexp_extract(s, r"^(\d+(?:\.\d+)*)", 1)).when(style == "roman", F.regexp_extract(s, "^([IVXLCDM]+)", 1)).when(style == "korean", F.regexp_extract(s, r"(\d+)", 1))


def section_title(style: Column, s: Column) -> Column:
    return (
        F.when(style == "numbered", F.regexp_replace(s, r"^\d+(\.\d+)*\s*[.)]?\s+", ""))
        .when(style == "roman", F.regexp_replace(s, r"^[IVXLCDM]+\s*[.)]?\s+", ""))
        .when(style == "markdown", F.regexp_replace(s, r"^#+\s+", ""))
        .when(style == "separator", F.trim(F.regexp_replace(s, r"\s*[:：-]$", "")))
        .when(style == "korean", F.regexp_replace(s, r"^제?\s*\d+\s*[장절항]\s*[.:]?\s*", ""))
        .otherwise(s)
    )


def section_level(style: Column, s: Column) -> Column:
    return (
        F.when(style == "numbered", F.size(F.split(F.regexp_extract(s, r"^(\d+(?:\.\d+)*)", 1), r"\.")))
        .when(style == "markdown", F.length(F.regexp_extract(s, "^(#+)", 1))).when(style == "separator", 2).when(style == "isolated", 3).otherwise(1)
    )


def sections(docs: DataFrame) -> DataFrame:
    """Heading lines: doc_id, line_no, number, title, level, style."""
    s, style = F.col("s"), F.col("style")
    found = lines(docs).withColumn("style", section_style(s, F.col("before"), F.col("after"))).filter("style IS NOT NULL")
    return found.select("doc_id", "line_no", section_number(style, s).alias("number"), section_title(style, s).alias("title"), section_level(style, s).alias("level"), "style")


def element_counts(docs: DataFrame) -> DataFrame:
    """Lines of each kind of element; heading lines do not count, unless isolated."""
    rows = lines(docs).withColumn("style", section_style(F.col("s"), F.col("before"), F.col("after"))).filter("s <> '' AND (style IS NULL OR style = 'isolated')")
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("line").rlike(p)).alias(k) for k, p in ELEMENTS.items()])


def outline_summary(sections: DataFrame) -> DataFrame:
    has = lambda *words: F.bool_or(F.col("title").rlike("|".join(words)))
    found = sections.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.max("level").alias("max_level"), has("서론", "Introduction", "개요").alias("has_introduction"), has("결론", "Conclusion", "맺음").alias("has_conclusion"),
        F.array_sort(F.collect_list(F.struct("line_no", "title"))).alias("t"),
    )
    return found.select("doc_id", "total", "max_level", "has_introduction", "has_conclusion", F.array_join(F.transform(F.slice("t", 1, 20), lambda x: x["title"]), "|").alias("main"), F.when(F.col("total") > 3, "good").otherwise("poor").alias("quality"))


def section_parents(sections: DataFrame) -> DataFrame:
    """(doc_id, line_no, parent_line, path): each section with the nearest earlier one of a smaller level, and all that lie around it, the outermost first.

    One ordered pass over a document's headings with a stack of the open ones; `path` is empty and `parent_line` null at a root.
    """
    headings = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "level"))).alias("h"))
    around = lambda open_, x: F.filter(open_, lambda o: o["level"] < x["level"])
    nothing = F.array().cast("array<struct<line_no: int, level: int>>")
    paths = arrays.scan(F.col("h"), nothing, lambda open_, x: F.concat(around(open_, x), F.array(x)), lambda open_, x: F.transform(around(open_, x), lambda o: o["line_no"]), "array<int>")
    rows = headings.select("doc_id", F.explode(F.arrays_zip(F.col("h"), paths.alias("path"))).alias("r"))
    return rows.select("doc_id", "r.h.line_no", F.try_element_at("r.path", F.lit(-1)).alias("parent_line"), "r.path")


def blocks(docs: DataFrame) -> DataFrame:
    """Runs of lines of one kind: header, table, paragraph or empty."""
    kind = F.when(F.col("s") == "", "empty").when(F.col("s").startswith("#"), "header").when(F.col("s").contains("|"), "table").otherwise("paragraph")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(docs).withColumn("kind", kind)
    changed = rows.withColumn("new", F.when((F.lag("kind").over(w) == F.col("kind")) & (F.col("kind") != "header"), 0).otherwise(1))
    numbered = changed.withColumn("block", F.sum("new").over(w))
    return numbered.groupBy("doc_id", "block", "kind").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.filter(F.split("text", "\n", -1), lambda p: F.trim(p) != "")).alias("i", "content"))


def budget_merge(docs: DataFrame, budget: int = 500) -> DataFrame:
    """Neighbouring paragraphs put together while their tokens (four characters each) fit the budget.

    The running state walks one document's own array, so no document meets another.
    """
    parts = F.filter(F.split("text", "\n", -1), lambda p: F.trim(p) != "")
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(st: Column, x: Column) -> Column:
        cost = F.floor(F.length(x) / 4).cast("int")
        full = (st["used"] + cost > budget) & (st["used"] > 0)
        chunk = st["chunk"] + F.when(full, 1).otherwise(0)
        return F.struct(chunk.alias("chunk"), F.when(full, cost).otherwise(st["used"] + cost).alias("used"), F.concat(st["out"], F.array(chunk)).alias("out"))

    cut = docs.select("doc_id", F.posexplode(F.aggregate(parts, zero, step, lambda st: st["out"])).alias("i", "chunk"))
    return cut.groupBy("doc_id", "chunk").agg(F.min("i").alias("first"), F.max("i").alias("last"))


def chunk_summary(docs: DataFrame) -> DataFrame:
    s = F.filter(F.transform(F.split("text", "\n", -1), t.trim), lambda x: x != "")
    short = lambda x: F.when(F.length(x) > 100, F.concat(F.substring(x, 1, 100), F.lit("..."))).otherwise(x)
    return docs.select("doc_id", F.length("text").alias("length"), s.alias("l")).select("doc_id", "length", short(F.try_element_at("l", F.lit(1))).alias("intro"), short(F.try_element_at("l", F.lit(-1))).alias("conclusion"), F.size("l").alias("lines"))


def chunk_structure(docs: DataFrame) -> DataFrame:
    l = F.split("text", "\n", -1)  # noqa: E741
    return docs.select(
        "doc_id", F.size(F.filter(l, lambda x: x.rlike(r"^#|^제?\d+[장절]|^\d+\."))).alias("headers"), F.size(F.filter(l, lambda x: x.rlike(r"^\s*[-*•]\s|^\s*\d+\.\s"))).alias("lists"), F.exists(l, lambda x: F.length(x) > 50).alias("has_paragraph")
    )


def turns(conversations: DataFrame) -> DataFrame:
    """Conversations as documents whose chunks are their turns."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.concat_ws("_", F.lit("turn"), "turn").alias("chunk_id"), F.col("role").alias("level"), F.col("turn"), "text")
