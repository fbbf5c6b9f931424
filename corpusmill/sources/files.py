"""Readers, format rules and exports of text-like files, pages and graphs."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.functions import text as t

ALLOWED = ("txt", "text", "log", "csv", "tsv", "md", "html", "htm", "pdf", "docx", "hwp", "zip")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below `path`: path, text (undecodable bytes replaced), size, modification time."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.expr("make_valid_utf8(cast(content AS STRING))").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def corpus_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text", F.octet_length("text").cast("bigint").alias("size"))


def candidate_formats(path: Column, content: Column) -> Column:
    """Formats to try, in order: by extension, then by the first kilobyte, then text."""
    head, ext = F.substring(content, 1, 1024), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.when(ext.isin("htm", "html"), "html").when(ext == "md", "md").when(ext == "pdf", "pdf").when(ext.isin("docx", "hwp", "zip"), ext)
    by_head = (
        F.when(head.startswith("%PDF-"), "pdf").when(head.startswith("PK\x03\x04"), "zip").when(F.lower(head).rlike("<html|<!doctype html"), "html")
        .when(head.startswith("#") | head.contains("```") | head.contains("]("), "md")
    )
    return F.array_distinct(F.array_compact(F.array(by_name, by_head, F.lit("txt"))))


def allowed_files(files: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    return files.filter(F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin(*allowed))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def html_extract(pages: DataFrame) -> DataFrame:
    """Title (else the first heading, else the address), author, and the visible text, a trimmed phrase a line."""
    first = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    title = F.coalesce(first(r"(?is)<title[^>]*>(.*?)</title>"), first(r"(?is)<h1[^>]*>(.*?)</h1>"), first(r'(?i)<meta\s+property="og:title"\s+content="([^"]*)"'), F.col("url"))
    author = F.coalesce(first(r'(?i)<meta\s+name="author"\s+content="([^"]*)"'), first(r'(?i)<meta\s+property="article:author"\s+content="([^"]*)"'))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", ""), r"<[^>]*>", "\n")
    lines = F.filter(F.transform(F.split(unescape(bare), "\n"), lambda x: t.squeeze(x)), lambda x: x != "")
    text = F.array_join(lines, "\n")
    return pages.select("page_id", unescape(title).alias("title"), author.alias("author"), text.alias("text")).withColumn("word_count", F.size(t.words(F.col("text"))))


def html_links(pages: DataFrame) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit('(?i)<a\\s+href="([^"]*)"[^>]*>([^<]*)</a>'), 1)).alias("url")
    kind = F.when(F.col("url").startswith("mailto:"), "mailto").when(F.col("url").rlike("^https?://"), "external").otherwise("internal")
    return pages.select("page_id", found).withColumn("kind", kind)


def front_matter(docs: DataFrame) -> DataFrame:
    """Keys and values of a leading block between --- lines, and the rest as the body."""
    block = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: ~x.startswith("#") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']|[\"']$", "")).alias("value")))
    return docs.withColumn("meta", F.map_from_entries(F.filter(pairs, lambda p: p["value"] != ""))).withColumn("body", F.regexp_replace("text", r"(?s)^---\n.*?\n---\n", ""))


def md_to_text(text: Column) -> Column:
    """Markdown without its marks. Links go before images, so an image leaves its mark and label."""
    for pattern, to in (
        (r"(?s)```.*?```", ""), (r"`[^`]*`", ""), (r"<[^>]+>", ""), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"!\[([^\]]*)\]\([^)]*\)", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"(?m)^>\s*", ""), (r"(?m)^[-*_]{3,}$", ""), (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_to_markdown(text: Column) -> Column:
    """Numbered lines become headings as deep as their number; table and list lines stay; others are trimmed."""

    def line(x: Column) -> Column:
        bare = t.trim(x)
        number = F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)\.?\s", 1)
        depth = F.least(F.size(F.split(number, r"\.")), F.lit(6))
        return F.when(number != "", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), bare)).when(x.contains("|") | x.rlike(r"^\s*[-*] "), x).otherwise(bare)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def reflow(text: Column) -> Column:
    """A long text of one or two lines with each sentence on its own line."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?]) +", "$1\u0001"), "\u0001"), t.trim), lambda s: s != "")
    return F.when((F.size(F.split(text, "\n")) <= 2) & (F.length(text) > 1000), F.array_join(parts, "\n")).otherwise(text)


def best_candidate(docs: DataFrame) -> DataFrame:
    """Of several texts of a document the one of best quality; the first of equals."""
    candidates = F.array(
        F.struct(F.lit(0).alias("o"), F.lit("raw").alias("name"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("o"), F.lit("squeezed").alias("name"), t.squeeze(F.col("text")).alias("text")),
        F.struct(F.lit(2).alias("o"), F.lit("letters").alias("name"), F.regexp_replace("text", r"[^A-Za-z\s]", "").alias("text")),
    )
    scored = docs.select("doc_id", F.explode(candidates).alias("c")).select("doc_id", "c.o", "c.name", F.round(t.text_quality(F.col("c.text")), 9).alias("q"))
    best = scored.groupBy("doc_id").agg(F.max_by("name", F.struct("q", -F.col("o"))).alias("best"), F.max("q").alias("q"))
    return best.select("doc_id", "best", F.round("q", 6).alias("quality"))


#: Kinds of references in texts, their scores and patterns.
REFERENCES = (
    ("url_reference", 0.5, r'https?://[^\s<>"{}|\\^`\[\]]+'),
    ("email_reference", 0.6, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("date_korean", 0.7, r"\d{4}년\s*\d{1,2}월\s*\d{1,2}일"),
    ("date_iso", 0.7, r"\d{4}-\d{2}-\d{2}"),
    ("date_us", 0.7, r"\d{1,2}/\d{1,2}/\d{4}"),
    ("date_eu", 0.7, r"\d{1,2}\.\d{1,2}\.\d{4}"),
)


def content_refs(docs: DataFrame) -> DataFrame:
    """Hosts of links, domains of mail addresses, and dates in four forms: a row for each mention with its score and place.

    A mention's place follows from the lengths of the pieces and mentions before it, summed within its document and kind.
    """
    found = F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(v).alias("score"), F.arrays_zip(F.regexp_extract_all("text", F.lit(p), 0).alias("m"), F.transform(F.split("text", p, -1), F.length).alias("gap")).alias("all"))
        for c, v, p in REFERENCES
    ])
    kinds = docs.select("doc_id", F.explode(found).alias("k")).select("doc_id", "k.category", "k.score", F.posexplode("k.all").alias("i", "x"))
    rows = kinds.filter("x.m IS NOT NULL").select("doc_id", "category", "score", "i", F.col("x.m").alias("m"), F.col("x.gap").alias("gap"))
    so_far = Window.partitionBy("doc_id", "category").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("m")).over(so_far).cast("int")
    keyword = F.when(F.col("category") == "url_reference", F.split_part("m", F.lit("/"), F.lit(3))).when(F.col("category") == "email_reference", F.split_part("m", F.lit("@"), F.lit(2))).otherwise(F.col("m"))
    return rows.select("doc_id", "category", "score", keyword.alias("keyword"), (end - F.length("m")).alias("start_position"), end.alias("end_position"))


def numeric_profile(docs: DataFrame) -> DataFrame:
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    found = docs.select("doc_id", numbers.alias("v")).filter(F.size("v") > 0)
    mean = found.select("doc_id", (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("m"))
    label = F.when(F.col("m") < 10, "소수").when(F.col("m") < 100, "중간수").when(F.col("m") < 1000, "큰수").otherwise("대형수")
    return mean.select("doc_id", F.round("m", 0).alias("mean"), label.alias("label"))
