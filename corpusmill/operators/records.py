"""Stored model replies, metadata records and outline walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t

from .keywords import per_document

#: Words that show a tone; the first of equals counts.
TONES = {
    "학술적": ("연구", "분석", "결과", "방법론", "이론", "가설", "실험", "데이터"),
    "공식적": ("공지", "안내", "규정", "지침", "절차", "정책", "계획"),
    "기술적": ("시스템", "구현", "개발", "코드", "알고리즘", "프로그래밍", "소프트웨어"),
    "설명적": ("방법", "단계", "과정", "절차", "예시", "설명", "가이드"),
    "분석적": ("비교", "검토", "평가", "분석", "고찰", "조사", "연구"),
    "긍정적": ("성공", "향상", "개선", "효과", "발전", "좋은", "우수한"),
    "부정적": ("문제", "실패", "오류", "위험", "어려움", "부족", "나쁜"),
}
DEFAULT_TONE = "일반적"
#: Marks that end a sentence or block.
SEPARATOR = r"\n\n|\. |\.\n|\||- \*\*|## "
CONFIDENCE = {"high": 1.0, "medium": 0.8, "low": 0.6}


def reply_array(reply: Column) -> Column:
    """The longest JSON array of objects in a reply, code fences stripped; else the objects with a keyword, as an array."""
    bare = F.regexp_replace(reply, "```[a-z]*", "")
    arrays = F.regexp_extract_all(bare, F.lit(r"(?s)\[\s*\{.*\}\s*\]"), 0)
    objects = F.regexp_extract_all(bare, F.lit(r'\{[^{}]*"keyword"[^{}]*\}'), 0)
    longest = F.array_max(F.transform(arrays, lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))["a"]
    return F.coalesce(longest, F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")))


def parse_keywords(replies: DataFrame) -> DataFrame:
    """(doc_id, keyword, score, category) of each object in a reply; objects without a keyword drop out."""
    rows = F.from_json(reply_array(F.col("reply")), "array<struct<keyword: string, score: double, category: string>>")
    found = replies.select("doc_id", F.explode(rows).alias("r")).select("doc_id", F.trim("r.keyword").alias("keyword"), F.coalesce("r.score", F.lit(0.8)).alias("score"), "r.category")
    return found.filter("keyword <> ''")


def parse_relations(replies: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a reply's relation objects whose ends are two different known names."""
    rows = F.from_json(reply_array(F.col("reply")), "array<struct<entity1: string, entity2: string, relationship: string, confidence: double>>")
    found = replies.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*").filter("entity1 <> entity2")
    names = nodes.select("name").distinct()
    return found.join(names, found["entity1"] == names["name"], "left_semi").join(names, F.col("entity2") == names["name"], "left_semi")


def weighted(score: Column, level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return F.round(score * F.coalesce(F.try_element_at(table, level), F.lit(0.8)), 6)


def tone(docs: DataFrame) -> DataFrame:
    """The tone whose words occur most in a text."""
    low = F.lower("text")
    counts = [F.struct(sum((F.regexp_count(low, F.lit(w)) for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, words) in enumerate(TONES.items())]
    best = F.array_max(F.array(*counts))
    return docs.select("doc_id", F.when(best["n"] > 0, best["name"]).otherwise(DEFAULT_TONE).alias("tone"))


def fallback_title(docs: DataFrame) -> DataFrame:
    """The first of a document's first ten lines that can be a title."""
    lines = F.transform(F.slice(F.split("text", "\n", -1), 1, 10), t.trim)
    fits = F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 200) & ~x.rlike(r"^\d+$") & ~x.startswith("http") & ~x.contains("@"))
    return docs.select("doc_id", F.try_element_at(fits, F.lit(1)).alias("title"))


def file_metadata(docs: DataFrame) -> DataFrame:
    """Extension, words of the file name, and size as a label."""
    name = F.regexp_replace("filename", r"\.[^.]+$", "")
    n = F.length("text")
    size = F.when(n < 5000, "소형").when(n < 50000, "중형").when(n < 200000, "대형").otherwise("초대형")
    return docs.select("doc_id", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).alias("extension"), F.array_join(F.filter(F.split(name, r"[_\- ]+"), lambda w: F.length(w) >= 2), ",").alias("words"), size.alias("size"))


def complexity(words: Column, headers: Column, tables: Column) -> Column:
    return F.round(F.least(words / 1000, F.lit(1.0)) * 0.4 + F.least(headers / 10, F.lit(1.0)) * 0.3 + F.least(tables / 5, F.lit(1.0)) * 0.3, 6)


def richness(record: Column) -> Column:
    """How much a metadata record, a JSON object, tells: a point for each field, and more for structure, tables, sections, images, statistics and analysis.

    What is no object, or null, has no score. Tables, sections and images count where they are lists within `docling_structure`.
    """
    at = lambda path: F.get_json_object(record, f"$.{path}")
    many = lambda name: F.coalesce(F.json_array_length(at(f"docling_structure.{name}")), F.lit(0))
    has = lambda name, points: F.when(F.array_contains(F.json_object_keys(record), name), points).otherwise(0)
    parts = has("docling_structure", 20) + 10 * many("tables") + 5 * many("sections") + 5 * many("images") + has("document_structure", 10) + has("text_statistics", 5) + has("content_analysis", 15)
    return 10 + F.size(F.json_object_keys(record)) + parts


def headed_lines(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Each line with the number of the last chapter (level 1) and section (deeper) heading at or before it."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.join(sections.select("doc_id", "line_no", "level"), ["doc_id", "line_no"], "left")
    chapter, section = F.when(F.col("level") == 1, F.col("line_no")), F.when(F.col("level") > 1, F.col("line_no"))
    return marked.select("doc_id", "line_no", "line", F.last(chapter, ignorenulls=True).over(w).alias("chapter"), F.last(section, ignorenulls=True).over(w).alias("section"))


def near_pairs(keywords: DataFrame, docs: DataFrame, within: int = 100) -> DataFrame:
    """(doc_id, source, target, gap): pairs of a document's keywords with hits near each other and no sentence or block end between; their least gap.

    All hits count, in any case. No keyword holds a mark of such an end, so texts are cut at these marks and hits meet within a piece; splitting a
    piece at a keyword gives its places as running sums.
    """
    found = per_document(keywords.select("doc_id", "rank", "keyword"), docs)
    pieces = found.select("doc_id", "found", F.posexplode(F.split("text", SEPARATOR, -1)).alias("piece", "s")).select("doc_id", "piece", F.lower("s").alias("s"), F.explode("found").alias("k"))
    parts = F.transform(F.split("s", F.concat(F.lit("\\Q"), F.lower("k.keyword"), F.lit("\\E")), -1), F.length)
    cut = pieces.select("doc_id", "piece", "k.rank", "k.keyword", parts.alias("parts")).filter(F.size("parts") > 1)
    cut = cut.select("doc_id", "piece", "rank", "keyword", F.size("parts").alias("all"), F.posexplode("parts").alias("i", "n"))
    before = Window.partitionBy("doc_id", "piece", "rank").orderBy("i")
    at = (F.sum(F.col("n") + F.length("keyword")).over(before) - F.length("keyword")).cast("int")
    placed = cut.withColumn("at", at).filter("i < all - 1")
    places = placed.groupBy("doc_id", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "rank", "keyword"))).alias("places"), F.countDistinct("rank").alias("kinds")).filter("kinds > 1")
    # a keyword has one hit a place at most, so that this many next hits hold all that are near
    reach = (F.col("kinds") * (within + 1)).cast("int")

    def pair(a: Column, b: Column) -> Column:
        first = a["rank"] < b["rank"]
        return F.struct(F.when(first, a["keyword"]).otherwise(b["keyword"]).alias("source"), F.when(first, b["keyword"]).otherwise(a["keyword"]).alias("target"), (b["at"] - a["at"]).alias("gap"))

    def partners(a: Column, i: Column) -> Column:
        near = F.filter(F.slice("places", i + 2, reach), lambda b: (b["at"] - a["at"] <= within) & (b["rank"] != a["rank"]))
        return F.transform(near, lambda b: pair(a, b))

    pairs = places.select("doc_id", F.explode(F.flatten(F.transform("places", partners))).alias("p"))
    return pairs.groupBy("doc_id", "p.source", "p.target").agg(F.min("p.gap").alias("gap"))


def leaf_paths(parents: DataFrame) -> DataFrame:
    """The path of line numbers from the root to each section that has none below; `parents` is what `structure.section_parents` gives."""
    inner = parents.select("doc_id", F.col("parent_line").alias("line_no")).filter("line_no IS NOT NULL").distinct()
    path = F.array_join(F.concat("path", F.array("line_no")).cast("array<string>"), ">")
    return parents.join(inner, ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no", path.alias("path"))
