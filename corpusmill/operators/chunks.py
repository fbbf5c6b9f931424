"""Chapters, sections and subsections of documents by their headings, and chunks that keep to them.

Every rule runs over one document's own array of lines, in order, so no line leaves its row before the chunks are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import arrays

AUTO = "auto"
#: Heading patterns by kind, in the order in which they are tried; the groups that make the number; a title follows in the last group.
HEADINGS = (
    ("chapter", r"^(\d+)\.\s+(.+)$", 1), ("chapter", r"^제\s*(\d+)\s*장\s*[:.\s]*(.+)$", 1), ("chapter", r"^Chapter\s+(\d+)[.:\s]*(.+)$", 1), ("chapter", r"^CHAPTER\s+([IVX]+)[.:\s]*(.+)$", 1), ("chapter", r"^#\s+(\d+)\s+(.+)$", 1), ("chapter", r"^(\d{2})$", 1),
    ("section", r"^(\d+)\.(\d+)\s+(.+)$", 2), ("section", r"^(\d+)-(\d+)[.\s]+(.+)$", 2), ("section", r"^제\s*(\d+)\s*절\s*[:.\s]*(.+)$", 1), ("section", r"^##\s+(\d+)\.(\d+)\s+(.+)$", 2), ("section", r"^##\s+(\d{2})\s+(.+)$", 1), ("section", r"^##\s+(.+)$", 0),
    ("subsection", r"^(\d+)\.(\d+)\.(\d+)\s+(.+)$", 3), ("subsection", r"^(\d+)-(\d+)-(\d+)[.\s]+(.+)$", 3), ("subsection", r"^\((\d+)\)\s+(.+)$", 1), ("subsection", r"^([가-힣])\.\s+(.+)$", 1), ("subsection", r"^###\s+(.+)$", 0),
)
LEVELS = {"document": 0, "chapter": 1, "section": 2, "subsection": 3}
MOST_TOKENS = 16_000
_BARE = r"^\s+|\s+$"


def heading_class(line: Column) -> Column:
    """(kind, number, title) of the first pattern that the bare line fits; the number of a heading without one is `auto`. Null for other lines."""
    s = F.regexp_replace(line, _BARE, "")
    out = F.lit(None).cast("struct<kind: string, number: string, title: string>")
    for kind, pattern, parts in reversed(HEADINGS):
        alone = pattern == r"^(\d{2})$"
        number = F.concat_ws(".", *[F.regexp_extract(s, pattern, g) for g in range(1, parts + 1)]) if parts else F.lit(AUTO)
        title = F.concat(F.lit("Chapter "), s) if alone else F.regexp_replace(F.regexp_extract(s, pattern, parts + 1), _BARE, "")
        out = F.when(s.rlike(pattern), F.struct(F.lit(kind).alias("kind"), number.alias("number"), title.alias("title"))).otherwise(out)
    return out


def document_tree(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, *carried, size, nodes): each document's headings as one array of nodes in order, the document itself first.

    A node has: node (from 0), node_id, type, level, number, title, parent (a node, null for the document), start_pos, end_pos (of the heading line, its
    end included) and content: the lines up to the next chapter or section, without headings of any kind. Lines below a subsection stay with
    its section, so a subsection has none; one outside any section is left out. A section before any chapter gets a chapter
    of its own. Headings without a number are counted: sections through the document, subsections from each such section on.
    A null text is empty. Explode `nodes`, which are never empty, by explode_outer.
    """
    get = F.get
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", *carried, F.length(text).alias("size"), F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))).alias("l"))
    rows = rows.withColumn("starts", arrays.starts(F.transform("l", lambda x: F.length(x["line"]) + 1))).withColumn("classes", F.transform("l", lambda x: heading_class(x["line"])))
    heads = F.filter(F.transform("l", lambda x, i: F.struct(x["line_no"].alias("line_no"), get("classes", i).alias("c"), get("starts", i).alias("start_pos"), (get("starts", i) + F.length(x["line"]) + 1).alias("end_pos"))), lambda h: h["c"].isNotNull())
    rows = rows.withColumn("heads", heads)
    # in order: are a chapter and a section open, and the numbers given out so far
    zero = F.struct(F.lit(False).alias("chapter"), F.lit(False).alias("section"), F.lit(0).alias("sections"), F.lit(0).alias("subsections"))
    kind, is_auto = (lambda h: h["c"]["kind"]), (lambda h: h["c"]["number"] == AUTO)

    def step(st: Column, h: Column) -> Column:
        counted = (kind(h) == "section") & is_auto(h)
        return F.struct(
            (st["chapter"] | (kind(h) != "subsection")).alias("chapter"), F.when(kind(h) == "subsection", st["section"]).otherwise(kind(h) == "section").alias("section"),
            (st["sections"] + counted.cast("int")).alias("sections"), F.when(counted, 0).otherwise(st["subsections"] + ((kind(h) == "subsection") & is_auto(h)).cast("int")).alias("subsections"),
        )

    def told(st: Column, h: Column) -> Column:
        number = F.when(~is_auto(h), h["c"]["number"]).when(kind(h) == "section", (st["sections"] + 1).cast("string")).otherwise((st["subsections"] + 1).cast("string"))
        return F.struct(number.alias("number"), ((kind(h) != "subsection") | st["section"]).alias("kept"), ((kind(h) == "section") & ~st["chapter"]).alias("first"))

    rows = rows.withColumn("told", arrays.scan(F.col("heads"), zero, step, told, "struct<number: string, kept: boolean, first: boolean>"))

    def row(kind: Column, number: Column, title: Column, node_id: Column, line_no: Column, start: Column, end: Column) -> Column:
        return F.struct(kind.alias("type"), number.alias("number"), title.alias("title"), node_id.alias("node_id"), line_no.alias("line_no"), start.alias("start_pos"), end.alias("end_pos"))

    def made(h: Column, i: Column) -> Column:
        n = get("told", i)
        own = row(kind(h), n["number"], h["c"]["title"], F.concat_ws("_", kind(h), n["number"]), h["line_no"], h["start_pos"], h["end_pos"])
        implied = row(F.lit("chapter"), F.lit("1"), F.lit("Document Sections"), F.lit("chapter_auto"), h["line_no"], h["start_pos"], h["start_pos"])
        return F.when(n["first"], F.array(implied, own)).when(n["kept"], F.array(own)).otherwise(F.array().cast("array<struct<type: string, number: string, title: string, node_id: string, line_no: int, start_pos: int, end_pos: int>>"))

    root = row(F.lit("document"), F.lit("0"), F.lit("Document Root"), F.lit("document_root"), F.lit(0), F.lit(0), F.col("size"))
    rows = rows.withColumn("made", F.concat(F.array(root), F.flatten(F.transform("heads", made))))
    # of each node, the next chapter or section ends its lines; the chapter and section before it are around it
    later = F.reverse(arrays.scan(F.reverse("made"), F.size("l") + 1, lambda at, n: F.when(n["type"] == "subsection", at).otherwise(n["line_no"]), lambda at, n: at, "int"))
    open_ = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("int").alias("chapter"), F.lit(None).cast("int").alias("section"))
    move = lambda st, n: F.struct((st["at"] + 1).alias("at"), F.when(n["type"] == "chapter", st["at"] + 1).otherwise(st["chapter"]).alias("chapter"), F.when(n["type"] == "section", st["at"] + 1).otherwise(st["section"]).alias("section"))
    above = arrays.scan(F.col("made"), open_, move, lambda st, n: F.when(n["type"] == "chapter", 0).when(n["type"] == "section", st["chapter"]).when(n["type"] == "subsection", st["section"]), "int")
    rows = rows.withColumn("later", later).withColumn("above", above)

    def node(n: Column, i: Column) -> Column:
        lines = F.slice("l", n["line_no"] + 1, F.greatest(get("later", i) - n["line_no"] - 1, F.lit(0)))
        held = F.filter(lines, lambda x: get("classes", x["line_no"] - 1).isNull())
        closed = (F.size(held) > 0) & ~((get("later", i) > F.size("l")) & get("classes", F.size("l") - 1).isNull())
        content = F.concat(F.array_join(F.transform(held, lambda x: x["line"]), "\n"), F.when(closed, "\n").otherwise(""))
        empty = (n["type"] == "subsection") | (n["node_id"] == "chapter_auto")
        level = F.lit(None).cast("int")
        for name, depth in LEVELS.items():
            level = F.when(n["type"] == name, depth).otherwise(level)
        return F.struct(
            i.alias("node"), n["node_id"].alias("node_id"), n["type"].alias("type"), level.alias("level"), n["number"].alias("number"), n["title"].alias("title"), get("above", i).alias("parent"), n["start_pos"].alias("start_pos"), n["end_pos"].alias("end_pos"),
            F.when(empty, "").otherwise(content).alias("content"),
        )

    return rows.select("doc_id", *carried, "size", F.transform("made", node).alias("nodes"))


def tree_nodes(docs: DataFrame) -> DataFrame:
    """`document_tree`, a row for each node."""
    return document_tree(docs).select("doc_id", F.explode_outer("nodes").alias("n")).select("doc_id", "n.*")


def chunk_level(size: Column, chapters: Column, sections: Column) -> Column:
    """The size at which a document is cut: whole, by chapter or by section."""
    middle = F.when(chapters >= 3, "chapter").when(sections >= 3, "section").when(chapters >= 2, "chapter").otherwise("document")
    large = F.when((size / F.greatest(chapters, F.lit(1)) > 15000) & (sections >= chapters * 2), "section").otherwise("chapter")
    return F.when(size < 8000, "document").when(size < 50000, middle).otherwise(large)


def node_texts(nodes: Column) -> Column:
    """Of each node its heading as Markdown, a blank line and its content, where there is any; empty for an empty document node."""
    mark = lambda n: F.when(n["type"] == "chapter", "# ").when(n["type"] == "section", "## ").otherwise("### ")
    content = lambda n: F.when(n["content"].rlike(r"\S"), n["content"])
    return F.transform(nodes, lambda n: F.when(n["type"] == "document", F.coalesce(content(n), F.lit(""))).otherwise(F.concat_ws("\n\n", F.concat(mark(n), n["title"]), content(n))))


def build_chunks(docs: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(doc_id, chunk, chunk_id, level, parent_context, boundary_rule, nodes, text): each document's chunks, in order, at the level that fits its size.

    At the section level, neighbouring sections of a chapter go together while their tokens (four characters each) stay within `most_tokens`; a
    single larger one stays whole. A chapter without sections is a chunk. Lines before the first chapter belong to no chunk of a cut document.
    A document without chapters is one chunk, of any size.
    """
    rows = document_tree(docs).withColumn("texts", node_texts(F.col("nodes")))
    count = lambda kind: F.size(F.filter("nodes", lambda n: n["type"] == kind))
    rows = rows.withColumn("level", F.when(count("chapter") == 0, "document").otherwise(chunk_level(F.col("size"), count("chapter"), count("section"))))
    # the node a chunk may begin at, and what it holds: itself and all below
    heads = F.filter("nodes", lambda n: F.when(F.col("level") == "document", n["type"] == "document").when(F.col("level") == "chapter", n["type"] == "chapter").otherwise((n["type"] == "section") | (n["type"] == "chapter")))
    rows = rows.withColumn("heads", heads)

    def unit(n: Column, i: Column) -> Column:
        until = F.coalesce(F.get("heads", i + 1)["node"], F.size("nodes"))
        return F.struct(n.alias("n"), F.array_join(F.filter(F.slice("texts", n["node"] + 1, until - n["node"]), lambda x: x != ""), "\n\n").alias("text"), F.coalesce(F.get("heads", i + 1)["type"] == "section", F.lit(False)).alias("divided"))

    units = F.transform("heads", unit)
    # at the section level a chapter stands for itself only where it has no section
    rows = rows.withColumn("units", units).withColumn("units", F.filter("units", lambda u: ~((F.col("level") == "section") & (u["n"]["type"] == "chapter") & u["divided"])))
    zero = F.struct(F.lit(-1).alias("chunk"), F.lit(-1).alias("chapter"), F.lit(0).alias("used"))

    def step(st: Column, u: Column) -> Column:
        cost = F.floor(F.length(u["text"]) / 4).cast("int")
        fits = (u["n"]["type"] == "section") & (u["n"]["parent"] == st["chapter"]) & (st["used"] + cost <= most_tokens)
        return F.struct((st["chunk"] + F.when(fits, 0).otherwise(1)).alias("chunk"), F.when(u["n"]["type"] == "section", u["n"]["parent"]).otherwise(-1).alias("chapter"), F.when(fits, st["used"] + cost).otherwise(cost).alias("used"))

    numbers = arrays.scan(F.col("units"), zero, step, lambda st, u: step(st, u)["chunk"], "int")
    rows = rows.withColumn("numbers", numbers)
    placed = rows.select("doc_id", "nodes", F.explode_outer(F.transform("units", lambda u, i: F.struct(F.get("numbers", i).alias("chunk"), u["n"].alias("n"), u["text"].alias("text"), F.get("nodes", u["n"]["parent"])["number"].alias("up_number"), F.get("nodes", u["n"]["parent"])["title"].alias("up_title")))).alias("u")).select("doc_id", "u.*")
    listed = placed.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("n.node", "n.type", "n.number", "text", "up_number", "up_title"))).alias("m"))
    head, last = F.col("m")[0], F.element_at("m", -1)
    kind = head["type"]
    return listed.select(
        "doc_id", "chunk", F.when(kind == "document", "document_full").when(kind == "chapter", F.concat(F.lit("chapter_"), head["number"])).otherwise(F.concat(F.lit("merged_"), head["number"], F.lit("_to_"), last["number"])).alias("chunk_id"), kind.alias("level"),
        F.when(kind == "chapter", F.concat(F.lit("Document: "), head["up_title"])).when(kind == "section", F.concat(F.lit("Chapter "), head["up_number"], F.lit(": "), head["up_title"])).otherwise("").alias("parent_context"),
        F.when(kind == "section", "token_based_merge").otherwise(F.concat(kind, F.lit("_boundary"))).alias("boundary_rule"), F.transform("m", lambda x: x["node"]).alias("nodes"), F.array_join(F.transform("m", lambda x: x["text"]), "\n\n").alias("text"),
    )


def boundary_check(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, boundary_rule, nodes): chunks (doc_id, chunk_id, boundary_rule, nodes) split where their nodes are of several chapters.

    A node's chapter is the first part of its number. Chunks merged by tokens are left as they are. A part is named by its chapter; the nodes keep their order.
    """
    each = chunks.select("doc_id", "chunk_id", "boundary_rule", F.explode("nodes").alias("node")).join(nodes.select("doc_id", "node", F.substring_index("number", ".", 1).alias("chapter")), ["doc_id", "node"])
    parts = each.groupBy("doc_id", "chunk_id", "boundary_rule", "chapter").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    wholes = parts.groupBy("doc_id", "chunk_id", "boundary_rule").agg(F.collect_list(F.struct("chapter", "nodes")).alias("p"))
    merged = (F.col("boundary_rule") == "token_based_merge") | (F.size("p") == 1)
    kept = F.array(F.struct(F.col("chunk_id").alias("chunk_id"), F.col("boundary_rule").alias("boundary_rule"), F.sort_array(F.flatten(F.transform("p", lambda x: x["nodes"]))).alias("nodes")))
    split = F.transform("p", lambda x: F.struct(F.concat(F.lit("chapter_"), x["chapter"], F.lit("_split")).alias("chunk_id"), F.lit("chapter_boundary_corrected").alias("boundary_rule"), x["nodes"].alias("nodes")))
    return wholes.select("doc_id", F.explode(F.when(merged, kept).otherwise(split)).alias("c")).select("doc_id", "c.*")


def merge_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, id, type, props) of several graphs merged by id, and edges (graph, source, target, type) kept once, from the first graph that has them.

    Graphs are taken in the order of `graph`: the first node of an id gives its type, and of a property the last graph that has it gives its value.
    """
    entries = nodes.select("id", "graph", F.explode_outer("props").alias("key", "value"))
    latest = entries.groupBy("id", "key").agg(F.max(F.struct("graph", "value"))["value"].alias("value")).filter("key IS NOT NULL")
    props = latest.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))
    first = nodes.groupBy("id").agg(F.min(F.struct("graph", "type"))["type"].alias("type"), F.count_distinct("graph").alias("graphs"))
    merged = first.join(props, "id", "left").select("id", "type", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "graphs")
    once = edges.groupBy("source", "target", "type").agg(F.min("graph").alias("graph"))
    return merged, once
