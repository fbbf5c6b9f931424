"""The structure graph: sections, tables, lists, images and paragraphs of documents with their extents, and the entities in them.

A document's structures come from one ordered pass over its own lines, so no line leaves its row. A section reaches from its heading to the line
before the next heading of its level or a smaller one; the other structures are runs of lines of one kind, ended by blank lines and
headings. The innermost structure holds a line; headings are the only lines that a section holds itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import arrays
from corpusmill.functions import text as t

from . import graph
from .structure import section_level, section_number, section_style, section_title

DEFAULT_TITLE = "Default Section"
#: Cues in a context, by relation; and for each domain the relations that have cues, in the order in which they are tried.
RELATION_CUES = {
    "DEPENDS_ON": ("depends", "require", "need", "rely"), "IMPLEMENTS": ("implement", "realize", "execute"), "USES": ("use", "utilize", "employ", "apply"), "CALLS": ("call", "invoke", "execute", "trigger"),
    "CITES": ("cite", "reference", "quote", "mention"), "PROVES": ("prove", "demonstrate", "show", "evidence"), "SUPPORTS": ("support", "back", "endorse", "confirm"), "CONTRADICTS": ("contradict", "oppose", "conflict", "disagree"),
    "CONTAINS": ("contain", "include", "comprise", "consist"),
}
DOMAIN_RELATIONS = {"technical": ("DEPENDS_ON", "USES", "IMPLEMENTS", "CALLS"), "academic": ("CITES", "CONTRADICTS", "PROVES", "SUPPORTS"), "business": ("DEPENDS_ON", "SUPPORTS"), "legal": (), "general": ("CONTAINS",)}
DEFAULT_RELATION = "ASSOCIATED_WITH"
#: What an entity of a domain and type has besides its own properties.
ENTITY_PROPERTIES = {("technical", "Technology"): {"category": "software", "maturity": "stable"}, ("academic", "Author"): {"field": "research", "h_index": None}}

_OPEN = "array<struct<level: int, node: int>>"


def _line_kind(s: Column, style: Column) -> Column:
    return (
        F.when(style.isNotNull(), "Section").when(s == "", "").when(s.rlike(r"^\|.*\|$"), "Table").when(s.rlike(r"^!\[.*\]\(.*\)$"), "Image").when(s.rlike(r"^[-*+•]\s+."), "List").otherwise("Paragraph")
    )


def document_structures(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, *carried, nodes): each document's structures as one array, in line order.

    Explode `nodes`, which are never empty, by explode_outer: for explode the optimizer infers a filter that repeats the whole pass.

    A node has: node (from 0), type, number, title, level (null beside sections), first_line and last_line (from 1), start and end (offsets, the end
    exclusive), path (the sections around it, the outermost first) and content (its own lines; a section's is its heading). A document
    without a heading has a default section over all its lines first; a null text is empty. Equal headings are different nodes.
    """
    at = lambda array, i: F.get(array, i)
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.select("doc_id", *carried, F.transform(split, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.trim(x).alias("s"))).alias("l"))
    rows = rows.withColumn("starts", arrays.starts(F.transform("l", lambda x: F.length(x["line"]) + 1)))
    neighbour = lambda i: F.coalesce(at(F.col("l"), i)["s"], F.lit(""))
    rows = rows.withColumn("styles", F.transform("l", lambda x, i: section_style(x["s"], neighbour(i - 1), neighbour(i + 1))))
    rows = rows.withColumn("kinds", F.transform("l", lambda x, i: _line_kind(x["s"], at(F.col("styles"), i))))
    first = lambda x, i: (at(F.col("kinds"), i) == "Section") | (i == 0) | (at(F.col("kinds"), i) != at(F.col("kinds"), i - 1))
    rows = rows.withColumn("firsts", F.filter("l", first))

    def run(x: Column, i: Column) -> Column:
        place = x["line_no"] - 1
        kind, style, head = at(F.col("kinds"), place), at(F.col("styles"), place), x["s"]
        section = kind == "Section"
        return F.struct(
            kind.alias("type"), F.when(section, section_number(style, head)).alias("number"), F.when(section, section_title(style, head)).alias("title"), F.when(section, section_level(style, head)).alias("level"),
            x["line_no"].alias("first_line"), F.coalesce(at(F.col("firsts"), i + 1)["line_no"] - 1, F.size("l")).alias("last_line"), at(F.col("starts"), place).alias("start"),
        )

    rows = rows.withColumn("runs", F.filter(F.transform("firsts", run), lambda r: r["type"] != ""))
    default = F.struct(F.lit("Section").alias("type"), F.lit(None).cast("string").alias("number"), F.lit(DEFAULT_TITLE).alias("title"), F.lit(1).alias("level"), F.lit(1).alias("first_line"), F.size("l").alias("last_line"), F.lit(0).alias("start"))
    headless = ~F.exists("runs", lambda r: r["type"] == "Section")
    rows = rows.withColumn("headless", headless).withColumn("runs", F.when(headless, F.concat(F.array(default), F.col("runs"))).otherwise(F.col("runs")))
    rows = rows.withColumn("runs", F.transform("runs", lambda r, i: r.withField("node", i)))
    # forwards, the open sections are those around; backwards, the nearest later heading of no deeper level ends a section
    around = lambda open_, r: F.when(r["type"] == "Section", F.filter(open_, lambda o: o["level"] < r["level"])).otherwise(open_)
    opened = lambda open_, r: F.when(r["type"] == "Section", F.concat(around(open_, r), F.array(F.struct(r["level"].alias("level"), r["node"].alias("node"))))).otherwise(open_)
    paths = arrays.scan(F.col("runs"), F.array().cast(_OPEN), opened, lambda open_, r: F.transform(around(open_, r), lambda o: o["node"]), "array<int>")
    later = lambda open_, r: F.filter(open_, lambda o: o["level"] <= r["level"])
    closed = lambda open_, r: F.when(r["type"] == "Section", F.concat(later(open_, r), F.array(F.struct(r["level"].alias("level"), r["first_line"].alias("node"))))).otherwise(open_)
    ends = F.reverse(arrays.scan(F.reverse("runs"), F.array().cast(_OPEN), closed, lambda open_, r: F.when(r["type"] == "Section", F.try_element_at(later(open_, r), F.lit(-1))["node"] - 1), "int"))
    rows = rows.withColumn("paths", paths).withColumn("ends", ends)

    def node(r: Column, i: Column) -> Column:
        section = r["type"] == "Section"
        last = F.when(section, F.coalesce(at(F.col("ends"), i), F.size("l"))).otherwise(r["last_line"])
        own = F.when(F.col("headless") & section, 0).when(section, 1).otherwise(r["last_line"] - r["first_line"] + 1)
        return F.struct(
            r["node"].alias("node"), r["type"].alias("type"), r["number"].alias("number"), r["title"].alias("title"), r["level"].alias("level"), r["first_line"].alias("first_line"), last.alias("last_line"), r["start"].alias("start"),
            (at(F.col("starts"), last - 1) + F.length(at(F.col("l"), last - 1)["line"])).alias("end"), at(F.col("paths"), i).alias("path"),
            F.array_join(F.transform(F.slice("l", r["first_line"], own), lambda x: x["line"]), "\n").alias("content"),
        )

    return rows.select("doc_id", *carried, F.transform("runs", node).alias("nodes"))


def structures(docs: DataFrame) -> DataFrame:
    """`document_structures`, a row for each node; `parent` is the nearest section around it, null below the document itself."""
    rows = document_structures(docs).select("doc_id", F.explode_outer("nodes").alias("n")).select("doc_id", "n.*")
    return rows.withColumn("parent", F.try_element_at("path", F.lit(-1)))


def document_node(doc: Column) -> Column:
    return F.concat(F.lit("d"), doc)


def structure_node(doc: Column, kind: Column, node: Column) -> Column:
    return F.concat_ws("_", F.lower(kind), document_node(doc), node)


def structure_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, doc_id, domain, title, level, first_line, last_line, start, end, preview, has_content) and CONTAINS_STRUCTURE edges
    (source, target, type, relationship_name, first_line, domain) from the document or the section around to each structure.
    """
    placed = graph.with_domain(docs.select("doc_id", "text"))
    rows = document_structures(placed, "domain").select("doc_id", "domain", F.explode_outer("nodes").alias("n"))
    identity = structure_node(F.col("doc_id"), F.col("n.type"), F.col("n.node"))
    parent = F.try_element_at("n.path", F.lit(-1))
    nodes = rows.select(
        identity.alias("id"), "n.type", "doc_id", "domain", "n.title", "n.level", "n.first_line", "n.last_line", "n.start", "n.end", F.substring("n.content", 1, 100).alias("preview"), (F.col("n.content") != "").alias("has_content")
    )
    edges = rows.select(
        F.when(parent.isNull(), document_node(F.col("doc_id"))).otherwise(structure_node(F.col("doc_id"), F.lit("section"), parent)).alias("source"), identity.alias("target"), F.lit("CONTAINS_STRUCTURE").alias("type"),
        F.concat(F.lit("CONTAINS_"), F.upper("n.type")).alias("relationship_name"), "n.first_line", "domain",
    )
    return nodes, edges


def relation_by_context(context: Column, domain: Column) -> Column:
    """The first relation of the domain's schema with a cue in the lower-cased context, else the default; unknown domains are general."""
    low, out = F.lower(context), F.lit(None).cast("string")
    known = F.when(domain.isin(*DOMAIN_RELATIONS), domain).otherwise("general")
    for name, relations in DOMAIN_RELATIONS.items():
        found = F.lit(DEFAULT_RELATION)
        for relation in reversed(relations):
            fits = F.lit(False)
            for cue in RELATION_CUES[relation]:
                fits = fits | low.contains(cue)
            found = F.when(fits, relation).otherwise(found)
        out = F.when(known == name, found).otherwise(out)
    return out


def entity_properties(kind: Column, domain: Column) -> Column:
    """What an entity of this type and domain has besides, as a map; empty for most."""
    out = F.create_map().cast("map<string,string>")
    for (d, k), properties in ENTITY_PROPERTIES.items():
        out = F.when((domain == d) & (kind == k), F.create_map(*[F.lit(x).cast("string") for pair in properties.items() for x in pair])).otherwise(out)
    return out


def entity_words(keywords: DataFrame) -> DataFrame:
    """(doc_id, extractor, word, score, category): the words of keywords of two characters or more, lower-cased, the best score of each."""
    words = keywords.filter(F.length("keyword") >= 2).select("doc_id", "extractor", "score", "category", F.explode(t.keyword_to_words(F.col("keyword"))).alias("word")).filter(F.length("word") >= 2)
    return words.groupBy("doc_id", "extractor", F.lower("word").alias("word")).agg(F.max("score").alias("score"), F.min("category").alias("category"))


def structure_entities(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, node, type, title, path, context, domain, extractor, word, score, category, entity_type, structure_id, id): one row for each word, extractor
    and innermost structure that has the word in its own lower-cased content.

    A word in no structure's content goes to the document's first structure. A document's words meet its text in one row.
    """
    listed = entity_words(keywords).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("extractor", "word", "score", "category"))).alias("words"))
    both = graph.with_domain(docs.select("doc_id", "text").join(listed, "doc_id"))
    rows = document_structures(both, "domain", "words")
    low = F.transform("nodes", lambda n: F.lower(n["content"]))
    hits = rows.withColumn("hits", F.transform(low, lambda c: F.filter("words", lambda w: c.contains(w["word"]))))
    lost = hits.withColumn("lost", F.array_except("words", F.flatten("hits")))
    owned = F.transform("nodes", lambda n, i: F.struct(n.alias("n"), F.when(i == 0, F.concat(F.get("hits", i), F.col("lost"))).otherwise(F.get("hits", i)).alias("words")))
    each = lost.select("doc_id", "domain", F.explode_outer(owned).alias("o")).select("doc_id", "domain", "o.n", F.explode("o.words").alias("w"))
    found = each.select(
        "doc_id", "n.node", "n.type", "n.title", "n.path", F.substring("n.content", 1, 200).alias("context"), "domain", "w.*", graph.entity_type(F.col("w.word"), F.col("domain")).alias("entity_type"),
        structure_node(F.col("doc_id"), F.col("n.type"), F.col("n.node")).alias("structure_id"),
    )
    return found.withColumn("id", F.concat_ws("_", F.lower("entity_type"), graph.graph_id(F.col("word")), graph.graph_id(F.col("structure_id")), F.col("extractor")))


def entity_nodes(entities: DataFrame) -> DataFrame:
    """Entity nodes with their properties, those of their type and domain as JSON."""
    return entities.select("id", F.col("entity_type").alias("type"), F.col("word").alias("text"), "domain", F.col("structure_id").alias("source_structure"), F.col("type").alias("source_structure_type"), "extractor", "score", "category", F.to_json(entity_properties(F.col("entity_type"), F.col("domain"))).alias("props"))


def entity_edges(entities: DataFrame) -> DataFrame:
    """RELATED_TO edges from each structure to its entities, named by the cues in its content."""
    return entities.select(
        F.col("structure_id").alias("source"), F.col("id").alias("target"), F.lit("RELATED_TO").alias("type"), relation_by_context(F.col("context"), F.col("domain")).alias("relationship_name"), "extractor",
        F.col("score").alias("confidence"), F.substring("context", 1, 100).alias("context_snippet"), "domain",
    )


def entities_by_section(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, node, title, entities): how many entities lie within each section's extent, in the structures below it too."""
    own = F.when(F.col("type") == "Section", F.concat("path", F.array("node"))).otherwise(F.col("path"))
    counts = entities.select("doc_id", F.explode(own).alias("node")).groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("entities"))
    titles = structures(docs).filter("type = 'Section'").select("doc_id", "node", "title")
    return counts.join(titles, ["doc_id", "node"])


def table_pairs(entities: DataFrame) -> DataFrame:
    """(doc_id, node, source, target): ordered pairs of different entities of one table."""
    listed = entities.filter("type = 'Table'").groupBy("doc_id", "node").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b != a), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return listed.select("doc_id", "node", F.explode(pairs).alias("p")).select("doc_id", "node", "p.*")


def depth_distribution(entities: DataFrame) -> DataFrame:
    """(type, depth, entities): entities by the type of their structure and its distance to the document."""
    return entities.groupBy("type", (F.size("path") + 1).alias("depth")).agg(F.count(F.lit(1)).alias("entities"))


def domain_patterns(entities: DataFrame) -> DataFrame:
    return entities.groupBy("domain", "type", "entity_type").agg(F.count(F.lit(1)).alias("n"))
