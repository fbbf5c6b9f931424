"""Graphs of documents, keywords and sections as node and edge tables, and questions to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t

from .keywords import per_document

#: Words and patterns by which a text shows its domain, in the order in which domains win ties.
DOMAINS = {
    "technical": ("API function class method algorithm database server framework library code programming software system architecture implementation", [r"\b(def|function|class|import|return)\b", r"\b(HTTP|REST|JSON|XML|SQL)\b", r"\b(server|client|database|API)\b"]),
    "academic": ("research study analysis methodology hypothesis experiment result conclusion literature theory dataset variable correlation statistical", [r"\b(abstract|introduction|methodology|results|conclusion)\b", r"\b(p\s*<\s*0\.05|significant|correlation)\b", r"\b(et\s+al\.|cited|references)\b"]),
    "business": ("revenue profit market customer strategy business sales marketing competition growth investment ROI KPI stakeholder process budget", [r"\$[\d,]+|\b\d+\s*(million|billion|percent|%)\b", r"\b(Q[1-4]|quarterly|annual|fiscal)\b", r"\b(CEO|CFO|CTO|manager|executive)\b"]),
    "legal": ("law legal contract agreement regulation compliance court judge plaintiff defendant liability clause statute precedent jurisdiction penalty", [r"\b(Section|Article|Clause)\s+\d+", r"\b(shall|hereby|whereas|therefore)\b", r"\b(court|judge|plaintiff|defendant)\b"]),
}
#: Of each pattern above, in order, lower-case pieces of which every match has one; looking for them is much cheaper than matching.
PATTERN_PIECES = {
    "technical": (("def", "function", "class", "import", "return"), ("http", "rest", "json", "xml", "sql"), ("server", "client", "database", "api")),
    "academic": (("abstract", "introduction", "methodology", "results", "conclusion"), ("<", "significant", "correlation"), ("al.", "cited", "references")),
    "business": (("$", "million", "billion", "percent", "%"), ("q1", "q2", "q3", "q4", "quarterly", "annual", "fiscal"), ("ceo", "cfo", "cto", "manager", "executive")),
    "legal": (("section", "article", "clause"), ("shall", "hereby", "whereas", "therefore"), ("court", "judge", "plaintiff", "defendant")),
}
#: File extensions that speak for a domain, and words of a document type that do, the first of these that fits.
DOMAIN_EXTENSIONS = {"technical": (".py", ".js", ".java", ".cpp", ".md"), "academic": (".pdf", ".tex", ".docx"), "business": (".xlsx", ".pptx", ".docx", ".pdf"), "legal": (".pdf", ".docx")}
DOMAIN_TYPES = {"academic": ("research", "paper"), "technical": ("technical", "manual"), "business": ("business", "report"), "legal": ("contract", "legal")}
#: The types that the entities of a domain may have.
ENTITY_TYPES = {
    "technical": ("Technology", "API", "Function", "Class", "Database", "Server", "Framework", "Tool", "Algorithm", "Protocol"),
    "academic": ("Author", "Institution", "Research_Method", "Theory", "Dataset", "Experiment", "Citation", "Finding", "Hypothesis", "Variable"),
    "business": ("Company", "Product", "Market", "Stakeholder", "Process", "KPI", "Risk", "Opportunity", "Strategy", "Department"),
    "legal": ("Law", "Regulation", "Contract", "Case", "Party", "Obligation", "Right", "Precedent"),
    "general": ("Person", "Organization", "Event", "Location", "Concept", "Topic"),
}
#: Names and cues by which a keyword shows its type; the first type that fits and that the domain has counts.
TYPES = {
    "Database": ("postgresql", "postgres", "mysql", "mongodb", "sqlite", "oracle", "redis", "cassandra", "elasticsearch", "influxdb", "mariadb"),
    "Framework": ("fastapi", "django", "flask", "react", "vue", "angular", "spring", "express", "laravel", "rails", "nextjs", "nuxt"),
    "Tool": ("docker", "kubernetes", "jenkins", "git", "maven", "gradle", "webpack", "vite", "npm", "yarn"),
    "Language": ("python", "javascript", "java", "c++", "go", "rust", "typescript", "php", "ruby", "kotlin", "swift"),
    "Library": ("sqlalchemy", "pydantic", "numpy", "pandas", "tensorflow", "pytorch", "lodash", "axios", "requests", "beautifulsoup"),
    "Technology": ("api", "system", "platform", "service", "application", "software"),
    "Person": ("author", "researcher", "manager", "director", "ceo"),
    "Organization": ("company", "university", "institute", "corporation"),
    "Concept": ("method", "approach", "technique", "theory", "principle", "pattern", "concept"),
    "Process": ("workflow", "procedure", "protocol", "methodology"),
}
DEFAULT_TYPE = "Technology"


def _scored_domains(text: Column, low: Column) -> list[Column]:
    def matches(pattern: str, pieces: tuple[str, ...]) -> Column:
        may = F.lit(False)
        for piece in pieces:
            may = may | low.contains(piece)
        return F.when(may, text.rlike(f"(?i){pattern}")).otherwise(False).cast("int")

    def score(words: list[str], patterns: list[str], pieces: tuple[tuple[str, ...], ...]) -> Column:
        hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
        found = sum((matches(*p) for p in zip(patterns, pieces, strict=True)), F.lit(0))
        return F.round(hits / len(words) * 0.6 + found / len(patterns) * 0.4, 6)

    return [F.struct(F.lit(n).alias("domain"), F.lit(i).alias("place"), score(w.split(), p, PATTERN_PIECES[n]).alias("score")) for i, (n, (w, p)) in enumerate(DOMAINS.items())]


def domain_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, place, score): shares of a domain's words and patterns that a text has.

    Words are looked up in the lower-cased text as they are spelled, so those in capitals never count.
    """
    lowered = docs.select("doc_id", "text", F.lower("text").alias("low"))
    return lowered.select("doc_id", F.explode(F.array(*_scored_domains(F.col("text"), F.col("low")))).alias("d")).select("doc_id", "d.domain", "d.place", "d.score")


def with_domain(docs: DataFrame) -> DataFrame:
    """Documents with their `domain`: the one with the best score, the first declared of equals; an empty or null text has the first."""
    lowered = docs.withColumn("low", F.lower(F.coalesce("text", F.lit(""))))  # a column of its own, or it would be made anew for every word
    best = F.array_max(F.array(*[F.struct(d["score"], -d["place"], d["domain"].alias("domain")) for d in _scored_domains(F.coalesce("text", F.lit("")), F.col("low"))]))
    return lowered.withColumn("domain", best["domain"]).drop("low")


def domain_adjust(scores: DataFrame, extension: Column, document_type: Column | None = None) -> DataFrame:
    """Scores with .2 for a domain's file extension and .3 for the domain of the document's type."""
    kind, by_type = F.lower(F.coalesce(document_type, F.lit(""))) if document_type is not None else F.lit(""), F.lit(None).cast("string")
    for domain, cues in reversed(DOMAIN_TYPES.items()):
        by_type = F.when(kind.contains(cues[0]) | kind.contains(cues[1]), domain).otherwise(by_type)
    by_name = F.lit(False)
    for domain, extensions in DOMAIN_EXTENSIONS.items():
        by_name = by_name | (F.col("domain") == domain) & extension.isin(*extensions)
    plus = F.when(by_name, 0.2).otherwise(0.0) + F.when(F.col("domain") == by_type, 0.3).otherwise(0.0)
    return scores.withColumn("score", F.round(F.col("score") + plus, 6))


def best_domain(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "place")
    return scores.withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc_id", "domain", "score")


def entity_type(keyword: Column, domain: Column | None = None) -> Column:
    """The type of a keyword among those of its domain (the technical one, if none is given); else Technology or the domain's first type."""
    low, of = F.lower(keyword), domain if domain is not None else F.lit("technical")
    out = F.lit(None).cast("string")
    for name, kinds in reversed(ENTITY_TYPES.items()):
        found = F.lit(DEFAULT_TYPE if DEFAULT_TYPE in kinds else kinds[0])
        for kind, cues in reversed(TYPES.items()):
            if kind in kinds:
                fits = F.lit(False)
                for cue in cues:
                    fits = fits | low.contains(cue)
                found = F.when(fits, kind).otherwise(found)
        out = F.when(of == name, found).otherwise(out) if name != "general" else found
    return out


def graph_id(name: Column) -> Column:
    return F.substring(F.sha1(name), 1, 16)


def build(docs: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, domain) and edges (source, target, type, n): documents and the keywords they mention."""
    documents = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("Document").alias("type"), F.concat_ws("/", "source", "doc_id").alias("name"), F.col("lang").alias("domain"))
    words = keywords.select(F.lower("keyword").alias("name")).distinct().select(graph_id(F.col("name")).alias("id"), entity_type(F.col("name")).alias("type"), "name", F.lit("word").alias("domain"))
    edges = keywords.groupBy("doc_id", F.lower("keyword").alias("k")).agg(F.sum("n").alias("n")).select(F.concat(F.lit("d"), "doc_id").alias("source"), graph_id(F.col("k")).alias("target"), F.lit("MENTIONS").alias("type"), "n")
    return documents.unionByName(words), edges


def pairs_within(keywords: DataFrame) -> DataFrame:
    """Unordered pairs of a document's keywords, the better ranked first."""
    a, b = keywords.alias("a"), keywords.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.rank") < F.col("b.rank"))).select(F.col("a.doc_id").alias("doc_id"), F.col("a.keyword").alias("source"), F.col("b.keyword").alias("target"))


def shared_sentences(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """Sentences that name more than one of their document's keywords, as whole words in any case."""
    found = per_document(keywords.select("doc_id", "keyword"), docs)
    sentences = found.select("doc_id", "found", F.posexplode(F.split("text", "[.!?]+")).alias("i", "sentence"))
    words = sentences.select("doc_id", "i", "found", F.regexp_extract_all(F.lower("sentence"), F.lit(t.TOKEN), 0).alias("words"))
    named = F.size(F.filter("found", lambda x: F.array_contains(F.col("words"), F.lower(x["keyword"]))))
    return words.select("doc_id", "i", named.cast("bigint").alias("named")).filter("named > 1")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source"] == ids["id"], "left_anti").union(edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, F.col("target") == ids["id"], "left_anti"))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New properties overwrite old ones; nodes are told by type and id."""
    both = nodes.alias("o").join(new.alias("n"), ["type", "id"], "full")
    return both.select("type", "id", F.coalesce("n.name", "o.name").alias("name"), F.coalesce("n.domain", "o.domain").alias("domain"))


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges count only between known nodes; one with the same ends and type replaces the old."""
    ids = nodes.select("id").distinct()
    sound = new.join(ids, new["source"] == ids["id"], "left_semi").join(ids, F.col("target") == ids["id"], "left_semi").withColumn("type", F.regexp_replace("type", "[- ]", "_"))
    return edges.join(sound, ["source", "type", "target"], "left_anti").select(*edges.columns).unionByName(sound.select(*edges.columns))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id")).unionAll(edges.select("target"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    label = F.regexp_replace(F.regexp_replace("type", "[^A-Za-z0-9_]", "_"), "^([0-9])", "n$1")
    return nodes.select(F.concat(F.lit("CREATE (:"), label, F.lit(" {id: "), quoted(F.col("id")), F.lit(", name: "), quoted(F.col("name")), F.lit("});")).alias("line"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("MATCH (a {id: "), quoted(F.col("source")), F.lit("}), (b {id: "), quoted(F.col("target")), F.lit("}) CREATE (a)-[:"), "type", F.lit("]->(b);")).alias("line"))


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    name = F.col("name")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        name = F.replace(name, F.lit(raw), F.lit(safe))
    return nodes.select(F.concat(F.lit('<node id="'), "id", F.lit('"><data key="type">'), "type", F.lit('</data><data key="name">'), name, F.lit("</data></node>")).alias("line"))


def depths(parents: DataFrame) -> DataFrame:
    """(doc_id, line_no, depth): the distance of each section to its root."""
    return parents.select("doc_id", "line_no", F.size("path").alias("depth"))
