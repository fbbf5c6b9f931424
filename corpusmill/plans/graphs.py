"""Queries that build, export and question graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import graph as g
from corpusmill.operators import keywords as k
from corpusmill.operators import structure as st

from .extraction import D_OCC
from .structure import D_SECTIONS, headed
from .texts import docs

ALL: dict = {}


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


def _simple(s, d):
    return k.simple_keywords(docs(s, d))


def _over(name: str, run, sql: str) -> None:
    """A query over the graph of documents and their keywords."""
    add(name, lambda s, d: run(*g.build(docs(s, d), _simple(s, d))), f"WITH {D_OCC}, {D_GRAPH} {sql}")


#: The types of keywords in the technical domain, spelled out.
_TYPES = (
    "WHEN regexp_matches(name, 'postgresql|postgres|mysql|mongodb|sqlite|oracle|redis|cassandra|elasticsearch|influxdb|mariadb') THEN 'Database' "
    "WHEN regexp_matches(name, 'fastapi|django|flask|react|vue|angular|spring|express|laravel|rails|nextjs|nuxt') THEN 'Framework' WHEN regexp_matches(name, 'docker|kubernetes|jenkins|git|maven|gradle|webpack|vite|npm|yarn') THEN 'Tool'"
)
D_GRAPH = f"""kwn AS (SELECT DISTINCT lower(keyword) AS name FROM simple),
nodes AS (SELECT concat('d', doc_id) AS id, 'Document' AS type, concat_ws('/', source, doc_id) AS name, lang AS domain FROM documents UNION ALL SELECT substr(sha1(name), 1, 16), CASE {_TYPES} ELSE '{g.DEFAULT_TYPE}' END, name, 'word' FROM kwn),
edges AS (SELECT concat('d', doc_id) AS source, substr(sha1(lower(keyword)), 1, 16) AS target, 'MENTIONS' AS type, CAST(sum(n) AS BIGINT) AS n FROM simple GROUP BY doc_id, lower(keyword))"""


def _d_score(words: str, patterns: list[str]) -> str:
    w = words.split()
    hits = " + ".join(f"CAST(contains(lower(text), '{x}') AS INT)" for x in w)
    found = " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INT)" for p in patterns)
    return f"round(({hits}) / {len(w)} * 0.6 + ({found}) / {len(patterns)} * 0.4, 6)"


D_SCORES = "sc AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS domain, {i} AS place, {_d_score(w, p)} AS score FROM documents" for i, (n, (w, p)) in enumerate(g.DOMAINS.items())) + ")"
add("k02_domain_score", lambda s, d: g.domain_scores(docs(s, d)), f"WITH {D_SCORES} SELECT * FROM sc")
add(
    "k03_domain_adjust",
    lambda s, d: g.domain_adjust(
        g.domain_scores(docs(s, d)), F.get(F.array(*map(F.lit, (".md", ".pdf", ".docx", ".xlsx", ".tex", ".txt"))), (F.col("doc_id") % 6).cast("int")),
        F.get(F.array(*map(F.lit, ("", "Research paper", "technical manual", "Annual report", "contract"))), (F.col("doc_id") % 5).cast("int")),
    ),
    f"WITH {D_SCORES} SELECT doc_id, domain, place, round(score + CASE WHEN (domain, doc_id % 6) IN (('technical', 0), ('academic', 1), ('business', 1), ('legal', 1), ('academic', 2), ('business', 2), ('legal', 2), ('business', 3), ('academic', 4)) THEN 0.2 ELSE 0 END "
    "+ CASE WHEN (domain, doc_id % 5) IN (('academic', 1), ('technical', 2), ('business', 3), ('legal', 4)) THEN 0.3 ELSE 0 END, 6) AS score FROM sc",
)
add("k04_domain_detect", lambda s, d: g.best_domain(g.domain_scores(docs(s, d))), f"WITH {D_SCORES} SELECT doc_id, domain, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1")
#: Words of each type, added to keywords by rank.
_TYPED = ("Redis", "Flask", "Git", "Python", "Numpy", "Software", "Researcher", "University", "Theory", "Workflow")
add(
    "k05_entity_type",
    lambda s, d: _simple(s, d).select(
        F.concat(F.col("keyword"), F.get(F.array(*map(F.lit, _TYPED)), F.col("rank").cast("int") - 1)).alias("name"),
        F.get(F.array(*map(F.lit, ("technical", "academic", "business", "legal", "general"))), (F.col("doc_id") % 5).cast("int")).alias("domain"),
    ).distinct().select("name", "domain", g.entity_type(F.col("name"), F.col("domain")).alias("type")),
    f"""WITH {D_OCC}, x AS (SELECT DISTINCT keyword || {list(_TYPED)!r}[rank] AS full_name, ['technical', 'academic', 'business', 'legal', 'general'][doc_id % 5 + 1] AS domain FROM simple), y AS (SELECT full_name, domain, lower(full_name) AS name FROM x)
SELECT full_name AS name, domain, CASE domain WHEN 'technical' THEN CASE {_TYPES} ELSE 'Technology' END WHEN 'academic' THEN 'Author'
WHEN 'business' THEN CASE WHEN regexp_matches(name, 'workflow|procedure|protocol|methodology') THEN 'Process' ELSE 'Company' END WHEN 'legal' THEN 'Law'
ELSE CASE WHEN regexp_matches(name, 'author|researcher|manager|director|ceo') THEN 'Person' WHEN regexp_matches(name, 'company|university|institute|corporation') THEN 'Organization' WHEN regexp_matches(name, 'method|approach|technique|theory|principle|pattern|concept') THEN 'Concept' ELSE 'Person' END END AS type FROM y""",
)
add("k08_keyword_entities", lambda s, d: k.multi_extract(docs(s, d), ["simple", "freq"]).groupBy(g.graph_id(F.lower("keyword")).alias("id"), "extractor").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n")), f"WITH {D_OCC} SELECT substr(sha1(lower(keyword)), 1, 16) AS id, extractor, max(score) AS score, count(*) AS n FROM occ WHERE extractor IN ('simple', 'freq') GROUP BY ALL")
add("k13_structure_depth", lambda s, d: g.depths(st.section_parents(st.sections(headed(s, d)))), f"WITH RECURSIVE {D_SECTIONS}, sp AS (SELECT a.doc_id, a.line_no, max(b.line_no) AS parent_line FROM sec a LEFT JOIN sec b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.level < a.level GROUP BY ALL), walk AS (SELECT doc_id, line_no, 0 AS depth FROM sp WHERE parent_line IS NULL UNION ALL SELECT p.doc_id, p.line_no, w.depth + 1 FROM sp p JOIN walk w ON p.doc_id = w.doc_id AND p.parent_line = w.line_no) SELECT doc_id, line_no, CAST(depth AS INT) AS depth FROM walk")
add("k14_pair_candidates", lambda s, d: g.pairs_within(_simple(s, d)), f"WITH {D_OCC} SELECT a.doc_id, a.keyword AS source, b.keyword AS target FROM simple a JOIN simple b ON a.doc_id = b.doc_id AND a.rank < b.rank")
add("k20_shared_sentences", lambda s, d: g.shared_sentences(docs(s, d), _simple(s, d)), f"WITH {D_OCC}, se AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+')) AS sentence, generate_subscripts(string_split_regex(text, '[.!?]+'), 1) - 1 AS i FROM documents) SELECT doc_id, CAST(i AS INT) AS i, count(*) AS named FROM se JOIN simple USING (doc_id) WHERE list_contains(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+'), lower(keyword)) GROUP BY doc_id, i HAVING count(*) > 1")
_over("k22_chunk_graph_merge", lambda n, e: e.join(n.groupBy("type", "name").agg(F.min("id").alias("to")).join(n, ["type", "name"]).select("id", "to"), F.col("target") == F.col("id")).select("source", F.col("to").alias("target"), "n"), "SELECT source, target, n FROM edges")
_over("k23_assign_ids", lambda n, e: e.select(F.sha1(F.concat_ws("|", "source", "type", "target")).alias("edge_id"), "n"), "SELECT sha1(concat_ws('|', source, type, target)) AS edge_id, n FROM edges")
_over("k24_graph_stats", lambda n, e: n.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("edges"))), F.lit(True)).withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 4)), "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 4) AS density")
_over("q01_graph_upsert_nodes", lambda n, e: g.upsert_nodes(n, n.filter("type = 'Document'").withColumn("domain", F.lit("new"))), "SELECT type, id, name, CASE WHEN type = 'Document' THEN 'new' ELSE domain END AS domain FROM nodes")
_over("q02_graph_upsert_edges", lambda n, e: g.upsert_edges(e, e.filter("n > 3").withColumn("n", F.col("n") * 10).unionByName(e.limit(5).withColumn("target", F.lit("none"))), n), "SELECT source, target, type, CASE WHEN n > 3 THEN n * 10 ELSE n END AS n FROM edges")
_over("q03_graph_delete_document", lambda n, e: e.filter("source <> 'd7'"), "SELECT * FROM edges WHERE source <> 'd7'")
_over("q04_document_subgraph", lambda n, e: e.filter("source IN ('d7', 'd8')").join(n, F.col("target") == F.col("id")).select("source", "name", n["type"]), "SELECT source, name, nodes.type FROM edges JOIN nodes ON target = id WHERE source IN ('d7', 'd8')")
_over("q05_entity_search", lambda n, e: n.filter((F.col("type") == "Technology") & F.col("name").contains("tion")).orderBy("id").limit(100), "SELECT * FROM nodes WHERE type = 'Technology' AND contains(name, 'tion') ORDER BY id LIMIT 100")
_over("q06_graph_counts", lambda n, e: n.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(e.groupBy("type").agg(F.count(F.lit(1)).alias("n"))), "SELECT type, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT type, count(*) FROM edges GROUP BY 1")
_over("q07_induced_subgraph", lambda n, e: (lambda top: e.join(top, F.col("source") == F.col("id"), "left_semi").join(n.filter("type <> 'Document'").select("id"), F.col("target") == F.col("id"), "left_semi"))(n.filter("type = 'Document'").orderBy("id").limit(100).select("id")), "SELECT * FROM edges WHERE source IN (SELECT id FROM nodes WHERE type = 'Document' ORDER BY id LIMIT 100)")


def graph_sql(nodes, edges, text: str):
    """A free SQL query over the views nodes and edges."""
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    return nodes.sparkSession.sql(text)


_SQL = "SELECT domain, count(*) AS n, sum(e.n) AS mentions FROM nodes JOIN edges e ON id = source GROUP BY domain"
_over("q08_graph_sql", lambda n, e: graph_sql(n, e, _SQL), "SELECT domain, count(*) AS n, CAST(sum(e.n) AS BIGINT) AS mentions FROM nodes JOIN edges e ON id = source GROUP BY domain")
_over("q09_dangling_edges", lambda n, e: g.dangling(n.filter("NOT (type = 'Document' AND id LIKE '%7')"), e), "SELECT * FROM edges WHERE source LIKE '%7'")
_over("q15_domain_counts", lambda n, e: n.groupBy("domain").agg(F.count(F.lit(1)).alias("n")), "SELECT domain, count(*) AS n FROM nodes GROUP BY domain")
_over("q16_linked_documents", lambda n, e: e.join(n.filter(F.col("name").contains("heit")), F.col("target") == F.col("id")).select("source").distinct(), "SELECT DISTINCT source FROM edges JOIN nodes ON target = id WHERE contains(name, 'heit')")
_over("q17_hub_entities", lambda n, e: g.degrees(e).orderBy(F.desc("degree"), "id").limit(10), "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 10")
_over("a11_graph_export_json", lambda n, e: n.select(F.to_json(F.struct("id", "type", "name")).alias("line")), "SELECT concat('{\"id\":\"', id, '\",\"type\":\"', type, '\",\"name\":\"', name, '\"}') AS line FROM nodes")
_over("a12_graph_export_cypher", lambda n, e: g.cypher_nodes(n).union(g.cypher_edges(e)), "SELECT concat('CREATE (:', type, ' {id: ''', id, ''', name: ''', name, '''});') AS line FROM nodes UNION ALL SELECT concat('MATCH (a {id: ''', source, '''}), (b {id: ''', target, '''}) CREATE (a)-[:', type, ']->(b);') FROM edges")
_over("a13_graph_export_graphml", lambda n, e: g.graphml_nodes(n), "SELECT concat('<node id=\"', id, '\"><data key=\"type\">', type, '</data><data key=\"name\">', name, '</data></node>') AS line FROM nodes")
_over("a15_property_serialise", lambda n, e: n.select("id", F.to_json(F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("domain"), F.nullif(F.col("domain"), F.lit("word"))), lambda k, v: v.isNotNull())).alias("props")), "SELECT id, concat('{', concat_ws(',', concat('\"name\":\"', name, '\"'), CASE WHEN domain <> 'word' THEN concat('\"domain\":\"', domain, '\"') END), '}') AS props FROM nodes")
add("a10_results_json_scan", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "map<string,string>").alias("m")).select("event_id", F.explode("m").alias("key", "value")), "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
