"""Queries of the structure graph and of relations between entities, over whole texts with structure lines, which the tables lack, put between their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import hierarchy as h
from corpusmill.operators import keywords as k
from corpusmill.operators import relations as rel

from .extraction import D_OCC
from .graphs import D_SCORES
from .structure import D_HEADED, D_SECTIONS
from .texts import docs

ALL: dict = {}


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


#: The same expression in both engines: a first part that shows a domain, with a table, a list and an image.
_HEAD = (
    "concat(CASE doc_id % 4 WHEN 0 THEN concat('# Overview', chr(10), 'FastAPI is a software server framework that depends on PostgreSQL, Redis and SQLAlchemy. Docker runs it') "
    "WHEN 1 THEN concat('# Overview', chr(10), 'The author of this research study mentions theory, dataset and experiment of the analysis') "
    "WHEN 2 THEN 'The company strategy of this market supports revenue, profit and customer budget' ELSE concat('# Overview', chr(10), 'The contract is a legal agreement 사용 of the court and the law, its clause and liability') END, chr(10), "
    "'| name | tool |', chr(10), '| --- | --- |', chr(10), '| Redis | Docker |', chr(10), '| ', coalesce(source, ''), ' | PostgreSQL contract |', chr(10), '- item about ', coalesce(source, ''), chr(10), '- second item', chr(10), "
    "'![chart of ', coalesce(source, ''), '](c.png)', chr(10))"
)


def structured(s, d):
    """Documents with headings of three levels, lists, tables and blank lines put between their lines, which stay whole."""
    line = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def put(x, i):
        depth = F.when((F.floor(i / 6) % 3) == 0, "").when((F.floor(i / 6) % 3) == 1, ".1").otherwise(".1.2")
        return (
            F.when(i % 6 == 0, F.array(F.concat(i + 1, depth, F.lit(". "), F.substring(x, 1, 30)), x)).when(i % 6 == 2, F.array(F.concat(F.lit("## "), F.substring(x, 1, 30)), x)).when(i % 6 == 3, F.array(F.lit(""), x))
            .when(i % 6 == 4, F.array(F.concat(F.lit("- "), F.substring(x, 1, 40)), F.concat(F.lit("* "), F.substring(x, 41, 40)), x))
            .when(i % 6 == 5, F.array(F.concat(F.lit("| "), F.substring(x, 1, 20), F.lit(" | b |")), F.lit("| --- | --- |"), x)).otherwise(F.array(x))
        )

    return docs(s, d).select("doc_id", F.concat(F.expr(_HEAD), F.array_join(F.flatten(F.transform(line, put)), "\n")).alias("text"))


D_STRUCTURED = (
    f"hd AS (SELECT doc_id, {_HEAD} || array_to_string(flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE (i - 1) % 6 "
    "WHEN 0 THEN [concat(i, CASE ((i - 1) // 6) % 3 WHEN 0 THEN '' WHEN 1 THEN '.1' ELSE '.1.2' END, '. ', substr(x, 1, 30)), x] WHEN 2 THEN ['## ' || substr(x, 1, 30), x] WHEN 3 THEN ['', x] "
    "WHEN 4 THEN ['- ' || substr(x, 1, 40), '* ' || substr(x, 41, 40), x] WHEN 5 THEN ['| ' || substr(x, 1, 20) || ' | b |', '| --- | --- |', x] ELSE [x] END)), chr(10)) AS text FROM documents)"
)
D_NODES = f"""{D_STRUCTURED}{D_SECTIONS.removeprefix(D_HEADED)},
stl AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS n_lines,
 CASE WHEN style IS NOT NULL THEN 'Section' WHEN s = '' THEN '' WHEN regexp_matches(s, '^\\|.*\\|$') THEN 'Table' WHEN regexp_matches(s, '^!\\[.*\\]\\(.*\\)$') THEN 'Image' WHEN regexp_matches(s, '^[-*+•]\\s+.') THEN 'List' ELSE 'Paragraph' END AS kind FROM sty),
fi AS (SELECT * FROM stl QUALIFY kind = 'Section' OR lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) IS DISTINCT FROM kind),
ru AS (SELECT *, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, n_lines) AS last_run FROM fi),
rs AS (SELECT doc_id, line_no AS first_line, last_run, kind, start, n_lines, false AS def FROM ru WHERE kind <> '' UNION ALL SELECT doc_id, 1, n_lines, 'Section', 0, n_lines, true FROM stl WHERE line_no = 1 AND doc_id NOT IN (SELECT doc_id FROM sec)),
nn AS (SELECT rs.*, sec.number, CASE WHEN def THEN 'Default Section' ELSE sec.title END AS title, CASE WHEN def THEN 1 ELSE sec.level END AS level, CAST(row_number() OVER (PARTITION BY rs.doc_id ORDER BY def DESC, first_line) - 1 AS INT) AS node
 FROM rs LEFT JOIN sec ON sec.doc_id = rs.doc_id AND sec.line_no = rs.first_line AND kind = 'Section' AND NOT def),
pa AS (SELECT a.doc_id, a.node, max(b.node) AS parent FROM nn a LEFT JOIN nn b ON a.doc_id = b.doc_id AND b.kind = 'Section' AND b.node < a.node AND (a.kind <> 'Section' OR b.level < a.level) GROUP BY ALL),
en AS (SELECT a.doc_id, a.node, CAST(coalesce(min(b.first_line) - 1, any_value(a.n_lines)) AS INT) AS last_line FROM nn a LEFT JOIN nn b ON a.doc_id = b.doc_id AND b.kind = 'Section' AND b.first_line > a.first_line AND b.level <= a.level WHERE a.kind = 'Section' GROUP BY ALL),
co AS (SELECT nn.doc_id, node, CASE WHEN any_value(def) THEN '' ELSE string_agg(line, chr(10) ORDER BY line_no) END AS content FROM nn JOIN stl ON stl.doc_id = nn.doc_id AND line_no BETWEEN first_line AND CASE WHEN nn.kind = 'Section' THEN first_line ELSE last_run END GROUP BY ALL),
ns AS (SELECT nn.doc_id, nn.node, nn.kind AS type, number, title, level, CAST(first_line AS INT) AS first_line, coalesce(en.last_line, CAST(last_run AS INT)) AS last_line, nn.start, parent, content FROM nn LEFT JOIN en USING (doc_id, node) JOIN pa USING (doc_id, node) JOIN co USING (doc_id, node)),
st AS (SELECT ns.*, CAST(stl.start + length(stl.line) AS INT) AS stop FROM ns JOIN stl ON stl.doc_id = ns.doc_id AND stl.line_no = ns.last_line),
{D_SCORES.replace("FROM documents", "FROM hd")}, dom AS (SELECT doc_id, domain FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1)"""
_ID = "concat(lower(type), '_d', doc_id, '_', node)"
add("k11_structures", lambda s, d: h.structures(structured(s, d)).drop("path").withColumnRenamed("start", "begin_at").withColumnRenamed("end", "end_at"), f"WITH {D_NODES} SELECT doc_id, node, type, number, title, level, first_line, last_line, start AS begin_at, stop AS end_at, parent, content FROM st")
add(
    "k11_structure_nodes", lambda s, d: h.structure_graph(structured(s, d))[0].withColumnRenamed("start", "begin_at").withColumnRenamed("end", "end_at"),
    f"WITH {D_NODES} SELECT {_ID} AS id, type, doc_id, domain, title, level, first_line, last_line, start AS begin_at, stop AS end_at, substr(content, 1, 100) AS preview, content <> '' AS has_content FROM st JOIN dom USING (doc_id)",
)
add(
    "k11_structure_edges", lambda s, d: h.structure_graph(structured(s, d))[1],
    f"WITH {D_NODES} SELECT CASE WHEN parent IS NULL THEN concat('d', doc_id) ELSE concat('section_d', doc_id, '_', parent) END AS source, {_ID} AS target, 'CONTAINS_STRUCTURE' AS type, concat('CONTAINS_', upper(type)) AS relationship_name, first_line, domain FROM st JOIN dom USING (doc_id)",
)

#: Keywords that the texts' first parts name, with their scores, by doc_id % 4.
_GIVEN = ((("FastAPI", 0.95), ("PostgreSQL", 0.92), ("SQLAlchemy", 0.88), ("Redis", 0.85), ("Docker", 0.82)), (("author", 0.9), ("theory", 0.8), ("research study analysis", 0.7)), (("company", 0.9), ("strategy", 0.8)), (("agreement", 0.9), ("contract", 0.8), ("nowhere", 0.6)))


def entity_keywords(s, d):
    """The most frequent words of each document and those given to it."""
    given = F.get(F.array(*[F.array(*[F.struct(F.lit(w).alias("keyword"), F.lit(x).alias("score")) for w, x in words]) for words in _GIVEN]), (F.col("doc_id") % 4).cast("int"))
    rows = docs(s, d).select("doc_id", F.explode(given).alias("g")).select("doc_id", "g.keyword", F.lit("given").alias("extractor"), "g.score", F.lit("name").alias("category"))
    return k.simple_keywords(docs(s, d)).select(*rows.columns).unionByName(rows)


def entities(s, d):
    return h.structure_entities(structured(s, d), entity_keywords(s, d))


_D_GIVEN = ", ".join(f"({i}, '{w}', {x})" for i, words in enumerate(_GIVEN) for w, x in words if " " not in w) + ", (1, 'research', 0.7), (1, 'study', 0.7), (1, 'analysis', 0.7)"
_D_TYPE = """CASE domain WHEN 'technical' THEN CASE WHEN regexp_matches(word, 'postgresql|postgres|mysql|mongodb|sqlite|oracle|redis|cassandra|elasticsearch|influxdb|mariadb') THEN 'Database'
 WHEN regexp_matches(word, 'fastapi|django|flask|react|vue|angular|spring|express|laravel|rails|nextjs|nuxt') THEN 'Framework' WHEN regexp_matches(word, 'docker|kubernetes|jenkins|git|maven|gradle|webpack|vite|npm|yarn') THEN 'Tool' ELSE 'Technology' END
 WHEN 'academic' THEN 'Author' WHEN 'business' THEN CASE WHEN regexp_matches(word, 'workflow|procedure|protocol|methodology') THEN 'Process' ELSE 'Company' END ELSE 'Law' END"""
_CUE = lambda words: "regexp_matches(lower(context), '" + "|".join(words.split()) + "')"
_D_RELATION = (
    f"CASE domain WHEN 'technical' THEN CASE WHEN {_CUE('depends require need rely')} THEN 'DEPENDS_ON' WHEN {_CUE('use utilize employ apply')} THEN 'USES' WHEN {_CUE('implement realize execute')} THEN 'IMPLEMENTS' WHEN {_CUE('call invoke execute trigger')} THEN 'CALLS' ELSE 'ASSOCIATED_WITH' END "
    f"WHEN 'academic' THEN CASE WHEN {_CUE('cite reference quote mention')} THEN 'CITES' WHEN {_CUE('contradict oppose conflict disagree')} THEN 'CONTRADICTS' WHEN {_CUE('prove demonstrate show evidence')} THEN 'PROVES' WHEN {_CUE('support back endorse confirm')} THEN 'SUPPORTS' ELSE 'ASSOCIATED_WITH' END "
    f"WHEN 'business' THEN CASE WHEN {_CUE('depends require need rely')} THEN 'DEPENDS_ON' WHEN {_CUE('support back endorse confirm')} THEN 'SUPPORTS' ELSE 'ASSOCIATED_WITH' END WHEN 'legal' THEN 'ASSOCIATED_WITH' ELSE CASE WHEN {_CUE('contain include comprise consist')} THEN 'CONTAINS' ELSE 'ASSOCIATED_WITH' END END"
)
D_ENTITIES = f"""{D_OCC}, {D_NODES},
gv AS (SELECT doc_id, 'given' AS extractor, lower(column1) AS word, CAST(column2 AS DOUBLE) AS score, 'name' AS category FROM documents JOIN (VALUES {_D_GIVEN}) g(column0, column1, column2) ON doc_id % 4 = column0),
wo AS (SELECT doc_id, extractor, word, max(score) AS score, min(category) AS category FROM (SELECT * FROM gv UNION ALL SELECT doc_id, extractor, lower(keyword), CAST(score AS DOUBLE), category FROM simple) GROUP BY ALL),
hi AS (SELECT doc_id, node, extractor, word, score, category FROM st JOIN wo USING (doc_id) WHERE contains(lower(content), word)),
ow AS (SELECT * FROM hi UNION ALL SELECT doc_id, 0, extractor, word, score, category FROM wo ANTI JOIN hi USING (doc_id, extractor, word)),
e1 AS (SELECT ow.*, type, title, substr(content, 1, 200) AS context, domain, {_ID} AS structure_id FROM ow JOIN st USING (doc_id, node) JOIN dom USING (doc_id)),
e2 AS (SELECT *, {_D_TYPE} AS entity_type FROM e1),
ent AS (SELECT *, concat_ws('_', lower(entity_type), substr(sha1(word), 1, 16), substr(sha1(structure_id), 1, 16), extractor) AS id FROM e2)"""
#: The sections around a node.
D_AROUND = "anc AS (SELECT doc_id, node, parent FROM pa WHERE parent IS NOT NULL UNION ALL SELECT a.doc_id, a.node, p.parent FROM anc a JOIN pa p ON p.doc_id = a.doc_id AND p.node = a.parent WHERE p.parent IS NOT NULL)"
add(
    "k12_structure_entities", lambda s, d: h.entity_nodes(entities(s, d)),
    f"WITH {D_ENTITIES} SELECT id, entity_type AS type, word AS text, domain, structure_id AS source_structure, type AS source_structure_type, extractor, score, category, CASE WHEN domain = 'technical' AND entity_type = 'Technology' THEN '{{\"category\":\"software\",\"maturity\":\"stable\"}}' WHEN domain = 'academic' THEN '{{\"field\":\"research\",\"h_index\":null}}' ELSE '{{}}' END AS props FROM ent",
)
add("k12_structure_entity_edges", lambda s, d: h.entity_edges(entities(s, d)), f"WITH {D_ENTITIES} SELECT structure_id AS source, id AS target, 'RELATED_TO' AS type, {_D_RELATION} AS relationship_name, extractor, score AS confidence, substr(context, 1, 100) AS context_snippet, domain FROM ent")
add("q10_entity_density_by_section", lambda s, d: h.entities_by_section(entities(s, d), structured(s, d)), f"WITH RECURSIVE {D_ENTITIES}, {D_AROUND}, inside AS (SELECT doc_id, parent AS node FROM ent JOIN anc USING (doc_id, node) UNION ALL SELECT doc_id, node FROM ent WHERE type = 'Section') SELECT doc_id, node, title, count(*) AS entities FROM inside JOIN (SELECT doc_id, node, title FROM st) USING (doc_id, node) GROUP BY ALL")
add("q11_same_container_pairs", lambda s, d: h.table_pairs(entities(s, d)), f"WITH {D_ENTITIES} SELECT DISTINCT a.doc_id, a.node, a.id AS source, b.id AS target FROM ent a JOIN ent b ON a.doc_id = b.doc_id AND a.node = b.node AND a.id <> b.id WHERE a.type = 'Table'")
add("q12_depth_distribution", lambda s, d: h.depth_distribution(entities(s, d)), f"WITH RECURSIVE {D_ENTITIES}, {D_AROUND}, dp AS (SELECT doc_id, node, count(*) AS n FROM anc GROUP BY ALL) SELECT type, CAST(coalesce(n, 0) + 1 AS INT) AS depth, count(*) AS entities FROM ent LEFT JOIN dp USING (doc_id, node) GROUP BY ALL")
add("q13_domain_type_patterns", lambda s, d: h.domain_patterns(entities(s, d)), f"WITH {D_ENTITIES} SELECT domain, type, entity_type, count(*) AS n FROM ent GROUP BY ALL")
#: Pairs of near words on whole texts; no word holds a mark at which texts are cut.
D_NEAR = f"""{D_ENTITIES},
rk AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY max(score) DESC, word) - 1 AS rank FROM ent GROUP BY doc_id, word),
hl AS (SELECT doc_id, text, lower(text) AS low FROM hd),
pos AS (SELECT doc_id, word, rank, strpos(low, word) - 1 AS p FROM rk JOIN hl USING (doc_id) WHERE contains(low, word) UNION ALL SELECT doc_id, word, rank, p + strpos(substr(low, CAST(p + 2 AS BIGINT)), word) FROM pos JOIN hl USING (doc_id) WHERE strpos(substr(low, CAST(p + 2 AS BIGINT)), word) > 0),
pr AS (SELECT a.doc_id, a.word AS source, b.word AS target, a.p AS a, b.p AS b FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.rank < b.rank),
nr AS (SELECT DISTINCT pr.doc_id, source, target FROM pr JOIN hl USING (doc_id) WHERE abs(a - b) <= 100 AND NOT regexp_matches(substr(low, CAST(least(a, b) + 1 AS BIGINT), CAST(abs(a - b) AS BIGINT)), '\\n\\n|\\. |\\.\\n|\\||- \\*\\*|## ')),
cl AS (SELECT doc_id, source, target, min((abs(a - b), a, b)) AS c FROM pr SEMI JOIN nr USING (doc_id, source, target) GROUP BY ALL),
cx AS (SELECT doc_id, source, target, c[1] AS gap, regexp_replace(substr(text, CAST(greatest(least(c[2], c[3]) - 100, 0) + 1 AS BIGINT), CAST(least(greatest(c[2] + length(source), c[3] + length(target)) + 100, length(text)) - greatest(least(c[2], c[3]) - 100, 0) AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS whole FROM cl JOIN hl USING (doc_id)),
ctx AS (SELECT doc_id, source, target, CAST(gap AS INT) AS gap, CASE WHEN length(whole) > 200 THEN substr(whole, 1, 200) || '...' ELSE whole END AS context FROM cx)"""


add("k16_closest_context", lambda s, d: rel.near_contexts(h.entity_words(entity_keywords(s, d)), structured(s, d)), f"WITH RECURSIVE {D_NEAR} SELECT * FROM ctx")
D_RULES = f"""{D_NEAR},
ep AS (SELECT x.doc_id, a.id AS source, b.id AS target, a.word AS word1, b.word AS word2, a.entity_type AS type1, b.entity_type AS type2, a.score AS score1, b.score AS score2, a.domain, x.context, a.extractor
 FROM ctx x JOIN ent a ON a.doc_id = x.doc_id AND a.word = x.source JOIN ent b ON b.doc_id = x.doc_id AND b.word = x.target AND b.node = a.node),
rl AS (SELECT *, CASE domain WHEN 'technical' THEN CASE (type1, type2) WHEN ('Technology', 'Database') THEN 'USES' WHEN ('Framework', 'Database') THEN 'CONNECTS_TO' WHEN ('Technology', 'Framework') THEN 'INTEGRATES_WITH' WHEN ('Tool', 'Framework') THEN 'SUPPORTS'
 WHEN ('Database', 'Technology') THEN 'USED_BY' WHEN ('Database', 'Framework') THEN 'CONNECTED_BY' WHEN ('Framework', 'Technology') THEN 'INTEGRATED_BY' WHEN ('Framework', 'Tool') THEN 'SUPPORTED_BY' END
 WHEN 'academic' THEN NULL WHEN 'business' THEN NULL ELSE CASE WHEN regexp_matches(lower(context), '사용|활용|이용') THEN 'USES' WHEN regexp_matches(lower(context), '연결|연동|통합') THEN 'INTEGRATES_WITH' WHEN regexp_matches(lower(context), '구현|개발') THEN 'IMPLEMENTS'
 WHEN regexp_matches(lower(context), '지원|도구') THEN 'SUPPORTS' ELSE 'ASSOCIATED_WITH' END END AS relationship_name FROM ep),
cf AS (SELECT *, round(least(least(score1, score2) * CASE relationship_name WHEN 'USES' THEN 0.9 WHEN 'INTEGRATES_WITH' THEN 0.85 WHEN 'IMPLEMENTS' THEN 0.8 WHEN 'CONNECTS_TO' THEN 0.8 WHEN 'SUPPORTS' THEN 0.7 ELSE 0.6 END + CASE WHEN context <> '' THEN 0.1 ELSE 0 END, 1.0), 6) AS confidence FROM rl WHERE relationship_name IS NOT NULL AND relationship_name <> 'ASSOCIATED_WITH')"""
add("k_entity_relations", lambda s, d: rel.entity_relations(entities(s, d), structured(s, d)), f"WITH RECURSIVE {D_RULES} SELECT doc_id, source, target, relationship_name, CAST(confidence AS DOUBLE) AS confidence, substr(context, 1, 100) AS context_snippet, extractor FROM cf WHERE confidence >= 0.5")
add(
    "k19_known_stack_pairs", lambda s, d: rel.known_stacks(entities(s, d)),
    f"WITH {D_ENTITIES}, sk AS (SELECT * FROM ent JOIN (VALUES ('fastapi|sqlalchemy', 'INTEGRATES_WITH'), ('react|node[.]js', 'WORKS_WITH'), ('postgresql|redis', 'COMPLEMENTS'), ('docker|kubernetes', 'ORCHESTRATED_BY')) v(names, relationship_name) ON regexp_matches(word, names) WHERE domain = 'technical') "
    "SELECT a.doc_id, a.id AS source, b.id AS target, a.relationship_name, 0.8::DOUBLE AS confidence FROM sk a JOIN sk b ON a.doc_id = b.doc_id AND a.names = b.names AND (-a.score, a.word, a.id) < (-b.score, b.word, b.id)",
)
_scored_pairs = lambda s, d: _typed_pairs(s, d).select("doc_id", _pick((*rel.WEIGHTS, "USED_BY"), F.col("doc_id") % 8).alias("relationship_name"), ((F.col("doc_id") % 7 + 4) / 10).alias("score1"), ((F.col("doc_id") % 11 + 1) / 12).alias("score2"), F.when(F.col("doc_id") % 3 > 0, F.col("context")).alias("context"))
add(
    "k18_relation_confidence", lambda s, d: _scored_pairs(s, d).withColumn("confidence", rel.relation_confidence(*map(F.col, ("relationship_name", "score1", "score2", "context")))),
    "WITH p AS (SELECT doc_id, ['USES', 'INTEGRATES_WITH', 'IMPLEMENTS', 'CONNECTS_TO', 'COMPLEMENTS', 'SUPPORTS', 'RELATED_TO', 'USED_BY'][doc_id % 8 + 1] AS relationship_name, [0.9, 0.85, 0.8, 0.8, 0.75, 0.7, 0.5, 0.6][doc_id % 8 + 1]::DOUBLE AS weight, (doc_id % 7 + 4) / 10 AS score1, (doc_id % 11 + 1) / 12 AS score2, "
    "CASE WHEN doc_id % 3 > 0 THEN ['사용', '연동', '개발', '도구', 'none'][doc_id % 5 + 1] END AS context FROM documents) SELECT doc_id, relationship_name, score1, score2, context, round(least(least(score1, score2) * weight + CASE WHEN context <> '' THEN 0.1::DOUBLE ELSE 0 END, 1), 6) AS confidence FROM p",
)
#: Contexts and types of every domain, by doc_id.
_CONTEXTS = ("it needs more", "we apply this", "to execute", "a trigger of", "as they quote", "in conflict", "evidence of", "we confirm", "which comprise", "none")
_DOMAINS = ("technical", "academic", "business", "legal", "general", "medical")
_pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
_contexts = lambda s, d: docs(s, d).select("doc_id", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 20), F.lit(" "), _pick(_CONTEXTS, F.col("doc_id") % 10)).alias("context"), _pick(_DOMAINS, F.floor(F.col("doc_id") / 10) % 6).alias("domain"))
_D_CONTEXTS = f"cx AS (SELECT doc_id, substr(coalesce(text, ''), 1, 20) || ' ' || {list(_CONTEXTS)!r}[doc_id % 10 + 1] AS context, {list(_DOMAINS)!r}[doc_id // 10 % 6 + 1] AS domain FROM documents)"
add("k07_relation_by_context", lambda s, d: _contexts(s, d).withColumn("relationship_name", h.relation_by_context(F.col("context"), F.col("domain"))), f"WITH {_D_CONTEXTS} SELECT *, {_D_RELATION} AS relationship_name FROM cx")
_KINDS = ("Technology", "Database", "Framework", "API", "Service", "Tool", "Author", "Research_Method", "Theory", "Concept", "Dataset", "Company", "Product", "Strategy", "Goal", "Process")
_HINTS = ("사용", "연동", "개발", "도구", "none")


def _typed_pairs(s, d):
    i = F.col("doc_id")
    return docs(s, d).select("doc_id", _pick(_DOMAINS, i % 6).alias("domain"), _pick(_KINDS, F.floor(i / 6) % 16).alias("type1"), _pick(_KINDS, F.floor(i / 96) % 16).alias("type2"), _pick(_HINTS, i % 5).alias("context"))


_D_TYPED = f"tp AS (SELECT doc_id, {list(_DOMAINS)!r}[doc_id % 6 + 1] AS domain, {list(_KINDS)!r}[doc_id // 6 % 16 + 1] AS type1, {list(_KINDS)!r}[doc_id // 96 % 16 + 1] AS type2, {list(_HINTS)!r}[doc_id % 5 + 1] AS context FROM documents)"
add(
    "k17_relation_rule", lambda s, d: _typed_pairs(s, d).withColumn("relationship_name", rel.relation_rule(*map(F.col, ("domain", "type1", "type2", "context")))),
    f"WITH {_D_TYPED}, ru(domain, type1, type2, there, back) AS (VALUES ('technical', 'Technology', 'Database', 'USES', 'USED_BY'), ('technical', 'Framework', 'Database', 'CONNECTS_TO', 'CONNECTED_BY'), ('technical', 'Technology', 'Framework', 'INTEGRATES_WITH', 'INTEGRATED_BY'), ('technical', 'API', 'Database', 'ACCESSES', 'ACCESSED_BY'), "
    "('technical', 'Service', 'Technology', 'IMPLEMENTS', 'IMPLEMENTED_BY'), ('technical', 'Tool', 'Framework', 'SUPPORTS', 'SUPPORTED_BY'), ('academic', 'Author', 'Research_Method', 'USES', 'USES'), ('academic', 'Theory', 'Research_Method', 'APPLIED_BY', 'APPLIED_BY'), ('academic', 'Concept', 'Theory', 'RELATED_TO', 'RELATED_TO'), "
    "('academic', 'Dataset', 'Research_Method', 'ANALYZED_BY', 'ANALYZED_BY'), ('business', 'Company', 'Product', 'PRODUCES', 'PRODUCES'), ('business', 'Strategy', 'Goal', 'ACHIEVES', 'ACHIEVES'), ('business', 'Process', 'Tool', 'UTILIZES', 'UTILIZES')) "
    "SELECT tp.*, CASE WHEN tp.domain IN ('technical', 'academic', 'business') THEN coalesce(a.there, b.back) WHEN context = '사용' THEN 'USES' WHEN context = '연동' THEN 'INTEGRATES_WITH' WHEN context = '개발' THEN 'IMPLEMENTS' WHEN context = '도구' THEN 'SUPPORTS' ELSE 'ASSOCIATED_WITH' END AS relationship_name "
    "FROM tp LEFT JOIN ru a ON a.domain = tp.domain AND a.type1 = tp.type1 AND a.type2 = tp.type2 LEFT JOIN ru b ON b.domain = tp.domain AND b.type1 = tp.type2 AND b.type2 = tp.type1",
)
add(
    "k06_entity_props", lambda s, d: _typed_pairs(s, d).select("doc_id", "domain", F.col("type1").alias("type"), F.to_json(h.entity_properties(F.col("type1"), F.col("domain"))).alias("props")),
    f"WITH {_D_TYPED} SELECT doc_id, domain, type1 AS type, CASE (domain, type1) WHEN ('technical', 'Technology') THEN '{{\"category\":\"software\",\"maturity\":\"stable\"}}' WHEN ('academic', 'Author') THEN '{{\"field\":\"research\",\"h_index\":null}}' ELSE '{{}}' END AS props FROM tp",
)
