"""Queries of chapters and chunks, over whole texts with headings of every kind, which the tables lack, put between their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import chunks as c

from .texts import docs

ALL: dict = {}


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


def outlined(s, d):
    """Documents whose lines, which stay whole, have headings of all levels before them; the first section comes before any chapter."""
    line = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def put(x, i):
        short = F.substring(x, 1, 30)
        mark = (
            F.when(i % 9 == 0, "## ").when(i % 9 == 2, "### ").when(i % 9 == 3, "(2) ").when((i % 9 == 4) & (F.floor(i / 9) % 2 == 0), F.concat(i.cast("string"), F.lit(". "))).when(i % 9 == 4, "제 1 절 ")
            .when(i % 9 == 5, F.concat(i.cast("string"), F.lit(".2 "))).when(i % 9 == 6, "  1.2.3 ").when(i % 9 == 7, "## 07 ")
        )
        return F.when(mark.isNull(), F.array(x)).otherwise(F.array(F.concat(mark, short), x))

    return docs(s, d).select("doc_id", F.array_join(F.flatten(F.transform(line, put)), "\n").alias("text"))


D_OUTLINED = (
    "ol AS (SELECT doc_id, array_to_string(flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, k: CASE (k - 1) % 9 WHEN 0 THEN ['## ' || substr(x, 1, 30), x] WHEN 2 THEN ['### ' || substr(x, 1, 30), x] WHEN 3 THEN ['(2) ' || substr(x, 1, 30), x] "
    "WHEN 4 THEN [CASE WHEN ((k - 1) // 9) % 2 = 0 THEN concat(k - 1, '. ') ELSE '제 1 절 ' END || substr(x, 1, 30), x] WHEN 5 THEN [concat(k - 1, '.2 ', substr(x, 1, 30)), x] WHEN 6 THEN ['  1.2.3 ' || substr(x, 1, 30), x] WHEN 7 THEN ['## 07 ' || substr(x, 1, 30), x] ELSE [x] END)), chr(10)) AS text FROM documents)"
)
#: The headings once more, for the SQL.
_PATTERNS = [
    ("chapter", r"^(\d+)\.\s+(.+)$", 1), ("chapter", r"^제\s*(\d+)\s*장\s*[:.\s]*(.+)$", 1), ("chapter", r"^Chapter\s+(\d+)[.:\s]*(.+)$", 1), ("chapter", r"^CHAPTER\s+([IVX]+)[.:\s]*(.+)$", 1), ("chapter", r"^#\s+(\d+)\s+(.+)$", 1), ("chapter", r"^(\d\d)()$", 1),
    ("section", r"^(\d+)\.(\d+)\s+(.+)$", 2), ("section", r"^(\d+)-(\d+)[.\s]+(.+)$", 2), ("section", r"^제\s*(\d+)\s*절\s*[:.\s]*(.+)$", 1), ("section", r"^##\s+(\d+)\.(\d+)\s+(.+)$", 2), ("section", r"^##\s+(\d\d)\s+(.+)$", 1), ("section", r"^##\s+(.+)$", 0),
    ("subsection", r"^(\d+)\.(\d+)\.(\d+)\s+(.+)$", 3), ("subsection", r"^(\d+)-(\d+)-(\d+)[.\s]+(.+)$", 3), ("subsection", r"^\((\d+)\)\s+(.+)$", 1), ("subsection", r"^([가-힣])\.\s+(.+)$", 1), ("subsection", r"^###\s+(.+)$", 0),
]
_case = lambda value: "CASE " + " ".join(f"WHEN regexp_matches(b, '{p}') THEN {value(k, p, n)}" for k, p, n in _PATTERNS) + " END"
D_CLASSES = f"""{D_OUTLINED},
ll AS (SELECT doc_id, length(text) AS size, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INT) AS line_no, len(ls) AS n_lines FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM ol)),
lb AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS b, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM ll),
cl AS (SELECT *, {_case(lambda k, p, n: f"'{k}'")} AS kind, {_case(lambda k, p, n: "concat_ws('.', " + ", ".join(f"regexp_extract(b, '{p}', {g})" for g in range(1, n + 1)) + ")" if n else "'auto'")} AS number,
 {_case(lambda k, p, n: "'Chapter ' || b" if p.endswith("()$") else f"regexp_replace(regexp_extract(b, '{p}', {n + 1}), '^\\s+|\\s+$', '', 'g')")} AS title FROM lb)"""
D_TREE = f"""{D_CLASSES},
h1 AS (SELECT *, sum(CASE WHEN kind = 'section' AND number = 'auto' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec_no, lag(CASE WHEN kind <> 'subsection' THEN kind END) OVER (PARTITION BY doc_id ORDER BY line_no) AS up FROM cl WHERE kind IS NOT NULL),
h2 AS (SELECT *, sum(CASE WHEN kind = 'subsection' AND number = 'auto' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec_no ORDER BY line_no) AS sub_no, last_value(up IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS main FROM h1),
h3 AS (SELECT *, CASE WHEN number <> 'auto' THEN number WHEN kind = 'section' THEN CAST(sec_no AS VARCHAR) ELSE CAST(sub_no AS VARCHAR) END AS num FROM h2),
m AS (SELECT DISTINCT doc_id, 'document' AS type, '0' AS number, 'Document Root' AS title, 'document_root' AS node_id, 0 AS line_no, 0 AS start_pos, CAST(size AS INT) AS end_pos, 0 AS o FROM ll
 UNION ALL SELECT doc_id, 'chapter', '1', 'Document Sections', 'chapter_auto', line_no, start, start, 0 FROM h3 WHERE kind = 'section' AND main IS NULL
 UNION ALL SELECT doc_id, kind, num, title, concat(kind, '_', num), line_no, start, CAST(start + length(line) + 1 AS INT), 1 FROM h3 WHERE kind <> 'subsection' OR main = 'section'),
n0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, o) - 1 AS INT) AS node FROM m),
n1 AS (SELECT *, lag(CASE WHEN type = 'chapter' THEN node END) OVER w AS c1, lag(CASE WHEN type = 'section' THEN node END) OVER w AS s1 FROM n0 WINDOW w AS (PARTITION BY doc_id ORDER BY node)),
n2 AS (SELECT *, last_value(c1 IGNORE NULLS) OVER w AS up_chapter, last_value(s1 IGNORE NULLS) OVER w AS up_section FROM n1 WINDOW w AS (PARTITION BY doc_id ORDER BY node ROWS UNBOUNDED PRECEDING)),
nx AS (SELECT a.doc_id, a.node, min(b.line_no) AS later FROM n0 a JOIN n0 b ON a.doc_id = b.doc_id AND b.node > a.node AND b.type IN ('chapter', 'section') GROUP BY ALL),
ct AS (SELECT n0.doc_id, n0.node, string_agg(cl.line, chr(10) ORDER BY cl.line_no) || CASE WHEN max(cl.line_no) < max(n_lines) THEN chr(10) ELSE '' END AS content FROM n0 LEFT JOIN nx USING (doc_id, node) JOIN cl ON cl.doc_id = n0.doc_id AND cl.line_no > n0.line_no AND cl.line_no < coalesce(later, n_lines + 1) AND cl.kind IS NULL WHERE type <> 'subsection' AND node_id <> 'chapter_auto' GROUP BY ALL),
tn AS (SELECT doc_id, node, node_id, type, CAST(CASE type WHEN 'document' THEN 0 WHEN 'chapter' THEN 1 WHEN 'section' THEN 2 ELSE 3 END AS INT) AS level, number, title, CASE type WHEN 'chapter' THEN 0 WHEN 'section' THEN up_chapter WHEN 'subsection' THEN up_section END AS parent, start_pos, end_pos, coalesce(content, '') AS content FROM n2 LEFT JOIN ct USING (doc_id, node)),
dc AS (SELECT doc_id, max(end_pos) FILTER (type = 'document') AS size, count(*) FILTER (type = 'chapter') AS ch, count(*) FILTER (type = 'section') AS se FROM tn GROUP BY doc_id),
lv AS (SELECT doc_id, CASE WHEN size < 8000 THEN 'document' WHEN size < 50000 THEN CASE WHEN ch >= 3 THEN 'chapter' WHEN se >= 3 THEN 'section' WHEN ch >= 2 THEN 'chapter' ELSE 'document' END WHEN size / greatest(ch, 1) > 15000 AND se >= ch * 2 THEN 'section' ELSE 'chapter' END AS level, ch FROM dc)"""
add("f01_heading_class", lambda s, d: outlined(s, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), c.heading_class(F.col("line")).alias("c")).select("doc_id", "line_no", "c.*"), f"WITH {D_CLASSES} SELECT doc_id, line_no, kind, number, title FROM cl")
add("f02_tree_nodes", lambda s, d: c.tree_nodes(outlined(s, d)), f"WITH {D_TREE} SELECT * FROM tn")


def _levels(s, d):
    count = lambda kind: F.size(F.filter("nodes", lambda n: n["type"] == kind))
    return c.document_tree(outlined(s, d)).select("doc_id", c.chunk_level(F.col("size"), count("chapter"), count("section")).alias("level"))


add("f03_chunk_level", _levels, f"WITH {D_TREE} SELECT doc_id, level FROM lv")
#: A budget that the sections of one chapter often exceed.
_BUDGET = 600
D_CHUNKS = f"""{D_TREE},
tx AS (SELECT tn.*, CASE WHEN type = 'document' THEN CASE WHEN regexp_matches(content, '\\S') THEN content ELSE '' END ELSE CASE type WHEN 'chapter' THEN '# ' WHEN 'section' THEN '## ' ELSE '### ' END || title || CASE WHEN regexp_matches(content, '\\S') THEN chr(10) || chr(10) || content ELSE '' END END AS text,
 CASE WHEN ch = 0 THEN 'document' ELSE lv.level END AS cut FROM tn JOIN lv USING (doc_id)),
hd AS (SELECT *, lead(node) OVER w AS until, lead(type) OVER w AS following FROM tx WHERE type = cut OR (cut = 'section' AND type = 'chapter') WINDOW w AS (PARTITION BY doc_id ORDER BY node)),
un AS (SELECT hd.doc_id, hd.node, hd.type, hd.number, hd.parent, string_agg(tx.text, chr(10) || chr(10) ORDER BY tx.node) FILTER (tx.text <> '') AS text FROM hd JOIN tx ON tx.doc_id = hd.doc_id AND tx.node >= hd.node AND tx.node < coalesce(until, 1000000000) WHERE NOT (hd.cut = 'section' AND hd.type = 'chapter' AND coalesce(following = 'section', false)) GROUP BY ALL),
uo AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY node) AS k, length(coalesce(text, '')) // 4 AS cost FROM un),
wk AS (SELECT doc_id, node, k, 0 AS chunk, CASE WHEN type = 'section' THEN parent ELSE -1 END AS chapter, cost AS used FROM uo WHERE k = 1
 UNION ALL SELECT u.doc_id, u.node, u.k, w.chunk + CASE WHEN u.type = 'section' AND u.parent = w.chapter AND w.used + u.cost <= {_BUDGET} THEN 0 ELSE 1 END, CASE WHEN u.type = 'section' THEN u.parent ELSE -1 END, CASE WHEN u.type = 'section' AND u.parent = w.chapter AND w.used + u.cost <= {_BUDGET} THEN w.used + u.cost ELSE u.cost END
 FROM wk w JOIN uo u ON u.doc_id = w.doc_id AND u.k = w.k + 1),
ck AS (SELECT uo.doc_id, CAST(chunk AS INT) AS chunk, first(type ORDER BY uo.k) AS level, first(number ORDER BY uo.k) AS a, last(number ORDER BY uo.k) AS z, first(parent ORDER BY uo.k) AS parent, list(uo.node ORDER BY uo.k) AS nodes, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY uo.k), '') AS text FROM uo JOIN wk USING (doc_id, node) GROUP BY ALL),
chk AS (SELECT ck.doc_id, chunk, CASE ck.level WHEN 'document' THEN 'document_full' WHEN 'chapter' THEN 'chapter_' || a ELSE concat('merged_', a, '_to_', z) END AS chunk_id, ck.level, CASE ck.level WHEN 'document' THEN '' WHEN 'chapter' THEN 'Document: ' || up.title ELSE concat('Chapter ', up.number, ': ', up.title) END AS parent_context,
 CASE ck.level WHEN 'section' THEN 'token_based_merge' ELSE ck.level || '_boundary' END AS boundary_rule, nodes, text FROM ck LEFT JOIN tn up ON up.doc_id = ck.doc_id AND up.node = ck.parent)"""
_chunks = lambda s, d: c.build_chunks(outlined(s, d), _BUDGET)
add("f04_chunk_build", lambda s, d: _chunks(s, d).withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ",")).drop("text"), f"WITH RECURSIVE {D_CHUNKS} SELECT doc_id, chunk, chunk_id, level, parent_context, boundary_rule, array_to_string(nodes, ',') AS nodes FROM chk")
add("f07_chunk_text", lambda s, d: _chunks(s, d).select("doc_id", "chunk", F.length("text").alias("length"), "text", F.substring("text", 1, 300).alias("preview")), f"WITH RECURSIVE {D_CHUNKS} SELECT doc_id, chunk, CAST(length(text) AS INT) AS length, text, substr(text, 1, 300) AS preview FROM chk")


def _spanning(s, d):
    """Chunks of four neighbouring chapters and sections, whatever chapter they are of; each fifth is said to be merged by tokens."""
    nodes = c.tree_nodes(outlined(s, d))
    places = c.document_tree(outlined(s, d)).select("doc_id", F.posexplode_outer(F.filter("nodes", lambda n: n["type"].isin("chapter", "section"))).alias("k", "n")).select("doc_id", F.floor(F.col("k") / 4).alias("g"), "n.node").filter("node IS NOT NULL")
    rule = F.when(F.col("g") % 5 == 4, "token_based_merge").otherwise("manual")
    chunks = places.groupBy("doc_id", "g").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("doc_id", F.concat(F.lit("chunk_"), "g").alias("chunk_id"), rule.alias("boundary_rule"), "nodes")
    return c.boundary_check(chunks, nodes).withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


add(
    "f06_boundary_check", _spanning,
    f"WITH {D_TREE}, pl AS (SELECT doc_id, node, split_part(number, '.', 1) AS chapter, (row_number() OVER (PARTITION BY doc_id ORDER BY node) - 1) // 4 AS g FROM tn WHERE type IN ('chapter', 'section')), w AS (SELECT doc_id, g, count(DISTINCT chapter) AS n, list(node ORDER BY node) AS nodes FROM pl GROUP BY ALL), "
    "p AS (SELECT doc_id, g, chapter, list(node ORDER BY node) AS nodes FROM pl GROUP BY ALL) SELECT doc_id, concat('chunk_', g) AS chunk_id, CASE WHEN g % 5 = 4 THEN 'token_based_merge' ELSE 'manual' END AS boundary_rule, array_to_string(nodes, ',') AS nodes FROM w WHERE n = 1 OR g % 5 = 4 "
    "UNION ALL SELECT p.doc_id, concat('chapter_', chapter, '_split'), 'chapter_boundary_corrected', array_to_string(p.nodes, ',') FROM p JOIN w USING (doc_id, g) WHERE n > 1 AND g % 5 <> 4",
)


def _part_graphs(s, d):
    """Of every document a graph for each of its paragraphs: the words of five letters or more that begin with a capital, and links between neighbours; a word occurs in many."""
    words = docs(s, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line")).select("doc_id", "i", F.regexp_extract_all("line", F.lit("[A-Z][a-z]{4,}"), 0).alias("w")).withColumn("graph", F.col("doc_id") * 100_000 + F.col("i"))
    lower = F.lower("word")
    node = words.select("doc_id", "graph", F.posexplode("w").alias("k", "word")).groupBy("doc_id", "graph", F.concat_ws("_", F.lit("concept"), F.col("doc_id") % 10, lower).alias("id")).agg(F.min("k").alias("k"))
    kinds = F.when(F.col("graph") % 3 == 0, "Name").otherwise("Concept")
    props = F.map_filter(F.create_map(F.lit("first"), F.col("k").cast("string"), F.lit("part"), F.col("graph").cast("string"), F.lit("even"), F.when(F.col("k") % 2 == 0, F.col("k").cast("string"))), lambda k, v: v.isNotNull())
    nodes = node.select("graph", "id", kinds.alias("type"), props.alias("props"))
    near = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.expr("slice(w, 2, size(w))"), lambda a, b: F.struct(F.lower(a).alias("a"), F.lower(b).alias("b")))
    ends = words.select("doc_id", "graph", F.explode(near).alias("e"))
    name = lambda x: F.concat_ws("_", F.lit("concept"), F.col("doc_id") % 10, x)
    return nodes, ends.select("graph", name("e.a").alias("source"), name("e.b").alias("target"), F.lit("FOLLOWED_BY").alias("type")).distinct()


_D_PARTS = """l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, doc_id * 100000 + i AS graph, regexp_extract_all(line, '[A-Z][a-z]{4,}') AS w FROM l), x AS (SELECT doc_id, graph, lower(unnest(w)) AS word, generate_subscripts(w, 1) - 1 AS k FROM w),
nd AS (SELECT graph, concat_ws('_', 'concept', doc_id % 10, word) AS id, min(k) AS k FROM x GROUP BY ALL),
ed AS (SELECT DISTINCT a.graph, concat_ws('_', 'concept', a.doc_id % 10, a.word) AS source, concat_ws('_', 'concept', b.doc_id % 10, b.word) AS target FROM x a JOIN x b ON a.graph = b.graph AND b.k = a.k + 1)"""
add(
    "f13_merged_nodes", lambda s, d: c.merge_graphs(*_part_graphs(s, d))[0].select("id", "type", F.to_json("props").alias("props"), "graphs"),
    f"""WITH {_D_PARTS}, f AS (SELECT id, arg_min(CASE WHEN graph % 3 = 0 THEN 'Name' ELSE 'Concept' END, graph) AS type, count(DISTINCT graph) AS graphs, arg_max(k, graph) AS first, max(graph) AS part, arg_max(k, graph) FILTER (k % 2 = 0) AS even FROM nd GROUP BY id)
SELECT id, type, concat('{{', CASE WHEN even IS NOT NULL THEN concat('"even":"', even, '",') ELSE '' END, '"first":"', first, '","part":"', part, '"}}') AS props, graphs FROM f""",
)
add("f13_merged_edges", lambda s, d: c.merge_graphs(*_part_graphs(s, d))[1], f"WITH {_D_PARTS} SELECT source, target, 'FOLLOWED_BY' AS type, min(graph) AS graph FROM ed GROUP BY source, target")
