"""Queries of recognised pages, images and outlines, which are made from each document's own words and lines, as the tables lack them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import layout as la
from corpusmill.operators import outlines as ol

from .texts import docs

ALL: dict = {}


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


def boxes(s, d):
    """Three of four lines as three words in columns that are a little out of line, the fourth as one box; thirty lines a page."""
    lines = docs(s, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("l", "line"))
    words = F.slice(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), 0), 1, 3)
    each = lines.select("doc_id", "l", F.posexplode(F.when(F.col("l") % 4 == 3, F.array(F.substring("line", 1, 60))).otherwise(words)).alias("k", "text"))
    shift = (F.col("k") * 7 + F.col("doc_id") + F.col("l")) % 27 - 13
    return each.select(
        "doc_id", F.floor(F.col("l") / 30).cast("int").alias("page"), (F.col("l") * 3 + F.col("k")).cast("int").alias("i"), "text", ((F.col("doc_id") + F.col("l") * 3 + F.col("k")) % 10 / 10).alias("confidence"), (F.col("k") * 200 + F.col("doc_id") % 7).alias("x_min"),
        (F.col("k") * 200 + F.col("doc_id") % 7 + 80).alias("x_max"), (F.col("l") % 30 * 40 + shift).alias("y_min"), (F.col("l") % 30 * 40 + shift + 12).alias("y_max"),
    )


D_BOXES = """ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
wd AS (SELECT doc_id, l, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS k FROM (SELECT doc_id, l, CASE WHEN l % 4 = 3 THEN [substr(line, 1, 60)] ELSE regexp_extract_all(line, '[A-Za-z]+')[1:3] END AS w FROM ln)),
tk AS (SELECT doc_id, CAST(l // 30 AS INT) AS page, l * 3 + k AS i, text, k * 200 + doc_id % 7 + 40 AS x, l % 30 * 40 + (k * 7 + doc_id + l) % 27 - 13 + 6 AS y FROM wd WHERE (doc_id + l * 3 + k) % 10 / 10 > 0.3),
t1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, i) AS n FROM tk),
t2 AS (SELECT doc_id, page, n, 1 AS row, CAST(y AS DOUBLE) AS total, 1 AS size FROM t1 WHERE n = 1 UNION ALL SELECT t.doc_id, t.page, t.n, CASE WHEN abs(t.y - total / size) < 15 THEN row ELSE row + 1 END, CASE WHEN abs(t.y - total / size) < 15 THEN total + t.y ELSE t.y END, CASE WHEN abs(t.y - total / size) < 15 THEN size + 1 ELSE 1 END
 FROM t2 JOIN t1 t ON t.doc_id = t2.doc_id AND t.page = t2.page AND t.n = t2.n + 1),
rw AS (SELECT doc_id, page, row, list(text ORDER BY x, n) AS cells, count(*) AS c FROM t1 JOIN t2 USING (doc_id, page, n) GROUP BY ALL),
t3 AS (SELECT doc_id, page, row, 1 AS run, CASE WHEN c > 1 THEN 1 ELSE 0 END AS held, CASE WHEN c > 1 THEN c ELSE 0 END AS wide FROM rw WHERE row = 1 UNION ALL
 SELECT r.doc_id, r.page, r.row, CASE WHEN c > 1 AND held > 0 AND abs(c - wide / held) <= 2 THEN run ELSE run + 1 END, CASE WHEN c > 1 AND (held = 0 OR abs(c - wide / held) <= 2) THEN held + 1 ELSE 0 END, CASE WHEN c > 1 AND (held = 0 OR abs(c - wide / held) <= 2) THEN wide + c ELSE 0 END FROM t3 JOIN rw r ON r.doc_id = t3.doc_id AND r.page = t3.page AND r.row = t3.row + 1),
rn AS (SELECT doc_id, page, run, min(row) AS first, count(*) AS n, max(c) AS width FROM t3 JOIN rw USING (doc_id, page, row) GROUP BY ALL),
li AS (SELECT doc_id, page, row, run, n, width, cells, row = first AS head, row = first + n - 1 AS tail, max(row) OVER (PARTITION BY doc_id, page) = row AS final FROM t3 JOIN rw USING (doc_id, page, row) JOIN rn USING (doc_id, page, run)),
tl AS (SELECT doc_id, page, row, n > 1 AND head AS starts, CASE WHEN n = 1 THEN array_to_string(cells, ' ') ELSE '| ' || array_to_string(list_concat(cells, list_transform(range(width - len(cells)), lambda z: '')), ' | ') || ' |' || CASE WHEN head THEN chr(10) || '|' || repeat('---|', CAST(width AS INT)) ELSE '' END || CASE WHEN tail AND NOT final THEN chr(10) ELSE '' END END AS line FROM li)"""
add("e24_ocr_rows_to_table", lambda s, d: la.ocr_text(boxes(s, d)), f"WITH RECURSIVE {D_BOXES} SELECT doc_id, page, string_agg(line, chr(10) ORDER BY row) AS text, CAST(count_if(starts) AS INT) AS tables FROM tl GROUP BY doc_id, page")


def _pages(s, d):
    """Pages of up to 500 characters; how many of them, and which have images, goes by the document's number."""
    n, i = F.col("doc_id"), F.col("page")
    rows = docs(s, d).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.explode(F.sequence(F.lit(0), (F.length(F.coalesce("text", F.lit(""))) / 500).cast("int"))).alias("page"))
    share = F.when(n % 4 == 0, 0).when(n % 4 == 1, F.least(F.col("n") - i * 500, F.lit(60))).when(n % 4 == 2, F.least(F.col("n") - i * 500, F.lit(280))).otherwise(F.least(F.col("n") - i * 500, F.lit(500)))
    return rows.select("doc_id", "page", share.cast("bigint").alias("chars"), F.when((n + i) % (n % 5 + 1) == 0, n % 3 + 1).otherwise(0).alias("images"))


D_PAGES = """pp AS (SELECT doc_id, length(coalesce(text, '')) AS n, unnest(range(CAST(floor(length(coalesce(text, '')) / 500) AS BIGINT) + 1)) AS page FROM documents),
pg AS (SELECT doc_id, page, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN least(n - page * 500, 60) WHEN 2 THEN least(n - page * 500, 280) ELSE least(n - page * 500, 500) END AS chars, CASE WHEN (doc_id + page) % (doc_id % 5 + 1) = 0 THEN doc_id % 3 + 1 ELSE 0 END AS images FROM pp)"""
add(
    "e21_document_type", lambda s, d: la.document_type(_pages(s, d)),
    f"WITH {D_PAGES}, g AS (SELECT doc_id, count(*) AS total_pages, avg(chars) AS t, avg(CASE WHEN images > 0 THEN 1.0 ELSE 0 END) AS r, count_if(chars > 50) AS pages_with_text, CAST(sum(images) AS BIGINT) AS total_images FROM pg GROUP BY doc_id), k AS (SELECT *, CASE WHEN t < 10 AND pages_with_text = 0 THEN 'pure_image' WHEN t < 100 AND r > 0.7 THEN 'scanned_document' "
    "WHEN t < 300 AND r > 0.5 THEN 'image_dominant' WHEN t > 300 AND r > 0.3 THEN 'hybrid_document' WHEN t > 300 AND r < 0.3 THEN 'text_dominant' ELSE 'mixed_content' END AS document_type FROM g) SELECT doc_id, total_pages, round(t, 6) AS text_density, round(r, 6) AS image_ratio, CAST(pages_with_text AS BIGINT) AS pages_with_text, total_images, document_type, "
    "CASE document_type WHEN 'pure_image' THEN 'ocr_first' WHEN 'scanned_document' THEN 'ocr_enhanced' WHEN 'image_dominant' THEN 'image_first' WHEN 'hybrid_document' THEN 'balanced' WHEN 'text_dominant' THEN 'text_first' ELSE 'adaptive' END AS strategy FROM k",
)
_images = lambda s, d: docs(s, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("idx", "line")).select("doc_id", "idx", (F.length("line") % 4 * 60 + 60).alias("width"), (F.col("idx") % 3 * 80 + 60).alias("height"))
_D_IMAGES = "im AS (SELECT doc_id, CAST(i AS INT) AS idx, CAST(length(line) % 4 * 60 + 60 AS INT) AS width, CAST(i % 3 * 80 + 60 AS INT) AS height FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))"
add("e22_image_filter", lambda s, d: la.image_filter(_images(s, d)), f"WITH {_D_IMAGES} SELECT * FROM im WHERE width >= 100 AND height >= 100")
add("e22_image_filter_once", lambda s, d: la.image_filter(_images(s, d), once=True), f"WITH {_D_IMAGES} SELECT * FROM im WHERE width >= 100 AND height >= 100 QUALIFY row_number() OVER (PARTITION BY doc_id, width, height ORDER BY idx) = 1")

#: The same expression in both engines: an outline of each document's words, in three levels and several spellings.
_W = lambda i: f"coalesce(w{i}, '')"
_OUTLINE = (
    "concat('{\"documentInfo\": {\"title\": \"Doc ', doc_id, '\"}, \"structureAnalysis\": [', "
    f"'{{\"title\": \" ', {_W(1)}, ' \", \"unit\": \"Chapter\", \"number\": \"No ', doc_id, '-2\", \"keywords\": [\"', {_W(2)}, '\", \"', {_W(3)}, '\", \"', {_W(2)}, '\"], \"summary\": \"', {_W(1)}, ' text\", \"pageRange\": ', doc_id, ', \"subStructure\": [', "
    f"'{{\"heading\": \"', {_W(4)}, '\", \"unit\": \"none\", \"keywords\": {{\"name\": \"', {_W(5)}, '\"}}, \"substructure\": [], \"children\": [{{\"name\": \"', {_W(6)}, '\", \"number\": 7, \"keywords\": [{{\"keyword\": \"', {_W(1)}, '\"}}]}}, {{\"unit\": \"소절\"}}]}}, ', "
    f"'{{\"title\": \"\", \"name\": \"', {_W(3)}, '\", \"sections\": {{\"title\": \"', {_W(2)}, '\", \"page\": \"9\"}}}}]}}, {{\"title\": \"Last\", \"body\": \" \"}}, 5]}}')"
)


def outline_replies(s, d):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{4,}"), 0)
    return docs(s, d).select("doc_id", words.alias("w")).select("doc_id", *[F.get("w", F.lit(i - 1)).alias(f"w{i}") for i in range(1, 7)]).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("name"), F.expr(_OUTLINE).alias("reply"))


_D_FIRST = lambda keys: "coalesce(" + ", ".join(f"nullif(trim(json_extract_string(node, '$.{k}')), '')" for k in keys.split()) + ")"
_D_BELOW = "CASE " + " ".join(f"WHEN json_type(node, '$.{k}') = 'ARRAY' AND json_array_length(node, '$.{k}') > 0 THEN json_extract(node, '$.{k}[*]') WHEN json_type(node, '$.{k}') = 'OBJECT' THEN [json_extract(node, '$.{k}')]" for k in "subStructure substructure substructures subSections subsections sections children".split()) + " ELSE [] END"
D_WALK = f"""wo AS (SELECT doc_id, {', '.join(f'w[{i}] AS w{i}' for i in range(1, 7))} FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{4,}}') AS w FROM documents)), js AS (SELECT doc_id, concat('d', doc_id) AS name, CAST({_OUTLINE} AS JSON) AS j FROM wo),
top AS (SELECT doc_id, concat('doc_', substr(sha1(name), 1, 16)) AS root, 'Doc ' || doc_id AS title, unnest(json_extract(j, '$.structureAnalysis[*]')) AS node, unnest(range(CAST(json_array_length(j, '$.structureAnalysis') AS BIGINT))) AS idx FROM js),
wk AS (SELECT doc_id, node, idx, 1 AS level, CAST(idx AS VARCHAR) AS path, root AS parent_id, title AS above, title AS titles FROM top WHERE json_type(node) = 'OBJECT' UNION ALL
 SELECT doc_id, b.node, b.idx, level + 1, concat(path, '.', b.idx), concat(CASE WHEN level = 1 THEN 'llm_section_' ELSE 'llm_subsection_' END, substr(sha1(concat_ws('|', own, path, level, parent_id)), 1, 16)), own, concat(titles, ' > ', own)
 FROM (SELECT *, coalesce({_D_FIRST('title heading name')}, concat('Level', level, '_Section_', idx + 1)) AS own, {_D_BELOW} AS below FROM wk) s, LATERAL (SELECT unnest(below) AS node, unnest(range(len(below))) AS idx) b),
sn AS (SELECT *, coalesce({_D_FIRST('title heading name')}, concat('Level', level, '_Section_', idx + 1)) AS own, json_extract_string(node, '$.unit') AS raw, list_distinct(list_filter(CASE WHEN json_type(node, '$.keywords') = 'OBJECT' THEN [json_extract_string(node, '$.keywords.name')]
 ELSE list_transform(coalesce(json_extract(node, '$.keywords[*]'), []), lambda k: coalesce(json_extract_string(k, '$.name'), json_extract_string(k, '$.keyword'), CASE WHEN json_type(k) = 'VARCHAR' THEN k ->> '$' END)) END, lambda k: k <> '')) AS set FROM wk),
so AS (SELECT *, concat(CASE WHEN level = 1 THEN 'llm_section_' ELSE 'llm_subsection_' END, substr(sha1(concat_ws('|', own, path, level, parent_id)), 1, 16)) AS id, CASE WHEN raw IN ('장', '절', '소절', '소소절') THEN raw WHEN lower(raw) IN ('chapter', 'section', 'subsection', 'subsubsection') THEN lower(raw) ELSE ['장', '절', '소절', '소소절'][least(level, 4)] END AS unit,
 coalesce(nullif(array_to_string(regexp_extract_all(coalesce(json_extract_string(node, '$.number'), ''), '\\d+'), ''), ''), CAST(idx + 1 AS VARCHAR)) AS number FROM sn),
kw AS (SELECT doc_id, id, level, path, above, unit, number, unnest(set) AS word FROM so)"""
_BASE = "SELECT doc_id, concat('doc_', substr(sha1(name), 1, 16)) AS id, 'Document' AS type, 'Doc ' || doc_id AS title, NULL AS unit, NULL AS number, 0 AS level, NULL AS path, 'Doc ' || doc_id AS section_path, NULL AS parent_section, NULL AS parent_id, NULL AS page, NULL AS content, '' AS keywords FROM js"
add(
    "k21_outline_sections", lambda s, d: ol.outline_graph(outline_replies(s, d))[0].filter("NOT type LIKE '%Keyword'").withColumn("keywords", F.array_join(F.sort_array("keywords"), ",")),
    f"WITH RECURSIVE {D_WALK} {_BASE} UNION ALL SELECT doc_id, id, CASE WHEN level = 1 THEN 'DocumentSection' ELSE 'DocumentSubsection' END, own, unit, number, level, path, concat(titles, ' > ', own), above, parent_id, coalesce(json_extract_string(node, '$.pageRange'), json_extract_string(node, '$.page'), ''), coalesce(json_extract_string(node, '$.summary'), ''), array_to_string(list_sort(set), ',') FROM so",
)
add(
    "k21_outline_edges", lambda s, d: ol.outline_graph(outline_replies(s, d))[1].filter("type <> 'HAS_KEYWORD'"),
    f"WITH RECURSIVE {D_WALK} SELECT doc_id, concat('rel_', substr(sha1(parent_id || id), 1, 16)) AS id, CASE WHEN level = 1 THEN 'CONTAINS_SECTION' ELSE 'HAS_SUBSECTION' END AS type, parent_id AS source, id AS target, unit, path AS hierarchical_path FROM so",
)
add(
    "k21_outline_keywords", lambda s, d: ol.outline_graph(outline_replies(s, d))[0].filter("type LIKE '%Keyword'").select("doc_id", "type", F.col("title").alias("word"), "unit", "number", "level", "path", "parent_section", "parent_id"),
    f"WITH RECURSIVE {D_WALK} SELECT doc_id, CASE WHEN level = 1 THEN 'SectionKeyword' ELSE 'SubsectionKeyword' END AS type, word, unit, number, level, path, above AS parent_section, id AS parent_id FROM kw",
)
