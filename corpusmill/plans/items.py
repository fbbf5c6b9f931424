"""Queries of Markdown items, over whole texts with Markdown lines, which the tables lack, put before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import items as it
from corpusmill.operators import keywords as k
from corpusmill.operators import structure as st

from .extraction import D_OCC
from .structure import D_SECTIONS, headed
from .texts import docs

ALL: dict = {}


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


#: The same expression in both engines.
MARKED = (
    "concat('# Report ', coalesce(source, ''), chr(10), '#### Part ', doc_id, chr(10), '- item ', doc_id, chr(10), '12. step', chr(10), '| name | value |', chr(10), '| --- | --- |', chr(10), "
    "'| source | ', coalesce(source, ''), ' |', chr(10), '| id | ', doc_id, ' |', chr(10), '[home](http://x.y) ![pic](p.png)', chr(10), '```py', chr(10), 'x = 1', chr(10), '```', chr(10), coalesce(text, ''))"
)
D_MARKED = f"WITH m AS (SELECT doc_id, source, {MARKED} AS text FROM documents), ls AS (SELECT doc_id, text, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM m)), li AS (SELECT doc_id, text, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM ls)"


def marked(s, d):
    return docs(s, d).select("doc_id", F.expr(MARKED).alias("text"))


add(
    "d16_heading_items", lambda s, d: it.heading_and_list_items(marked(s, d)),
    f"{D_MARKED}, x AS (SELECT doc_id, line_no, text, s, length(regexp_extract(s, '^#*')) AS depth, trim(regexp_extract(s, '^(?:#{{1,6}}|[-*+]|\\d+\\.)\\s+(.+)$', 1)) AS keyword FROM li WHERE regexp_matches(s, '^(#{{1,6}}|[-*+]|\\d+\\.)\\s+.')) "
    "SELECT doc_id, CAST(line_no AS INT) AS line_no, keyword, CASE WHEN depth = 1 THEN 'title_h1' WHEN depth = 2 THEN 'title_h2' WHEN depth = 3 THEN 'title_h3' WHEN depth > 3 THEN 'title_h4_h6' WHEN regexp_matches(s, '^\\d') THEN 'numbered_item' ELSE 'list_item' END AS category, "
    "CAST(CASE WHEN depth = 1 THEN 1.0 WHEN depth = 2 THEN 0.9 WHEN depth = 3 THEN 0.8 WHEN depth > 3 THEN 0.7 WHEN regexp_matches(s, '^\\d') THEN 0.6 ELSE 0.5 END AS DOUBLE) AS score, CAST(strpos(text, s) - 1 AS INT) AS start_position, CAST(strpos(text, s) - 1 + length(keyword) AS INT) AS end_position FROM x WHERE length(keyword) >= CASE WHEN depth > 0 THEN 2 ELSE 3 END",
)
_N = lambda p: f"CAST(len(regexp_extract_all(text, '{p}')) AS INT)"
add(
    "e08_md_structure", lambda s, d: it.md_structure(marked(s, d)),
    f"{D_MARKED}, c AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?m)^#+\\s+.+$'), lambda h: concat(length(regexp_extract(h, '^#+')), ':', regexp_replace(regexp_replace(h, '^#+\\s+', ''), '\\s+$', ''))), '|') AS headings, {_N('\\[([^\\]]+)\\]\\(([^)]+)\\)')} AS links, {_N('!\\[([^\\]]*)\\]\\(([^)]+)\\)')} AS images, "
    f"{_N('(?s)```(\\w+)?\\n(.*?)```')} AS code_blocks, CAST(len(list_distinct(regexp_extract_all(text, '(?m)^\\|.+\\|$'))) // 2 AS INT) AS tables, {_N('(?m)^\\s*[-*+]\\s+')} AS unordered, {_N('(?m)^\\s*\\d+\\.\\s+')} AS ordered FROM m) SELECT *, unordered + ordered AS total FROM c",
)
_D_TABLES = f"{D_MARKED}, r AS (SELECT doc_id, line_no, s, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run, list_transform(string_split(substr(s, 2, length(s) - 2), '|'), lambda x: trim(x)) AS cells FROM li WHERE regexp_matches(s, '^\\|.*\\|$')), h AS (SELECT *, first_value(cells) OVER w AS header, row_number() OVER w AS i, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) AS table_no FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY line_no)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) - 1 AS row_no FROM h WHERE i > 1 AND NOT regexp_matches(s, '^\\|[\\s:|-]*\\|$'))"
add("e25_markdown_tables", lambda s, d: it.table_cells(it.markdown_tables(marked(s, d))), f"{_D_TABLES} SELECT doc_id, CAST(table_no AS INT) AS table_no, CAST(row_no AS INT) AS row_no, CAST(c AS INT) AS column_no, header[c + 1] AS column_name, cells[c + 1] AS value FROM (SELECT *, unnest(range(len(cells))) AS c FROM b)")
add("e26_table_lookup", lambda s, d: it.table_lookup(it.markdown_tables(marked(s, d)), "source", "value"), f"{_D_TABLES} SELECT doc_id, CAST(table_no AS INT) AS table_no, cells[list_position(header, 'value')] AS value FROM b WHERE list_contains(header, 'value') AND cells[1] = 'source'")
_TAGGED = f"concat(coalesce(text, ''), repeat('{it.IMAGE_TAG}', CAST(doc_id % 120 AS INT)))"
add(
    "e20_scanned_flag", lambda s, d: it.scanned_flag(docs(s, d).select("doc_id", F.expr(_TAGGED).alias("text"))),
    f"WITH t AS (SELECT doc_id, {_TAGGED} AS text FROM documents), n AS (SELECT doc_id, CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS INT) AS chars, CAST(length(regexp_replace(replace(text, '<!-- image -->', ''), '^\\s+|\\s+$', '', 'g')) AS INT) AS actual, CAST(len(string_split(text, '<!-- image -->')) - 1 AS INT) AS tags FROM t) SELECT *, round(CASE WHEN chars > 0 THEN actual / chars ELSE 0 END, 6) AS density, chars > 0 AND actual / chars < 0.3 AND tags >= 10 AND actual < 500 AS is_scanned FROM n",
)


def _summaries(s, d):
    """A reply in a code fence as a model would give it, its parts taken from the document."""
    topics = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), 0), 1, 7)
    parts = F.struct(F.col("text").alias("intro"), F.lit("").alias("conclusion"), F.col("source").alias("core"), topics.alias("topics"), F.col("lang").alias("tone"))
    return docs(s, d).select("doc_id", F.concat(F.lit("Here:\n```json\n"), F.to_json(parts), F.lit("\n```")).alias("reply"))


add(
    "d27_parse_llm_summary", lambda s, d: it.parse_summaries(_summaries(s, d)),
    "WITH p AS (SELECT doc_id, 'summary_intro' AS category, 0.9 AS score, substr(text, 1, 150) AS keyword FROM documents UNION ALL SELECT doc_id, 'summary_core', 1.0, substr(source, 1, 150) FROM documents UNION ALL SELECT doc_id, 'summary_tone', 0.7, substr(lang, 1, 50) FROM documents "
    "UNION ALL SELECT doc_id, 'summary_topic', 0.8, unnest(regexp_extract_all(text, '[A-Za-z]{5,}')[1:5]) FROM documents) SELECT doc_id, category, CAST(score AS DOUBLE) AS score, keyword FROM p WHERE keyword <> ''",
)
add(
    "k12_structure_keyword_join", lambda s, d: it.structure_keywords(st.lines(headed(s, d)), st.sections(headed(s, d)), k.simple_keywords(docs(s, d))),
    f"WITH {D_SECTIONS}, {D_OCC}, pl AS (SELECT li.doc_id, li.line_no, line, last_value(sec.line_no IGNORE NULLS) OVER (PARTITION BY li.doc_id ORDER BY li.line_no ROWS UNBOUNDED PRECEDING) AS start FROM li LEFT JOIN sec ON sec.doc_id = li.doc_id AND sec.line_no = li.line_no), "
    "co AS (SELECT doc_id, start, lower(string_agg(line, chr(10) ORDER BY line_no)) AS content FROM pl WHERE start IS NOT NULL GROUP BY ALL), wo AS (SELECT DISTINCT doc_id, extractor, lower(keyword) AS word FROM simple), "
    "hi AS (SELECT doc_id, start AS line_no, extractor, word FROM co JOIN wo USING (doc_id) WHERE contains(content, word)) SELECT * FROM hi UNION ALL SELECT wo.doc_id, f.line_no, extractor, word FROM wo JOIN (SELECT doc_id, min(line_no) AS line_no FROM sec GROUP BY 1) f USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.doc_id = wo.doc_id AND hi.word = wo.word AND hi.extractor = wo.extractor)",
)
