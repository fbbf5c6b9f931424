"""Queries over sections, elements and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import keywords as k
from corpusmill.operators import structure as st

from .extraction import D_COUNTED
from .texts import docs

ALL: dict = {}


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


def headed(s, d):
    """Documents with numbered and Markdown headings and blank lines put between their lines, which stay whole, so that structure rules meet headings."""
    lines = F.split("text", "\n", -1)
    numbered, marked = (lambda x, i: F.concat(i + 1, F.lit(". "), F.substring(x, 1, 30))), (lambda x: F.concat(F.lit("## "), F.substring(x, 1, 30)))
    mark = lambda x, i: F.when(i % 5 == 0, F.array(numbered(x, i), x)).when(i % 5 == 2, F.array(marked(x), x)).when(i % 5 == 3, F.array(F.lit(""), x)).otherwise(F.array(x))
    return docs(s, d).select("doc_id", F.array_join(F.flatten(F.transform(lines, mark)), "\n").alias("text"))


D_HEADED = "hd AS (SELECT doc_id, array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN [concat(i, '. ', substr(x, 1, 30)), x] WHEN (i - 1) % 5 = 2 THEN [concat('## ', substr(x, 1, 30)), x] WHEN (i - 1) % 5 = 3 THEN ['', x] ELSE [x] END)), chr(10)) AS text FROM documents)"
D_STYLE = r"""CASE WHEN s = '' THEN NULL WHEN regexp_matches(s, '^\d+(\.\d+)*\s*[.)]?\s+.') THEN 'numbered' WHEN regexp_matches(s, '^제?\s*\d+\s*[장절항]\s*[.:]?\s*.') THEN 'korean'
 WHEN regexp_matches(s, '^[IVXLCDM]{1,4}\s*[.)]?\s+.') THEN 'roman' WHEN regexp_matches(s, '^#{1,6}\s+.') THEN 'markdown' WHEN regexp_matches(s, '^[A-Z][A-Z\s]{2,}$') AND length(s) < 50 AND (before = '' OR after = '') THEN 'uppercase'
 WHEN regexp_matches(s, '^[가-힣A-Za-z0-9\s]+\s*[:：-]$') THEN 'separator' WHEN length(s) > 5 AND length(s) < 50 AND before = '' AND after = '' AND NOT regexp_matches(s, '[.。!?！？]$') AND regexp_matches(s, '^[가-힣A-Za-z]') THEN 'isolated' END"""
D_SECTIONS = f"""{D_HEADED}, ll AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM hd)),
li AS (SELECT doc_id, line_no, line, trim(line) AS s, coalesce(trim(lag(line) OVER w), '') AS before, coalesce(trim(lead(line) OVER w), '') AS after FROM ll WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
sty AS (SELECT *, {D_STYLE} AS style FROM li),
sec AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE style WHEN 'numbered' THEN regexp_extract(s, '^\\d+(\\.\\d+)*') WHEN 'roman' THEN regexp_extract(s, '^[IVXLCDM]+') WHEN 'korean' THEN regexp_extract(s, '\\d+') END AS number,
 CASE style WHEN 'numbered' THEN regexp_replace(s, '^\\d+(\\.\\d+)*\\s*[.)]?\\s+', '') WHEN 'roman' THEN regexp_replace(s, '^[IVXLCDM]+\\s*[.)]?\\s+', '') WHEN 'markdown' THEN regexp_replace(s, '^#+\\s+', '') WHEN 'separator' THEN trim(regexp_replace(s, '\\s*[:：-]$', '')) WHEN 'korean' THEN regexp_replace(s, '^제?\\s*\\d+\\s*[장절항]\\s*[.:]?\\s*', '') ELSE s END AS title,
 CAST(CASE style WHEN 'numbered' THEN len(string_split(regexp_extract(s, '^\\d+(\\.\\d+)*'), '.')) WHEN 'markdown' THEN length(regexp_extract(s, '^#+')) WHEN 'separator' THEN 2 WHEN 'isolated' THEN 3 ELSE 1 END AS INT) AS level, style FROM sty WHERE style IS NOT NULL)"""
_sections = lambda s, d: st.sections(headed(s, d))
add("e01_section_detect", _sections, f"WITH {D_SECTIONS} SELECT * FROM sec")
add("e02_element_counts", lambda s, d: st.element_counts(headed(s, d)), f"WITH {D_SECTIONS} SELECT doc_id, CAST(count_if(regexp_matches(line, '\\|.*\\||[<\\[]?\\s*표\\s*\\d+|[표表]\\s*[\\d一二三四五六七八九十]+|(?i:Table\\s*\\d+|<table)|┌|├|└|─|│')) AS BIGINT) AS tables, "
    "CAST(count_if(regexp_matches(line, '(?i:그림\\s*\\d+|Figure\\s*\\d+|Fig\\.\\s*\\d+|차트\\s*\\d+|Chart\\s*\\d+|도표\\s*\\d+|사진\\s*\\d+|이미지\\s*\\d+)|!\\[.*\\]\\(.*\\)')) AS BIGINT) AS figures, CAST(count_if(regexp_matches(line, '^\\[\\d+\\]|참고문헌|(?i:References|Bibliography)')) AS BIGINT) AS \"references\", "
    "CAST(count_if(regexp_matches(line, '\\[\\^\\d+\\]|주\\s*\\d+[:\\)]')) AS BIGINT) AS footnotes, CAST(count_if(regexp_matches(line, '^\\s*[-*•]\\s+|^\\s*\\d+[.)]\\s+|^\\s*[A-Za-z][.)]\\s+')) AS BIGINT) AS lists FROM sty WHERE s <> '' AND (style IS NULL OR style = 'isolated') GROUP BY doc_id")
add("e03_outline_summary", lambda s, d: st.outline_summary(_sections(s, d)), f"WITH {D_SECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM sec) SELECT doc_id, count(*) AS total, max(level) AS max_level, bool_or(regexp_matches(title, '서론|Introduction|개요')) AS has_introduction, bool_or(regexp_matches(title, '결론|Conclusion|맺음')) AS has_conclusion, string_agg(title, '|' ORDER BY line_no) FILTER (r <= 20) AS main, CASE WHEN count(*) > 3 THEN 'good' ELSE 'poor' END AS quality FROM r GROUP BY doc_id")
add("e09_md_sections", lambda s, d: _sections(s, d).filter("style = 'markdown'").select("doc_id", "line_no", "level", "title"), f"WITH {D_SECTIONS} SELECT doc_id, line_no, level, title FROM sec WHERE style = 'markdown'")
add("k10_section_parent", lambda s, d: st.section_parents(_sections(s, d)).drop("path"), f"WITH {D_SECTIONS} SELECT a.doc_id, a.line_no, max(b.line_no) AS parent_line FROM sec a LEFT JOIN sec b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.level < a.level GROUP BY ALL")
add(
    "e19_block_split", lambda s, d: st.blocks(headed(s, d)),
    f"WITH {D_SECTIONS}, kd AS (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN starts_with(s, '#') THEN 'header' WHEN contains(s, '|') THEN 'table' ELSE 'paragraph' END AS kind FROM li), ch AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = kind AND kind <> 'header' THEN 0 ELSE 1 END AS new FROM kd), bl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM ch) SELECT doc_id, CAST(block AS BIGINT) AS block, kind, CAST(min(line_no) AS INT) AS first_line, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM bl GROUP BY doc_id, block, kind",
)
add("e30_section_text", lambda s, d: _sections(s, d).join(headed(s, d), "doc_id").filter("style = 'markdown'").select("doc_id", "line_no", F.expr("substring(text, greatest(locate(title, text), 1), 5000)").alias("section_text")), f"WITH {D_SECTIONS} SELECT doc_id, line_no, substr(text, greatest(strpos(text, title), 1), 5000) AS section_text FROM sec JOIN hd USING (doc_id) WHERE style = 'markdown'")
add(
    "f05_token_budget_merge", lambda s, d: st.budget_merge(docs(s, d)),
    "WITH RECURSIVE p AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents)), c AS (SELECT doc_id, i, length(x) // 4 AS cost FROM p), w AS (SELECT doc_id, i, cost AS used, 0 AS chunk FROM c WHERE i = 0 UNION ALL SELECT c.doc_id, c.i, CASE WHEN w.used + c.cost > 500 AND w.used > 0 THEN c.cost ELSE w.used + c.cost END, CASE WHEN w.used + c.cost > 500 AND w.used > 0 THEN chunk + 1 ELSE chunk END FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i + 1) SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last FROM w GROUP BY doc_id, chunk",
)
_S = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
add("f08_chunk_summary", lambda s, d: st.chunk_summary(docs(s, d)), f"WITH l AS (SELECT doc_id, CAST(length(text) AS INT) AS length, {_S} AS l FROM documents) SELECT doc_id, length, CASE WHEN length(l[1]) > 100 THEN substr(l[1], 1, 100) || '...' ELSE l[1] END AS intro, CASE WHEN length(l[-1]) > 100 THEN substr(l[-1], 1, 100) || '...' ELSE l[-1] END AS conclusion, CAST(len(l) AS INT) AS lines FROM l")
add("f09_chunk_structure", lambda s, d: st.chunk_structure(headed(s, d)), f"WITH {D_HEADED} SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#|^제?\\d+[장절]|^\\d+\\.'))) AS INT) AS headers, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*[-*•]\\s|^\\s*\\d+\\.\\s'))) AS INT) AS lists, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 50)) > 0 AS has_paragraph FROM hd")
_turn_words = lambda s, d: k.counted_words(s.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 10000 + F.col("turn")).alias("doc_id"), "text"))
_rank = lambda: Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
_top5 = lambda s, d: _turn_words(s, d).withColumn("rank", F.row_number().over(_rank())).filter("rank <= 5")
D_TURNS = D_COUNTED.replace("FROM documents", "FROM (SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations)") + ", t5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) <= 5)"
add(
    "f10_integrate_keywords", lambda s, d: _top5(s, d).groupBy(F.lower("keyword").alias("keyword")).agg(F.count(F.lit(1)).alias("frequency"), F.max(0.9 - F.col("rank") * 0.1).alias("m"), F.min("doc_id").alias("first_chunk")).select("keyword", "frequency", F.round("m", 6).alias("score"), "first_chunk").orderBy(F.desc(F.col("score") * F.col("frequency")), "keyword").limit(50),
    f"WITH {D_TURNS} SELECT lower(keyword) AS keyword, count(*) AS frequency, round(max(0.9 - rank * 0.1), 6) AS score, min(doc_id) AS first_chunk FROM t5 GROUP BY 1 ORDER BY round(max(0.9 - rank * 0.1), 6) * count(*) DESC, 1 LIMIT 50",
)
add(
    "f11_topics_by_level", lambda s, d: k.top(_top5(s, d).join(s.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 10000 + F.col("turn")).alias("doc_id"), "role"), "doc_id").groupBy("role", F.lower("keyword").alias("topic")).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), "topic"], 10, "role").drop("rank"),
    f"WITH {D_TURNS}, g AS (SELECT role, lower(keyword) AS topic, count(*) AS n FROM t5 JOIN conversations c ON t5.doc_id = c.conv_id * 10000 + c.turn GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, topic) <= 10",
)
add("f12_cooccur_graph", lambda s, d: _top5(s, d).withColumn("target", F.lead("keyword").over(Window.partitionBy("doc_id").orderBy("rank"))).filter("target IS NOT NULL").select("doc_id", F.col("keyword").alias("source"), "target"), f"WITH {D_TURNS}, e AS (SELECT doc_id, keyword AS source, lead(keyword) OVER (PARTITION BY doc_id ORDER BY rank) AS target FROM t5) SELECT * FROM e WHERE target IS NOT NULL")
add("f14_structure_rollup", lambda s, d: st.turns(s.read.parquet(f"{d}/conversations.parquet")).groupBy("level").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("length")), "SELECT role AS level, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS length FROM conversations GROUP BY role")
