"""Queries over stored replies, metadata and outlines; replies are made from the documents' own keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import graph as g
from corpusmill.operators import keywords as k
from corpusmill.operators import records as r
from corpusmill.operators import structure as st

from .extraction import D_OCC
from .graphs import ALL as GRAPHS
from .structure import D_SECTIONS, headed
from .texts import d_words, docs

ALL: dict = {}


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


def _simple(s, d):
    return k.simple_keywords(docs(s, d))


def _replies(s, d):
    """A fenced JSON array of a document's keywords, as a model would return it."""
    rows = _simple(s, d).groupBy("doc_id").agg(F.collect_list(F.struct("keyword", "score", "category")).alias("a"))
    return rows.select("doc_id", F.concat(F.lit("Here:\n```json\n"), F.to_json("a"), F.lit("\n```")).alias("reply"))


def _relations(s, d):
    pairs = g.pairs_within(_simple(s, d)).select("doc_id", F.struct(F.lower("source").alias("entity1"), F.lower("target").alias("entity2"), F.lit("USES").alias("relationship"), F.lit(0.7).alias("confidence")).alias("p"))
    return pairs.groupBy("doc_id").agg(F.concat(F.lit("```json\n"), F.to_json(F.collect_list("p")), F.lit("\n```")).alias("reply"))


_S3 = f"WITH {D_OCC}, s3 AS (SELECT * FROM simple)"
add("d12_parse_llm_keywords", lambda s, d: r.parse_keywords(_replies(s, d)), f"{_S3} SELECT doc_id, keyword, CAST(score AS DOUBLE) AS score, category FROM s3")
add("d13_weighted_confidence", lambda s, d: _simple(s, d).select("doc_id", "keyword", r.weighted(F.col("score"), F.get(F.array(F.lit("high"), F.lit("low"), F.lit("none")), (F.col("rank") - 1) % 3)).alias("score")), f"{_S3} SELECT doc_id, keyword, round(score * CASE rank % 3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.8 END, 6) AS score FROM s3")
add("k25_parse_llm_relations", lambda s, d: r.parse_relations(_relations(s, d), _simple(s, d).select(F.lower("keyword").alias("name"))).select("doc_id", "entity1", "entity2"), f"{_S3} SELECT a.doc_id, lower(a.keyword) AS entity1, lower(b.keyword) AS entity2 FROM s3 a JOIN s3 b ON a.doc_id = b.doc_id AND a.rank < b.rank WHERE lower(a.keyword) <> lower(b.keyword)")
_COUNT = lambda words: " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in words.split())
#: Words that show a tone, which the tables lack, added to whole texts by id; the last is of no tone.
_TONED = ["연구 데이터", "공지 안내", "시스템 코드 데이터", "방법 단계 절차", "비교 검토 분석", "좋은 효과", "문제 실패 결과", "날씨"]
_TONE_WORDS = "('학술적', 1, ['연구', '분석', '결과', '방법론', '이론', '가설', '실험', '데이터']), ('공식적', 2, ['공지', '안내', '규정', '지침', '절차', '정책', '계획']), ('기술적', 3, ['시스템', '구현', '개발', '코드', '알고리즘', '프로그래밍', '소프트웨어']), ('설명적', 4, ['방법', '단계', '과정', '절차', '예시', '설명', '가이드']), ('분석적', 5, ['비교', '검토', '평가', '분석', '고찰', '조사', '연구']), ('긍정적', 6, ['성공', '향상', '개선', '효과', '발전', '좋은', '우수한']), ('부정적', 7, ['문제', '실패', '오류', '위험', '어려움', '부족', '나쁜'])"
add(
    "d22_tone", lambda s, d: r.tone(docs(s, d).withColumn("text", F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, _TONED)), (F.col("doc_id") % 8).cast("int"))))),
    f"WITH t AS (SELECT doc_id, lower(text || ' ' || {_TONED!r}[doc_id % 8 + 1]) AS text FROM documents), n AS (SELECT doc_id, tone, o, list_sum(list_transform(ws, lambda w: (length(text) - length(replace(text, w, ''))) // length(w))) AS n FROM t, (VALUES {_TONE_WORDS}) v(tone, o, ws)) "
    "SELECT doc_id, CASE WHEN max(n) = 0 THEN '일반적' ELSE arg_max(tone, n * 10 - o) END AS tone FROM n GROUP BY doc_id",
)
add("d24_fallback_metadata", lambda s, d: r.fallback_title(docs(s, d)), "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: trim(x)), lambda x: length(x) > 5 AND length(x) < 200 AND NOT regexp_matches(x, '^\\d+$') AND NOT starts_with(x, 'http') AND NOT contains(x, '@'))[1] AS title FROM documents")
add("d23_file_metadata", lambda s, d: r.file_metadata(docs(s, d).withColumn("filename", F.concat("source", F.lit("_report-"), "doc_id", F.lit(".TXT")))), "SELECT doc_id, 'txt' AS extension, concat_ws(',', source, 'report', CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 2 THEN CAST(doc_id AS VARCHAR) END) AS words, CASE WHEN length(text) < 5000 THEN '소형' WHEN length(text) < 50000 THEN '중형' WHEN length(text) < 200000 THEN '대형' ELSE '초대형' END AS size FROM documents")
_LINES = lambda p: F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(p)))
_D_LINES = lambda p: f"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{p}')))"
add("e17_complexity_score", lambda s, d: docs(s, d).select("doc_id", r.complexity(F.size(t.words(F.col("text"))), _LINES(r"^[A-Z]"), _LINES(r"\|")).alias("complexity")), f"SELECT doc_id, round(least(len({d_words('text')}) / 1000, 1.0) * 0.4 + least({_D_LINES('^[A-Z]')} / 10, 1.0) * 0.3 + least({_D_LINES(chr(92) + '|')} / 5, 1.0) * 0.3, 6) AS complexity FROM documents")
add("e29_file_catalogue", lambda s, d: docs(s, d).select("doc_id", "source", F.when(F.length("text") > 0, "success").otherwise("failed").alias("parse_status")), "SELECT doc_id, source, CASE WHEN length(text) > 0 THEN 'success' ELSE 'failed' END AS parse_status FROM documents")
add("e27_dublin_core", lambda s, d: docs(s, d).select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("dc_title"), F.coalesce("lang", F.lit("unknown")).alias("dc_language"), F.lit("text/plain").alias("dc_format"), F.concat("n_chars", F.lit(" characters")).alias("dc_extent"), F.sha2("text", 256).alias("dc_identifier")), "SELECT doc_id, concat(source, '/', doc_id) AS dc_title, coalesce(lang, 'unknown') AS dc_language, 'text/plain' AS dc_format, concat(n_chars, ' characters') AS dc_extent, sha256(text) AS dc_identifier FROM documents")
_HL = lambda s, d: r.headed_lines(st.lines(headed(s, d)), st.sections(headed(s, d)))
D_HL = f"WITH {D_SECTIONS}, hl AS (SELECT doc_id, line_no, line, last_value(CASE WHEN level = 1 THEN line_no END IGNORE NULLS) OVER w AS chapter, last_value(CASE WHEN level > 1 THEN line_no END IGNORE NULLS) OVER w AS section FROM li LEFT JOIN (SELECT doc_id, line_no, level FROM sec) USING (doc_id, line_no) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"
add("f02_hierarchy_assign", lambda s, d: _HL(s, d).select("doc_id", "line_no", F.coalesce("chapter", F.lit(0)).alias("chapter"), F.coalesce("section", F.lit(0)).alias("section")), f"{D_HL} SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(coalesce(chapter, 0) AS INT) AS chapter, CAST(coalesce(section, 0) AS INT) AS section FROM hl")
_NEAR = f"""{_S3}, g AS (SELECT doc_id, keyword, rank, lower(keyword) AS k, string_split(lower(text), lower(keyword)) AS parts FROM s3 JOIN documents USING (doc_id)),
q AS (SELECT doc_id, keyword, rank, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS last, length(k) AS n FROM g),
p AS (SELECT doc_id, keyword, rank, p FROM (SELECT doc_id, keyword, rank, i, last, sum(length(part) + n) OVER (PARTITION BY doc_id, keyword ORDER BY i) - n AS p FROM q) WHERE i < last),
near AS (SELECT a.doc_id, a.keyword AS source, b.keyword AS target, abs(a.p - b.p) AS gap FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.rank < b.rank AND abs(a.p - b.p) <= 100 JOIN documents d ON d.doc_id = a.doc_id
WHERE NOT regexp_matches(substr(d.text, CAST(least(a.p, b.p) AS BIGINT) + 1, CAST(abs(a.p - b.p) AS BIGINT)), '\\n\\n|\\. |\\.\\n|\\||- \\*\\*|## '))"""
add("k15_near_pairs", lambda s, d: r.near_pairs(_simple(s, d), docs(s, d)), _NEAR + " SELECT doc_id, source, target, CAST(min(gap) AS INT) AS gap FROM near GROUP BY ALL")
add("q14_leaf_paths", lambda s, d: r.leaf_paths(st.section_parents(st.sections(headed(s, d)))), GRAPHS["k13_structure_depth"][1].replace("line_no, 0 AS depth FROM sp", "line_no, CAST(line_no AS VARCHAR) AS path FROM sp").replace("w.depth + 1", "concat(w.path, '>', p.line_no)").replace("SELECT doc_id, line_no, CAST(depth AS INT) AS depth FROM walk", "SELECT doc_id, line_no, path FROM walk w WHERE NOT EXISTS (SELECT 1 FROM sp p WHERE p.doc_id = w.doc_id AND p.parent_line = w.line_no)"))
#: The same expression in both engines: records with more or fewer parts by the document's number.
_RECORD = (
    "concat('{\"source\": \"', coalesce(source, ''), '\", \"id\": ', doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(', \"docling_structure\": {\"tables\": [', CASE WHEN doc_id % 3 = 0 THEN '1, 2' ELSE '' END, '], \"sections\": [{}], \"images\": 4}') ELSE '' END, "
    "CASE WHEN doc_id % 5 = 0 THEN ', \"document_structure\": {}' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN ', \"text_statistics\": {}' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN ', \"content_analysis\": null' ELSE '' END, '}')"
)
add(
    "e16_richness_score", lambda s, d: docs(s, d).select("doc_id", r.richness(F.expr(_RECORD)).alias("richness")),
    f"WITH j AS (SELECT doc_id, CAST({_RECORD} AS JSON) AS j FROM documents), k AS (SELECT *, json_keys(j) AS k FROM j) SELECT doc_id, CAST(10 + len(k) + CASE WHEN list_contains(k, 'docling_structure') THEN 20 + 10 * json_array_length(j, '$.docling_structure.tables') + 5 * json_array_length(j, '$.docling_structure.sections') ELSE 0 END "
    "+ CASE WHEN list_contains(k, 'document_structure') THEN 10 ELSE 0 END + CASE WHEN list_contains(k, 'text_statistics') THEN 5 ELSE 0 END + CASE WHEN list_contains(k, 'content_analysis') THEN 15 ELSE 0 END AS INT) AS richness FROM k",
)
