"""Queries of the extractors and of places in texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import keywords as k
from corpusmill.operators import positions as p

from .texts import D_STOPS, d_meaningful, docs

ALL: dict = {}


def first_word(text: str) -> list[tuple[str, float, str | None]]:
    """An extractor that cannot read texts with two exclamation marks."""
    if "!!" in text:
        raise ValueError("unreadable")
    return [(w, 0.5, "first") for w in re.findall("[A-Za-z]+", text)[:1]]


if "first_word" not in k.available():
    k.register("first_word", k.text_extractor("first_word", first_word))
METHODS = ["simple", "pattern", "freq"]


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


D_TOKENS = "tok AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS ws FROM documents))"
D_COUNTED = D_TOKENS + r""",
kw AS (SELECT doc_id, CASE WHEN regexp_matches(w, '^[가-힣]{2,}') THEN regexp_extract(w, '^[가-힣]{2,}') WHEN regexp_matches(w, '^[a-zA-Z]{3,}$') THEN w END AS keyword, i FROM tok),
counted AS (SELECT doc_id, keyword, count(*) AS n, min(i) AS first FROM kw WHERE keyword IS NOT NULL GROUP BY ALL)"""
_NAMES = ", ".join(f"'{w}'" for w in k.NO_NAMES)
D_OCC = f"""{D_COUNTED},
simple AS (SELECT doc_id, keyword, 'simple' AS extractor, round(0.8 - (row_number() OVER w - 1) * 0.1, 1) AS score, 'noun' AS category, row_number() OVER w AS rank, n FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, first) QUALIFY row_number() OVER w <= 10),
pats AS (SELECT doc_id, 'DATE' AS category, 0.8 AS score, unnest(regexp_extract_all(text, '\\d{{4}}년')) AS keyword, 0 AS i FROM documents
  UNION ALL SELECT doc_id, 'MISC', 0.6, w, i FROM tok WHERE regexp_matches(w, '^[A-Z][A-Za-z]{{2,}}$') AND lower(w) NOT IN ({_NAMES})),
pat AS (SELECT doc_id, keyword, 'pattern' AS extractor, score, category FROM (SELECT doc_id, arg_min(keyword, i) AS keyword, category, score, min(i) AS first FROM pats GROUP BY doc_id, lower(keyword), category, score) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, keyword) <= 20),
fw AS (SELECT doc_id, lower(w) AS keyword, count(*) AS n, min(i) AS first FROM tok WHERE regexp_matches(w, '^[A-Za-z]{{3,}}$|^[가-힣]{{2,}}$') AND {d_meaningful('w')} GROUP BY ALL),
fr AS (SELECT doc_id, keyword, 'freq' AS extractor, round(least(1.0, n / sum(n) OVER (PARTITION BY doc_id) * 10), 6) AS score, NULL AS category, first, n FROM fw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) <= 10),
occ AS (SELECT doc_id, keyword, extractor, CAST(score AS DOUBLE) AS score, category FROM simple UNION ALL SELECT doc_id, keyword, extractor, CAST(score AS DOUBLE), category FROM pat UNION ALL SELECT doc_id, keyword, extractor, score, category FROM fr)"""


def occurrences(spark, sf_dir):
    return k.multi_extract(docs(spark, sf_dir), METHODS)


add("d01_multi_extract", occurrences, f"WITH {D_OCC} SELECT * FROM occ")
add("d02_best_per_keyword_extractor", lambda s, d: k.best_per_keyword(occurrences(s, d)), f"WITH {D_OCC} SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY keyword, extractor ORDER BY score DESC, doc_id) = 1")
add("d03_freq_keywords", lambda s, d: k.freq_keywords(docs(s, d)).drop("category"), f"WITH {D_OCC} SELECT doc_id, keyword, extractor, score FROM fr")
add(
    "d04_ngram_candidates", lambda s, d: k.ngrams(docs(s, d), most=1000),
    f"WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN ({D_STOPS})) AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS ngram FROM l UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM l), c AS (SELECT doc_id, ngram, count(*) AS tf FROM g GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, ngram) <= 1000",
)
_VEC = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet")
add(
    "d05_similarity_rank", lambda s, d: k.similarity_rank(_VEC(s, d), 10).select("label", "vec_id", "similarity"),
    "WITH m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label), s AS (SELECT e.label, vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), c), 6) AS similarity FROM embeddings e JOIN m USING (label)) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) <= 10",
)
add("d06_mmr_select", lambda s, d: k.mmr_select(_VEC(s, d)))
#: Hangul names, which the tables lack, added to whole texts.
_HANGUL = " 2024년 매출은 5억원이며 삼성전자 한국Corporation 중공업 우리은행 대한산업 서울특별시 부산광역시 강남구"
add(
    "d07_pattern_entities", lambda s, d: k.pattern_entities(docs(s, d).withColumn("text", F.concat("text", F.lit(_HANGUL)))),
    f"WITH hd AS (SELECT doc_id, text || '{_HANGUL}' AS text FROM documents), x AS (SELECT doc_id, 'DATE' AS category, 0.8 AS score, regexp_extract_all(text, '\\d{{4}}년') AS ks FROM hd UNION ALL SELECT doc_id, 'MONEY', 0.85, regexp_extract_all(text, '\\d+[억만천]?원') FROM hd "
    "UNION ALL SELECT doc_id, 'ORG', 0.75, regexp_extract_all(text, '[가-힣]{2,}(전자|그룹|회사|기업|산업|코퍼레이션|Corporation|Inc|Ltd)') FROM hd UNION ALL SELECT doc_id, 'LOC', 0.7, regexp_extract_all(text, '[가-힣]{2,}(시|도|구|군|동|면|읍|특별시|광역시)') FROM hd), "
    "h AS (SELECT doc_id, category, score, unnest(ks) AS keyword, generate_subscripts(ks, 1) AS i FROM x), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS ws FROM hd)), "
    "e AS (SELECT * FROM h UNION ALL SELECT doc_id, 'MISC', 0.6, w, i FROM w WHERE regexp_matches(w, '^[A-Z][A-Za-z]{2,}$') AND lower(w) NOT IN ('the', 'and', 'for', 'are', 'but', 'not', 'you', 'all', 'this', 'that', 'with', 'from', 'they', 'have', 'more', 'will', 'been', 'were', 'said', 'each', 'which', 'their', 'time', 'would', 'there', 'what', 'about', 'when', 'after', 'first', 'other', 'many', 'some', 'very', 'come', 'could', 'make', 'know', 'just', 'into', 'over', 'think', 'also', 'back', 'only', 'good', 'work', 'life', 'way', 'even', 'new', 'want', 'because', 'any', 'these', 'give', 'day', 'most', 'us')) "
    "SELECT doc_id, keyword, 'pattern' AS extractor, CAST(score AS DOUBLE) AS score, category FROM (SELECT doc_id, arg_min(keyword, i) AS keyword, category, score, min(i) AS first FROM e GROUP BY doc_id, lower(keyword), category, score) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, keyword) <= 20",
)
add("d08_entity_dedup_topk", lambda s, d: k.entity_top(occurrences(s, d), 10).drop("rank"), f"WITH {D_OCC}, o AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY doc_id, lower(keyword), category ORDER BY score DESC, keyword) = 1) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword, extractor) <= 10")
add(
    "d09_label_confidence",
    lambda s, d: k.pattern_entities(docs(s, d)).withColumn("label", F.get(F.array(*map(F.lit, [*k.LABEL_CONFIDENCE, "OTHER"])), (F.col("doc_id") % 24).cast("int"))).select("doc_id", "keyword", "label", k.label_confidence(F.col("label")).alias("confidence")),
    f"WITH {D_OCC}, c AS (SELECT * FROM (VALUES (0, 'PERSON', 0.9), (1, 'ORG', 0.85), (2, 'LOC', 0.8), (3, 'DATE', 0.75), (4, 'TIME', 0.7), (5, 'MONEY', 0.85), (6, 'PERCENT', 0.8), (7, 'MISC', 0.6), (8, 'PS', 0.85), (9, 'LC', 0.8), (10, 'OG', 0.85), (11, 'DT', 0.75), "
    "(12, 'TI', 0.7), (13, 'QT', 0.8), (14, 'CV', 0.75), (15, 'AM', 0.7), (16, 'PT', 0.7), (17, 'MT', 0.7), (18, 'TR', 0.7), (19, 'EV', 0.75), (20, 'AF', 0.7), (21, 'FD', 0.75), (22, 'TM', 0.7), (23, 'OTHER', 0.65)) v(i, label, confidence)) "
    "SELECT doc_id, keyword, label, CAST(confidence AS DOUBLE) AS confidence FROM pat JOIN c ON c.i = doc_id % 24",
)
add("d10_noun_score", lambda s, d: k.noun_score(docs(s, d)), f"WITH {D_COUNTED} SELECT doc_id, keyword, round(least(1.0, n / max(n) OVER (PARTITION BY doc_id) + least(0.2, (length(keyword) - 2) * 0.05)), 6) AS score FROM counted")
add("d14_group_mean_dedup", lambda s, d: k.group_mean(occurrences(s, d)), f"WITH {D_OCC} SELECT doc_id, keyword, floor(avg(score) OVER (PARTITION BY lower(keyword)) * 1000 + 1e-6) / 1000 AS score FROM occ QUALIFY row_number() OVER (PARTITION BY lower(keyword) ORDER BY score DESC, doc_id, extractor, keyword) = 1")
add(
    "d15_overlap_chunks", lambda s, d: k.overlap_chunks(docs(s, d)),
    """WITH RECURSIVE w AS (
      SELECT doc_id, text, 0 AS chunk, 0 AS start, 0 AS e, true AS fresh FROM documents
      UNION ALL
      SELECT doc_id, text, CASE WHEN fresh THEN chunk ELSE chunk + 1 END, CASE WHEN fresh THEN 0 ELSE greatest(e - 200, start + 1) END, NULL, false FROM (SELECT 1) WHERE false)
    , r AS (
      SELECT doc_id, 0 AS chunk, 0 AS start, cut AS e, text FROM (SELECT doc_id, text, 0 AS s, substr(text, 1, 2000) AS v FROM documents), LATERAL (SELECT CASE WHEN 2000 >= length(text) THEN length(text) WHEN contains(v, '.') AND length(v) - strpos(reverse(v), '.') + 1 > 1000 THEN length(v) - strpos(reverse(v), '.') + 1 WHEN contains(v, chr(10)) AND length(v) - strpos(reverse(v), chr(10)) + 1 > 1000 THEN length(v) - strpos(reverse(v), chr(10)) + 1 ELSE 2000 END AS cut)
      UNION ALL
      SELECT doc_id, chunk + 1, s, cut, text FROM (SELECT doc_id, chunk, text, greatest(e - 200, start + 1) AS s, substr(text, greatest(e - 200, start + 1) + 1, 2000) AS v FROM r WHERE e < length(text)), LATERAL (SELECT CASE WHEN s + 2000 >= length(text) THEN length(text) WHEN contains(v, '.') AND length(v) - strpos(reverse(v), '.') + 1 > 1000 THEN s + length(v) - strpos(reverse(v), '.') + 1 WHEN contains(v, chr(10)) AND length(v) - strpos(reverse(v), chr(10)) + 1 > 1000 THEN s + length(v) - strpos(reverse(v), chr(10)) + 1 ELSE s + 2000 END AS cut))
    SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(start AS INT) AS start, CAST(e AS INT) AS "end" FROM r""".replace("""w AS (
      SELECT doc_id, text, 0 AS chunk, 0 AS start, 0 AS e, true AS fresh FROM documents
      UNION ALL
      SELECT doc_id, text, CASE WHEN fresh THEN chunk ELSE chunk + 1 END, CASE WHEN fresh THEN 0 ELSE greatest(e - 200, start + 1) END, NULL, false FROM (SELECT 1) WHERE false)
    , """, ""),
)
add("d25_simple_keywords", lambda s, d: k.simple_keywords(docs(s, d)), f"WITH {D_OCC} SELECT * FROM simple")
_LOCATED = ["doc_id", "keyword", "start_position", "end_position", "line_number", "column_number", "page_number", "context_snippet"]
_D_AT = "strpos(text, keyword) - 1"
add(
    "c02_context_snippet", lambda s, d: k.located(k.simple_keywords(docs(s, d)), docs(s, d)).select(*_LOCATED),
    f"""WITH {D_OCC}, l AS (SELECT doc_id, keyword, text, {_D_AT} AS a, {_D_AT} + length(keyword) AS b, substr(text, 1, {_D_AT}) AS pre FROM simple JOIN documents USING (doc_id))
    SELECT doc_id, keyword, CAST(a AS INT) AS start_position, CAST(b AS INT) AS end_position, CAST(len(string_split(pre, chr(10))) AS INT) AS line_number, CAST(length(string_split(pre, chr(10))[-1]) + 1 AS INT) AS column_number, CAST(len(string_split(pre, chr(12))) AS INT) AS page_number,
    concat(CASE WHEN a > 50 THEN '...' ELSE '' END, substr(text, greatest(a - 50, 0) + 1, least(b + 50, length(text)) - greatest(a - 50, 0)), CASE WHEN b + 50 < length(text) THEN '...' ELSE '' END) AS context_snippet FROM l""",
)
#: No SQL: all overlapping places in whole texts are too slow there; tests hold it against brute force.
add("c01_find_positions", lambda s, d: p.word_positions(k.simple_keywords(docs(s, d)), docs(s, d)))
add(
    "c03_entity_context", lambda s, d: k.per_document(k.simple_keywords(docs(s, d)).select("doc_id", "keyword"), docs(s, d)).select("doc_id", F.explode(F.transform("found", lambda x: F.struct(x["keyword"], k.entity_context(F.col("text"), x["keyword"]).alias("context")))).alias("r")).select("doc_id", "r.*"),
    f"WITH {D_OCC}, l AS (SELECT doc_id, keyword, text, strpos(lower(text), lower(keyword)) AS a FROM simple JOIN documents USING (doc_id)) SELECT doc_id, keyword, CASE WHEN a > 0 THEN substr(text, greatest(a - 100, 1), length(keyword) + 200 + least(a - 101, 0)) ELSE '' END AS context FROM l",
)
D_LINES = "ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), lines AS (SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start FROM ln)"
add("c04_line_index", lambda s, d: p.line_index(docs(s, d)), f"WITH {D_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(line_start AS BIGINT) AS line_start, line FROM lines")
add(
    "c05_offset_to_line_col", lambda s, d: p.offset_to_line(docs(s, d).select("doc_id", (F.length("text") / 2).cast("int").alias("offset")), p.line_index(docs(s, d))),
    f"WITH {D_LINES}, o AS (SELECT doc_id, length(text) // 2 AS o FROM documents) SELECT doc_id, CAST(o AS INT) AS \"offset\", CAST(line_no AS INT) AS line_number, CAST(o - line_start + 1 AS BIGINT) AS column_number FROM o JOIN lines USING (doc_id) WHERE line_start <= o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) = 1",
)
add("c06_page_breaks", lambda s, d: p.page_breaks(docs(s, d)).select("doc_id", F.array_join(F.transform("breaks", lambda b: b.cast("string")), ",").alias("breaks")))
add("c07_offset_to_page", lambda s, d: p.page_breaks(docs(s, d)).join(docs(s, d).select("doc_id", F.length("text").alias("n")), "doc_id").select("doc_id", p.offset_to_page((F.col("n") / 2).cast("int"), F.col("breaks")).alias("page_number")))
_SENT = "list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10)"
_CUT = "CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END".format
add(
    "d20_rule_summary", lambda s, d: p.rule_summary(docs(s, d)),
    f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), m AS (SELECT doc_id, s, list_max(list_transform(s, lambda x: length(x))) AS m FROM s WHERE len(s) >= 3) SELECT doc_id, 'summary_intro' AS category, CAST(0.8 AS DOUBLE) AS score, {_CUT(x='s[1]', n=100)} AS keyword FROM m UNION ALL SELECT doc_id, 'summary_conclusion', 0.8, {_CUT(x='s[-1]', n=100)} FROM m UNION ALL SELECT doc_id, 'summary_core', 0.9, {_CUT(x='list_filter(s, lambda x: length(x) = m)[1]', n=120)} FROM m WHERE m > 50",
)
add(
    "d21_summary_topics", lambda s, d: p.summary_topics(docs(s, d)),
    f"WITH s AS (SELECT doc_id, array_to_string(string_split_regex(text, '[.!?]+')[1:10], ' ') AS t FROM documents), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM s)), c AS (SELECT doc_id, lower(w) AS keyword, count(*) AS n, min(i) AS f FROM w WHERE {d_meaningful('w')} GROUP BY ALL HAVING count(*) >= 2) SELECT doc_id, keyword, round(least(0.7, 0.4 + 0.1 * n), 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 3",
)
add(
    "d17_stat_labels", lambda s, d: p.stat_labels(docs(s, d)),
    "WITH n AS (SELECT doc_id, length(text) AS c, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w, len(string_split_regex(text, '[.!?]+')) AS s, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))) AS p FROM documents) "
    "SELECT doc_id, 'doc_length' AS category, CAST(0.7 AS DOUBLE) AS score, CASE WHEN c < 1000 THEN '매우짧음' WHEN c < 5000 THEN '짧음' WHEN c < 20000 THEN '보통' WHEN c < 50000 THEN '김' ELSE '매우김' END AS label FROM n UNION ALL "
    "SELECT doc_id, 'word_count', 0.6, CASE WHEN w < 100 THEN '소량' WHEN w < 500 THEN '적음' WHEN w < 2000 THEN '보통' WHEN w < 5000 THEN '많음' ELSE '대량' END FROM n UNION ALL "
    "SELECT doc_id, 'sentence_count', 0.5, CASE WHEN s < 10 THEN '단순' WHEN s < 50 THEN '보통' WHEN s < 200 THEN '복잡' ELSE '매우복잡' END FROM n UNION ALL "
    "SELECT doc_id, 'paragraph_count', 0.5, CASE WHEN p < 5 THEN '단순구조' WHEN p < 20 THEN '보통구조' ELSE '복잡구조' END FROM n UNION ALL "
    "SELECT doc_id, 'sentence_length', 0.4, CASE WHEN w / greatest(s, 1) < 8 THEN '짧은문장' WHEN w / greatest(s, 1) < 15 THEN '보통문장' WHEN w / greatest(s, 1) < 25 THEN '긴문장' ELSE '매우긴문장' END FROM n UNION ALL "
    "SELECT doc_id, 'complexity', 0.6, CASE WHEN c / greatest(w, 1) < 4 THEN '단순' WHEN c / greatest(w, 1) < 6 THEN '보통' WHEN c / greatest(w, 1) < 8 THEN '복잡' ELSE '매우복잡' END FROM n",
)
add(
    "d26_text_profile", lambda s, d: p.text_profile(docs(s, d)),
    f"WITH {D_OCC}, t3 AS (SELECT doc_id, string_agg(keyword || ':' || n, ',' ORDER BY rank) AS top FROM simple GROUP BY 1) SELECT d.doc_id, CAST(length(text) AS INT) AS chars, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS INT) AS latin, CAST(len(regexp_extract_all(text, '[가-힣]')) AS INT) AS hangul, coalesce(top, '') AS top FROM documents d LEFT JOIN t3 USING (doc_id)",
)
add(
    "u01_extract_occurrences", lambda s, d: k.extract_occurrences(docs(s, d), [*METHODS, "first_word"]),
    f"WITH {D_OCC}, al AS (SELECT *, NULL AS error FROM occ UNION ALL SELECT doc_id, CASE WHEN contains(text, '!!') THEN NULL ELSE regexp_extract(text, '[A-Za-z]+') END, 'first_word', CASE WHEN contains(text, '!!') THEN NULL ELSE 0.5 END, CASE WHEN contains(text, '!!') THEN NULL ELSE 'first' END, CASE WHEN contains(text, '!!') THEN 'ValueError: unreadable' END FROM documents WHERE contains(text, '!!') OR regexp_matches(text, '[A-Za-z]')), "
    "pl AS (SELECT al.*, text, CAST(nullif(strpos(text, keyword), 0) - 1 AS INT) AS p, CAST(nullif(strpos(text, keyword), 0) - 1 + length(keyword) AS INT) AS q FROM al JOIN documents USING (doc_id)) "
    "SELECT doc_id, keyword, extractor, CAST(score AS DOUBLE) AS score, category, p AS start_position, q AS end_position, CASE WHEN p > 50 THEN '...' ELSE '' END || substr(text, greatest(p - 50, 0) + 1, least(q + 50, length(text)) - greatest(p - 50, 0)) || CASE WHEN q + 50 < length(text) THEN '...' ELSE '' END AS context_snippet, "
    "CAST(length(substr(text, 1, p)) - length(replace(substr(text, 1, p), chr(12), '')) + 1 AS INT) AS page_number, CAST(length(substr(text, 1, p)) - length(replace(substr(text, 1, p), chr(10), '')) + 1 AS INT) AS line_number, CAST(p - coalesce(length(regexp_extract(substr(text, 1, p), '(?s)^.*\\n')), 0) + 1 AS INT) AS column_number, error FROM pl",
)
#: Hangul words, which the tables lack, added to whole texts.
_NOUNS = "concat(coalesce(text, ''), ' 데이터 분석 시스템 데이터 가가가 그리고 ', CASE doc_id % 3 WHEN 0 THEN '분석 분석 네트워크' WHEN 1 THEN '연구 플랫폼' ELSE '' END)"
add(
    "d11_noun_extract", lambda s, d: k.noun_extract(docs(s, d).select("doc_id", F.expr(_NOUNS).alias("text"))),
    f"WITH h AS (SELECT doc_id, regexp_extract_all({_NOUNS}, '[가-힣]{{2,}}') AS r FROM documents), w AS (SELECT doc_id, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM h), c AS (SELECT doc_id, w, count(*) AS n, min(i) AS first FROM w WHERE {d_meaningful('w')} GROUP BY ALL) "
    "SELECT doc_id, w AS keyword, 'nouns' AS extractor, CAST(round(n / max(n) OVER (PARTITION BY doc_id), 6) AS DOUBLE) AS score, 'noun' AS category FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) <= 10",
)
