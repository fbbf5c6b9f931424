"""Queries over whole texts: scans, cleaning, scalar rules, statistics and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.sources import files

ALL: dict = {}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


def scalar(name: str, column, sql: str, out: str = "value", table=docs, key: str = "doc_id", source: str = "documents") -> None:
    """A query of one computed column over a whole table."""
    add(name, lambda s, d: table(s, d).select(key, column(F.col("text") if source == "documents" else F.col("html")).alias(out)), f"SELECT {key}, {sql} AS {out} FROM {source}")


# DuckDB forms of the shared rules
D_WHITE = t.WHITE
D_CLEAN = f"trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[{t.REMOVED}]', '', 'g'), '{D_WHITE}', ' ', 'g'))"
D_STOPS = ", ".join(f"'{w}'" for w in t.STOP_WORDS)


def d_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def d_meaningful(k: str) -> str:
    share = lambda p: f"{d_count(k, p)} / greatest(length({k}), 1)"
    return (
        f"(length({k}) BETWEEN 2 AND 50 AND regexp_matches({k}, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches({k}, '^\\p{{Nd}}+$') "
        f"AND NOT (length({k}) > 2 AND replace({k}, {k}[1], '') = '') AND {share(t.SUSPICIOUS)} <= 0.25 AND {share(t.NORMAL)} >= 0.5 "
        f"AND lower({k}) NOT IN ({D_STOPS}) AND NOT regexp_matches({k}, '^<[^>]+>$'))"
    )


D_RUNS = "list_concat(list_concat(regexp_extract_all({x}, '[가-힣]{{2,}}'), regexp_extract_all({x}, '[A-Za-z]{{3,}}')), regexp_extract_all({x}, '[A-Za-z가-힣][A-Za-z가-힣0-9]{{1,}}'))"
D_WORDS = f"list_filter(string_split_regex({{x}}, '{D_WHITE}'), lambda w: w <> '')"


def d_words(x: str) -> str:
    return D_WORDS.replace("{x}", x)


#: An explode of different words with their first place: array functions that keep order differ between engines.
D_VALID = """
WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {runs} AS ws FROM {source})),
f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY doc_id, w), v AS (SELECT * FROM f WHERE {ok})
"""

add("a01_corpus_scan", lambda s, d: files.corpus_rows(docs(s, d)), "SELECT concat(source, '/', doc_id, '.txt') AS path, text, CAST(strlen(text) AS BIGINT) AS size FROM documents")
add(
    "a02_format_route",
    lambda s, d: pages(s, d).select("page_id", F.array_join(files.candidate_formats(F.col("url"), F.col("html")), ",").alias("formats")),
    "SELECT page_id, CASE WHEN regexp_matches(lower(substr(html, 1, 1024)), '<html|<!doctype html') THEN 'html,txt' ELSE 'txt' END AS formats FROM pages",
)
add(
    "a03_utf8_gate",
    lambda s, d: docs(s, d).select("doc_id", F.expr("is_valid_utf8(text)").alias("is_valid"), F.octet_length(F.expr("make_valid_utf8(text)")).cast("bigint").alias("bytes")),
    "SELECT doc_id, true AS is_valid, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
)
_EXT = ["txt", "exe", "md", "bin", "pdf"]
add(
    "a04_upload_filter",
    lambda s, d: files.allowed_files(docs(s, d).select("doc_id", F.concat(F.col("doc_id"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 5 + 1).cast("int"))).alias("filename"))),
    "SELECT doc_id, concat(doc_id, '.', ['txt', 'exe', 'md', 'bin', 'pdf'][doc_id % 5 + 1]) AS filename FROM documents WHERE doc_id % 5 IN (0, 2, 4)",
)
add("a05_html_extract", lambda s, d: files.html_extract(pages(s, d)).select("page_id", "title", "author", F.length("text").cast("bigint").alias("n_chars"), "word_count"))
_FRONT = "concat('---\\ntitle: \"Doc ', doc_id, '\"\\nsource: ', source, '\\n# note\\nempty:\\n---\\n', {text})"
add(
    "a06_md_front_matter",
    lambda s, d: files.front_matter(docs(s, d).select("doc_id", F.expr(_FRONT.format(text="text")).alias("text"))).select("doc_id", F.element_at("meta", "title").alias("title"), F.element_at("meta", "source").alias("source"), F.size("meta").alias("n"), "body"),
    "SELECT doc_id, concat('Doc ', doc_id) AS title, source, CAST(2 AS INT) AS n, text AS body FROM documents",
)
_MD = "concat('# ', source, '\\n', '- **bold** [label](http://x.y)\\n> quote `code`\\n', {text})"
_D_PLAIN = "concat('# ', source, chr(10), '- **bold** [label](http://x.y)', chr(10), '> quote `code`', chr(10), text)"
for _rule, _to, _how in (
    ("```.*?```", "", "gs"), ("`[^`]*`", "", "g"), ("<[^>]+>", "", "g"), ("(?m)^#{1,6}\\s+", "", "g"), ("\\*\\*([^*]+)\\*\\*", "\\1", "g"), ("\\*([^*]+)\\*", "\\1", "g"),
    ("\\[([^\\]]*)\\]\\([^)]*\\)", "\\1", "g"), ("!\\[([^\\]]*)\\]\\([^)]*\\)", "", "g"), ("(?m)^\\s*[-*+]\\s+", "", "g"), ("(?m)^\\s*\\d+\\.\\s+", "", "g"), ("(?m)^>\\s*", "", "g"),
    ("(?m)^[-*_]{3,}$", "", "g"), ("\\n{3,}", "\n\n", "g"), ("^\\s+|\\s+$", "", "g"),
):
    _D_PLAIN = f"regexp_replace({_D_PLAIN}, '{_rule}', '{_to}', '{_how}')"
_D_PLAIN = f"SELECT doc_id, {_D_PLAIN} AS plain FROM documents"
add(
    "a07_md_to_text",
    lambda s, d: docs(s, d).select("doc_id", files.md_to_text(F.expr(_MD.format(text="text"))).alias("plain")),
    _D_PLAIN,
)
add(
    "a08_text_to_markdown",
    lambda s, d: docs(s, d).select("doc_id", files.text_to_markdown(F.expr("concat(doc_id % 9 + 1, '.2 Title\\n', coalesce(text, ''))")).alias("md")),
    "SELECT doc_id, concat('## ', doc_id % 9 + 1, '.2 Title', chr(10), array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(trim(x), '^\\d+(\\.\\d+)*\\.?\\s') THEN concat('# ', trim(x)) WHEN contains(x, '|') OR regexp_matches(x, '^\\s*[-*] ') THEN x ELSE trim(x) END), chr(10))) AS md FROM documents",
)
scalar("b01_clean_text", t.clean_text, D_CLEAN)
scalar("b02_is_valid_unicode", t.has_letter_or_number, "regexp_matches(text, '[\\p{L}\\p{N}]')")
add(
    "b03_is_meaningful_keyword",
    lambda s, d: docs(s, d).select(F.explode(F.array_distinct(t.words(F.col("text")))).alias("word")).distinct().select("word", t.is_meaningful(F.col("word")).alias("ok")),
    f"WITH w AS (SELECT DISTINCT unnest({d_words('text')}) AS word FROM documents) SELECT word, {d_meaningful('word')} AS ok FROM w",
)
add(
    "b04_extract_valid_words",
    lambda s, d: docs(s, d).select("doc_id", F.array_join(t.valid_words(F.col("text")), " ").alias("words")),
    D_VALID.format(runs=D_RUNS.format(x="text"), source="documents", ok=d_meaningful("w")) + "SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id",
)
add(
    "b05_filter_keywords",
    lambda s, d: docs(s, d).select("doc_id", F.array_join(t.filter_keywords(t.words(F.col("text")), 20), " ").alias("words")),
    D_VALID.format(runs=d_words("text"), source="documents", ok=d_meaningful("w")) + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM v) SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM documents d LEFT JOIN (SELECT * FROM r WHERE r <= 20) v USING (doc_id) GROUP BY d.doc_id",
)
_KO = "concat(['데이터', '시스템', '연구', 'AI기술'][doc_id % 4 + 1], ['의', '에서는', '을', '까지', '이다', ''][doc_id % 6 + 1])"
_KO_SPARK = "concat(array('데이터', '시스템', '연구', 'AI기술')[int(doc_id % 4)], array('의', '에서는', '을', '까지', '이다', '')[int(doc_id % 6)])"
_KO_STEM = "['데이터', '시스템', '연구', 'AI기술'][doc_id % 4 + 1]"
add(
    "b08_strip_particle_longest", lambda s, d: docs(s, d).select("doc_id", t.strip_particle_longest(F.expr("concat(array('데이터', '시스템', '연구', 'AI기술')[int(doc_id % 4)], array('이랑', '조차', '밖에', '보다', '처럼', '이여', '에서는', '')[int(doc_id % 8)])")).alias("value")),
    "SELECT doc_id, ['데이터', '시스템', '연구', 'AI기술'][doc_id % 4 + 1] || ['', '', '', '보다', '처럼', '', '에서', ''][doc_id % 8 + 1] AS value FROM documents",
)
for _name, _f in (("b06_normalize_keyword", t.normalize_keyword), ("b07_strip_particle", t.strip_particle)):
    add(_name, lambda s, d, f=_f: docs(s, d).select("doc_id", f(F.expr(_KO_SPARK)).alias("value")), f"SELECT doc_id, {_KO_STEM} AS value FROM documents")
add(
    "b09_keyword_to_words",
    lambda s, d: docs(s, d).select("doc_id", F.array_join(t.keyword_to_words(F.expr(f"concat({_KO_SPARK}, ' ', source, ' the ', lang)")), ",").alias("value")),
    f"SELECT doc_id, concat_ws(',', {_KO_STEM} || ['', '에서', '', '', '이다', ''][doc_id % 6 + 1], source, lang) AS value FROM documents",
)
scalar("b10_squeeze_text", t.squeeze, f"trim(regexp_replace(text, '{D_WHITE}', ' ', 'g'))")
add(
    "b11_drop_empty_values",
    lambda s, d: docs(s, d).select("doc_id", F.to_json(F.struct(F.expr("nullif(if(doc_id % 3 = 0, 'unknown', lang), 'unknown')").alias("lang"), F.expr("nullif(trim(if(doc_id % 2 = 0, ' ', source)), '')").alias("source"))).alias("value")),
    "SELECT doc_id, concat('{', concat_ws(',', CASE WHEN doc_id % 3 <> 0 THEN concat('\"lang\":\"', lang, '\"') END, CASE WHEN doc_id % 2 <> 0 THEN concat('\"source\":\"', source, '\"') END), '}') AS value FROM documents",
)
scalar("b12_detect_language", t.detect_language, f"CASE WHEN {d_count('substr(text, 1, 1000)', '[가-힣]')} / greatest(length(substr(text, 1, 1000)), 1) > 0.1 THEN 'ko' WHEN {d_count('substr(text, 1, 1000)', '[A-Za-z]')} / greatest(length(substr(text, 1, 1000)), 1) > 0.5 THEN 'en' ELSE 'unknown' END")
D_SENTENCES = f"len(list_filter(string_split_regex(text, '[.!?。！？]+\\s'), lambda s: trim(regexp_replace(s, '{D_WHITE}', ' ', 'g')) <> ''))"
scalar("e04_count_sentences", t.count_sentences, f"CAST({D_SENTENCES} AS INT)")
add(
    "e05_text_statistics",
    lambda s, d: docs(s, d).select(
        "doc_id", F.length("text").alias("chars"), F.size(t.words(F.col("text"))).alias("words"), F.size(F.split("text", "\n", -1)).alias("lines"),
        F.size(F.filter(F.split("text", "\n\n", -1), lambda p: F.trim(p) != "")).alias("paragraphs"), t.count_sentences(F.col("text")).alias("sentences"),
        F.round(F.size(t.words(F.col("text"))) / F.greatest(t.count_sentences(F.col("text")), F.lit(1)), 6).alias("words_per_sentence"),
    ),
    f"SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(len({d_words('text')}) AS INT) AS words, CAST(len(string_split(text, chr(10))) AS INT) AS lines, CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '')) AS INT) AS paragraphs, CAST({D_SENTENCES} AS INT) AS sentences, round(len({d_words('text')}) / greatest({D_SENTENCES}, 1), 6) AS words_per_sentence FROM documents",
)
add(
    "e06_reflow_single_line",
    lambda s, d: docs(s, d).select("doc_id", files.reflow(F.regexp_replace("text", "\n", " ")).alias("value")),
    "WITH x AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 1000 THEN array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) ELSE t END AS value FROM x",
)
add(
    "e12_structure_info",
    lambda s, d: docs(s, d).select("doc_id", F.size(F.split("text", "\n", -1)).alias("total"), F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).alias("non_empty"), F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x).startswith("#"))).alias("headers")),
    "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS total, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INT) AS non_empty, CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '#'))) AS INT) AS headers FROM documents",
)
D_QUALITY = f"CASE WHEN length(text) = 0 THEN 0.0 ELSE least(length(text) / 1000, 1.0) * 0.3 + CASE WHEN len({d_words('text')}) > 0 THEN len(list_distinct({d_words('text')})) / len({d_words('text')}) * 0.3 ELSE 0 END + least({d_count('text', '[.!?,:;]')} / length(text) * 100, 1.0) * 0.2 + {d_count('text', '[\\p{L}\\p{N}\\s]')} / length(text) * 0.2 END"
scalar("e13_text_quality", lambda x: F.round(t.text_quality(x), 6), f"round({D_QUALITY}, 6)")
_N, _B = r"[\x{20}-\x{7F}\x{A0}-\x{FF}\x{AC00}-\x{D7AF}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}]", r"[\x{0590}-\x{06FF}\x{0900}-\x{0DFF}\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFF}]"
scalar(
    "e14_charset_quality", lambda x: F.round(t.charset_quality(x), 6),
    f"round(CASE WHEN length(trim(text)) = 0 THEN 0.0 ELSE {d_count('trim(text)', _N)} / length(trim(text)) * 0.4 + (1 - {d_count('trim(text)', _B)} / length(trim(text))) * 0.3 + least(0.3, 1 - {d_count('trim(text)', '\\s')} / length(trim(text))) * 0.2 + len(list_filter({d_words('trim(text)')}, lambda w: length(w) >= 2 AND regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) / greatest(len({d_words('trim(text)')}), 1) * 0.1 END, 6)",
)
scalar("e18_cid_ratio", lambda x: (F.length(x) >= 10) & (F.regexp_count(x, F.lit(r"/_\d+")) / F.greatest(F.size(t.words(x)), F.lit(1)) > 0.05), f"length(text) >= 10 AND {d_count('text', '/_\\d+')} / greatest(len({d_words('text')}), 1) > 0.05")
scalar("e28_content_identifier", lambda x: F.sha2(x, 256), "sha256(text)")
scalar("k01_graph_ids", lambda x: F.substring(F.sha1(x), 1, 16), "substr(sha1(text), 1, 16)")
add(
    "e15_best_candidate",
    lambda s, d: files.best_candidate(docs(s, d)),
    f"WITH c AS (SELECT doc_id, 0 AS o, 'raw' AS name, text FROM documents UNION ALL SELECT doc_id, 1, 'squeezed', trim(regexp_replace(text, '{D_WHITE}', ' ', 'g')) FROM documents UNION ALL SELECT doc_id, 2, 'letters', regexp_replace(text, '[^A-Za-z\\s]', '', 'g') FROM documents), q AS (SELECT *, round({D_QUALITY}, 9) AS q FROM c) SELECT doc_id, name AS best, round(q, 6) AS quality FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY q DESC, o) = 1",
)
add(
    "e10_html_structure",
    lambda s, d: pages(s, d).select("page_id", *[F.regexp_count("html", F.lit(f"(?i)<{tag}[\\s>]")).alias(n) for n, tag in (("headings", "h[1-6]"), ("images", "img"), ("tables", "table"), ("lists", "[uo]l"), ("paragraphs", "p"))]),
    "SELECT page_id, " + ", ".join(f"CAST({d_count('html', f'(?i)<{tag}[\\s>]')} AS INT) AS {n}" for n, tag in (("headings", "h[1-6]"), ("images", "img"), ("tables", "table"), ("lists", "[uo]l"), ("paragraphs", "p"))) + " FROM pages",
)
_LINK = '(?i)<a\\s+href="([^"]*)"[^>]*>([^<]*)</a>'
add(
    "e11_html_links",
    lambda s, d: files.html_links(pages(s, d)).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n")),
    f"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS url FROM pages) SELECT page_id, CASE WHEN starts_with(url, 'mailto:') THEN 'mailto' WHEN regexp_matches(url, '^https?://') THEN 'external' ELSE 'internal' END AS kind, count(*) AS n FROM l GROUP BY ALL",
)
#: References of each kind, which few texts have, added to whole texts.
_REFS = " 2024년 3월 5일, 2024-03-05 3/5/2024 5.3.2024 https://host.example/a|b?x=1 me@mail.example 2025-01-01"
add(
    "d18_content_refs",
    lambda s, d: files.content_refs(docs(s, d).withColumn("text", F.concat("text", F.lit(_REFS)))),
    " UNION ALL ".join(
        f"(WITH m AS (SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS ps FROM (SELECT doc_id, text || '{_REFS}' AS text FROM documents)), "
        "r AS (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS place FROM m WHERE len(ms) > 0) "
        f"SELECT doc_id, '{c}' AS category, CAST({v} AS DOUBLE) AS score, {keyword} AS keyword, CAST(place AS INT) AS start_position, CAST(place + length(m) AS INT) AS end_position FROM r)"
        for c, v, p, keyword in (
            ("url_reference", 0.5, """'https?://[^\\s<>"{}|\\\\^`\\[\\]]+'""", "split_part(m, '/', 3)"), ("email_reference", 0.6, "'\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b'", "split_part(m, '@', 2)"),
            ("date_korean", 0.7, "'\\d{4}년\\s*\\d{1,2}월\\s*\\d{1,2}일'", "m"), ("date_iso", 0.7, "'\\d{4}-\\d{2}-\\d{2}'", "m"), ("date_us", 0.7, "'\\d{1,2}/\\d{1,2}/\\d{4}'", "m"), ("date_eu", 0.7, "'\\d{1,2}\\.\\d{1,2}\\.\\d{4}'", "m"),
        )
    ),
)
add(
    "d19_numeric_profile",
    lambda s, d: files.numeric_profile(docs(s, d)),
    "WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\d+(?:,\\d{3})*(?:\\.\\d+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS v FROM documents), m AS (SELECT doc_id, list_avg(v) AS m FROM n WHERE len(v) > 0) SELECT doc_id, round(m, 0) AS mean, CASE WHEN m < 10 THEN '소수' WHEN m < 100 THEN '중간수' WHEN m < 1000 THEN '큰수' ELSE '대형수' END AS label FROM m",
)
