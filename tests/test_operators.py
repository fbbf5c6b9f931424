"""The library's queries against DuckDB on the small tables, and rules on hand-made rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import analytics, graph, items, keywords, positions, records, structure
from corpusmill.plans import registry
from corpusmill.sources import files

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


CHOSEN = ["a05_html_extract", "b01_clean_text", "b04_extract_valid_words", "c02_context_snippet", "c06_page_breaks", "d01_multi_extract", "d06_mmr_select", "d15_overlap_chunks", "e01_section_detect", "f05_token_budget_merge", "g03_refresh_all_stats", "g12_top_keywords_per_project", "k02_domain_score", "k13_structure_depth", "q17_hub_entities"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert found
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        assert sorted(rel.columns) == columns
        expected = sorted(str([plain(v) for v in r]) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
        assert found == expected


NEWLY_WHOLE = ["a06_md_front_matter", "a07_md_to_text", "c03_entity_context", "d04_ngram_candidates", "d12_parse_llm_keywords", "e29_file_catalogue", "g06_file_keywords", "k15_near_pairs", "k20_shared_sentences", "k25_parse_llm_relations", "d16_heading_items", "e08_md_structure", "e20_scanned_flag", "e25_markdown_tables", "e26_table_lookup", "d27_parse_llm_summary", "k12_structure_keyword_join"]


@pytest.mark.parametrize("name", NEWLY_WHOLE)
def test_query_of_whole_texts(spark, duck, name):
    test_query(spark, duck, name)


def test_word_positions_overlap(spark):
    texts = {1: "aaaa bb AAA", 2: "none", 3: "bab", 4: "xaa", 5: None}
    words = [(d, w) for d in texts for w in ("aa", "bb", "aa b", "b")]
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = spark.createDataFrame(words, "doc_id bigint, keyword string")
    expected = set()
    for d, w in words:
        low = (texts[d] or "").lower()
        places = [i for i in range(len(low)) if low.startswith(w, i)]
        if places:
            expected.add((d, w, len(places), places[0], places[-1]))
    assert {tuple(r) for r in positions.word_positions(rows, docs).collect()} == expected


def test_tables_of_a_text(spark):
    text = "| a | b |\n|---|---|\n| x | 1 | extra |\n| y |\n\nplain | no\n| c |\n| z |\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    tables = items.markdown_tables(docs)
    assert sorted(tuple(r)[1:] for r in items.table_cells(tables).collect()) == [(1, 0, 0, "a", "x"), (1, 0, 1, "b", "1"), (1, 0, 2, None, "extra"), (1, 1, 0, "a", "y"), (2, 0, 0, "c", "z")]
    assert [tuple(r) for r in items.table_lookup(tables, "x", "b").collect()] == [(1, 1, "1")]


def test_structure_keywords_without_a_hit_go_to_the_first_section(spark):
    lines = spark.createDataFrame([(1, 1, "before"), (1, 2, "# One"), (1, 3, "Alpha here"), (1, 4, "# Two"), (1, 5, "alpha and beta")], "doc_id bigint, line_no int, line string")
    sections = spark.createDataFrame([(1, 2), (1, 4)], "doc_id bigint, line_no int")
    words = spark.createDataFrame([(1, "simple", w) for w in ("Alpha", "beta", "before")] + [(2, "simple", "x")], "doc_id bigint, extractor string, keyword string")
    found = {tuple(r) for r in items.structure_keywords(lines, sections, words).select("doc_id", "line_no", "word").collect()}
    assert found == {(1, 2, "alpha"), (1, 4, "alpha"), (1, 4, "beta"), (1, 2, "before")}


def test_summary_replies(spark):
    rows = [(1, '{"intro": "a", "topics": ["1", "2", "3", "4", "5", "6"]}'), (2, "no object"), (3, None), (4, '```json\n{"core": "c", "tone": null}\n```')]
    found = {(r["doc_id"], r["category"], r["keyword"], r["score"]) for r in items.parse_summaries(spark.createDataFrame(rows, "doc_id bigint, reply string")).collect()}
    assert found == {(1, "summary_intro", "a", 0.9), (4, "summary_core", "c", 1.0)} | {(1, "summary_topic", str(i), 0.8) for i in range(1, 6)}


def test_scanned_flag(spark):
    docs = spark.createDataFrame([(1, "few words " + items.IMAGE_TAG * 10), (2, "few words " + items.IMAGE_TAG * 9), (3, "word " * 100 + items.IMAGE_TAG * 200), (4, "")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["is_scanned"] for r in items.scanned_flag(docs).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_near_pairs_take_any_two_hits(spark):
    docs = spark.createDataFrame([(1, "Alpha. " + "x" * 200 + " beta then alpha", ), (2, "alpha. beta"), (3, "alpha " + "y" * 120 + " beta"), (4, None)], "doc_id bigint, text string")
    rows = spark.createDataFrame([(d, i, w) for d in (1, 2, 3, 4) for i, w in enumerate(("alpha", "beta"))], "doc_id bigint, rank int, keyword string")
    assert [tuple(r) for r in records.near_pairs(rows, docs).collect()] == [(1, "alpha", "beta", 10)]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("word, stem", [("데이터베이스의", "데이터베이스"), ("시스템에서는", "시스템"), ("기술을", "기술"), ("연구", "연구"), ("서울까지", "서울"), ("plain", "plain")])
def test_strip_particle(spark, word, stem):
    assert one(spark, t.strip_particle, word) == stem


@pytest.mark.parametrize("word, ok", [("연구", True), ("aaaa", False), ("12345", False), ("<b>", False), ("the", False), ("AI기술", True), ("x", False)])
def test_meaningful(spark, word, ok):
    assert one(spark, t.is_meaningful, word) is ok


def test_clean_text(spark):
    assert one(spark, t.clean_text, "a\u0000​b\t c\n\ndé") == "ab c dé"


def test_hangul_entities(spark, make_docs):
    found = {(r.keyword, r.category) for r in keywords.pattern_entities(make_docs([(1, "2024년 매출은 5억원이며 삼성전자는 서울특별시에 있다")])).collect()}
    assert {("2024년", "DATE"), ("5억원", "MONEY"), ("삼성전자", "ORG"), ("서울특별시", "LOC")} <= found


def test_positions_overlap(spark):
    row = spark.createDataFrame([("aaaa", "aa")], "t string, k string").select(keywords.find_positions(F.col("t"), F.col("k"))).first()
    assert row[0] == [0, 1, 2]


def test_sections(spark, make_docs):
    text = "1. Intro\nbody text that is long enough to be no heading at all, truly.\n## Part\nTitle here\n\nLONG TITLE\n"
    rows = {r.line_no: (r.style, r.level, r.title) for r in structure.sections(make_docs([(1, text)])).collect()}
    assert rows[1] == ("numbered", 1, "Intro") and rows[3] == ("markdown", 2, "Part") and rows[6][0] == "uppercase"


def test_page_breaks(spark, make_docs):
    found = dict(positions.page_breaks(make_docs([(1, "a\fb\fc"), (2, "short"), (3, ("x" * 40 + "\n") * 200 + "\n\n")])).collect())
    assert found[1] == [1, 3] and found[2] == [] and isinstance(found[3], list)


def test_markdown(spark):
    assert one(spark, files.md_to_text, "# T\n**b** [l](u) ![i](v)\n> q\n```\ncode\n```") == "T\nb l !i\nq"


def test_domain_golden(spark, make_docs):
    scores = {r.domain: r.score for r in graph.domain_scores(make_docs([(1, "import a function; the JSON API of the server")])).collect()}
    assert scores["technical"] == pytest.approx(2 / 15 * 0.6 + 0.4, abs=1e-6)


def test_walks_of_many_sections(spark):
    """Chains of four with a second leaf at the root, from the levels of headings."""
    rows = [(d, n, level) for d in range(60) for n, level in ((1, 1), (3, 2), (4, 3), (7, 4), (9, 2))]
    parents = structure.section_parents(spark.createDataFrame(rows, "doc_id bigint, line_no int, level int"))
    found = {(r.doc_id, r.line_no): r.depth for r in graph.depths(parents).collect()}
    assert found == {(d, n): k for d in range(60) for n, k in ((1, 0), (3, 1), (4, 2), (7, 3), (9, 1))}
    assert sorted(r.path for r in records.leaf_paths(parents).collect()) == ["1>3>4>7"] * 60 + ["1>9"] * 60
    assert graph.depths(parents.limit(0)).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x", 0.5, None), (1, "b", "y", 0.5, None)], "doc_id bigint, keyword string, extractor string, score double, category string")
    new = spark.createDataFrame([(1, "c", "x", 0.9, None)], old.schema)
    assert {r.keyword for r in analytics.upsert(old, new).collect()} == {"b", "c"}


def test_unknown_extractor(make_docs):
    with pytest.raises(ValueError):
        keywords.multi_extract(make_docs([(1, "x")]), ["nothing"])
