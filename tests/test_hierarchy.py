"""Structure graph, relations and chunks on hand-made documents."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import arrays
from corpusmill.operators import chunks, hierarchy, relations
from corpusmill.plans import registry

import test_operators
from test_operators import duck  # noqa: F401

STRUCTURE = ["k10_section_parent", "k11_structures", "k11_structure_nodes", "k11_structure_edges", "k12_structure_entities", "k12_structure_entity_edges", "q10_entity_density_by_section", "q11_same_container_pairs", "q12_depth_distribution", "q13_domain_type_patterns", "q14_leaf_paths", "k06_entity_props", "k07_relation_by_context", "k16_closest_context", "k17_relation_rule", "k18_relation_confidence", "k19_known_stack_pairs", "k_entity_relations"]
CHUNKS = ["f01_heading_class", "f02_tree_nodes", "f03_chunk_level", "f04_chunk_build", "f06_boundary_check", "f07_chunk_text", "f13_merged_nodes", "f13_merged_edges", "e02_element_counts", "e21_document_type", "e22_image_filter", "e22_image_filter_once", "e24_ocr_rows_to_table", "k21_outline_sections", "k21_outline_edges", "k21_outline_keywords", "u01_extract_occurrences", "d07_pattern_entities", "d11_noun_extract", "e16_richness_score"]


@pytest.mark.parametrize("name", STRUCTURE + CHUNKS)
def test_queries(spark, duck, name):  # noqa: F811
    assert name in registry.ORACLES
    test_operators.test_query(spark, duck, name)


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_scan_is_a_running_fold(spark):
    rows = spark.createDataFrame([([],), (list(range(1000)),), (None,)], "x array<int>")
    found = [r.s for r in rows.select(arrays.starts(F.col("x")).alias("s")).collect()]
    assert found == [[], [0, *itertools.accumulate(range(999))], None]


TEXT = "before\n# One\n- a\n* b\n\ntext of one\nmore\n## Two\n| x | y |\n| 1 | 2 |\n![pic](p.png)\n# Three\nend"


def test_structures(spark):
    rows = hierarchy.structures(docs_of(spark, TEXT, None, "", "only words.\n\n# "))
    found = {(r.doc_id, r.node): (r.type, r.title, r.first_line, r.last_line, r.parent, list(r.path), r.content) for r in rows.collect()}
    assert found[0, 0] == ("Paragraph", None, 1, 1, None, [], "before")
    assert found[0, 1] == ("Section", "One", 2, 11, None, [], "# One")
    assert found[0, 2] == ("List", None, 3, 4, 1, [1], "- a\n* b")
    assert found[0, 3] == ("Paragraph", None, 6, 7, 1, [1], "text of one\nmore")
    assert found[0, 4] == ("Section", "Two", 8, 11, 1, [1], "## Two")
    assert found[0, 5] == ("Table", None, 9, 10, 4, [1, 4], "| x | y |\n| 1 | 2 |")
    assert found[0, 6] == ("Image", None, 11, 11, 4, [1, 4], "![pic](p.png)")
    assert found[0, 7] == ("Section", "Three", 12, 13, None, [], "# Three")
    assert found[1, 0] == found[2, 0] == ("Section", "Default Section", 1, 1, None, [], "")
    assert found[3, 0] == ("Section", "Default Section", 1, 3, None, [], "") and found[3, 1][4:] == (0, [0], "only words.")
    for r in rows.filter("doc_id = 0").collect():
        assert TEXT[r.start : r.end].startswith(r.content) and (r.type == "Section" or TEXT[r.start : r.end] == r.content)


def test_deep_and_many_sections(spark):
    deep = "\n".join(".".join(["1"] * (i + 1)) + " title" for i in range(30))
    flat = "\n".join(f"# t{i}" for i in range(3000))
    rows = hierarchy.structures(docs_of(spark, deep, flat)).select("doc_id", "node", "parent", "last_line").collect()
    assert sorted((r.node, r.parent, r.last_line) for r in rows if r.doc_id == 0) == [(i, i - 1 if i else None, 30) for i in range(30)]
    assert sorted((r.node, r.parent, r.last_line) for r in rows if r.doc_id == 1) == [(i, None, i + 1) for i in range(3000)]


STACK = "# Stack\nFastAPI talks to PostgreSQL, with Redis behind\n\nThe server uses SQLAlchemy in this software. An API function of JSON. Docker. A RESTful way and JWT tokens."
GIVEN = [("FastAPI", 0.95), ("PostgreSQL", 0.92), ("SQLAlchemy", 0.88), ("Redis", 0.85), ("Docker", 0.82), ("RESTful", 0.90), ("JWT", 0.87), ("x", 1.0), ("Missing", 0.7)]


def keywords_of(spark):
    return spark.createDataFrame([(0, w, "llm", s, None) for w, s in GIVEN], "doc_id bigint, keyword string, extractor string, score double, category string")


def test_relations_have_the_known_values(spark):
    docs = docs_of(spark, STACK)
    entities = hierarchy.structure_entities(docs, keywords_of(spark))
    rows = {r.word: r for r in entities.collect()}
    assert {w: r.entity_type for w, r in rows.items()} == {"fastapi": "Framework", "postgresql": "Database", "redis": "Database", "docker": "Tool", "sqlalchemy": "Technology", "restful": "Technology", "jwt": "Technology", "missing": "Technology"}
    assert rows["missing"].node == 0 and rows["jwt"].type == "Paragraph"
    name = {r.id: r.word for r in rows.values()}
    near = {(name[r.source], name[r.target]): (r.relationship_name, r.confidence) for r in relations.entity_relations(entities, docs).collect()}
    assert near[("fastapi", "postgresql")] == ("CONNECTS_TO", 0.836) and near[("fastapi", "redis")] == ("CONNECTS_TO", 0.78)
    assert ("postgresql", "redis") not in near
    assert {(name[r.source], name[r.target], r.relationship_name, r.confidence) for r in relations.known_stacks(entities).collect()} == {("fastapi", "sqlalchemy", "INTEGRATES_WITH", 0.8), ("postgresql", "redis", "COMPLEMENTS", 0.8)}
    edges = hierarchy.entity_edges(entities)
    assert edges.count() == 8 and {r.relationship_name for r in edges.collect()} == {"ASSOCIATED_WITH", "USES"}


def test_near_contexts_against_all_pairs_of_hits(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "ba", "aba", " ", ". ", "\n", "|", "x" * 40]) for _ in range(120)) for _ in range(30)] + ["", None, "ab", "AB ba"]
    words = ["ab", "ba", "aba", "bab", "zz"]
    rows = spark.createDataFrame([(i, w, 1 - k / 10) for i in range(len(texts)) for k, w in enumerate(words)], "doc_id bigint, word string, score double")
    found = {(r.doc_id, r.source, r.target): (r.gap, r.context) for r in relations.near_contexts(rows, docs_of(spark, *texts)).collect()}
    expected = {}
    for i, text in enumerate(texts):
        low = (text or "").lower()
        places = {w: [p for p in range(len(low)) if low.startswith(w, p)] for w in words}
        for a, b in itertools.combinations(words, 2):
            pairs = [(abs(p - q), p, q) for p in places[a] for q in places[b]]
            if any(g <= 100 and not any(s in low[min(p, q) : max(p, q)] for s in ("\n\n", ". ", ".\n", "|", "- **", "### ", "## ")) for g, p, q in pairs):
                g, p, q = min(pairs)
                context = text[max(0, min(p, q) - 100) : max(p + len(a), q + len(b)) + 100].strip()
                expected[i, a, b] = (g, context[:200] + "..." if len(context) > 200 else context)
    assert found == expected and len(found) > 50


def test_headings(spark):
    cases = {
        "1. Start": ("chapter", "1", "Start"), "제 2 장: 서론": ("chapter", "2", "서론"), "Chapter 3: Go": ("chapter", "3", "Go"), "CHAPTER IV. Go": ("chapter", "IV", "Go"), "# 5 Go": ("chapter", "5", "Go"), " 06 ": ("chapter", "06", "Chapter 06"),
        "1.2 Go": ("section", "1.2", "Go"), "1-2. Go": ("section", "1.2", "Go"), "제 3 절 Go": ("section", "3", "Go"), "## 1.2 Go": ("section", "1.2", "Go"), "## 01 Go": ("section", "01", "Go"), "## Go on": ("section", "auto", "Go on"),
        "1.2.3 Go": ("subsection", "1.2.3", "Go"), "1-2-3 Go": ("subsection", "1.2.3", "Go"), "(4) Go": ("subsection", "4", "Go"), "가. Go": ("subsection", "가", "Go"), "### Go": ("subsection", "auto", "Go"), "Go": None, "": None, "# Go": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "line string").select("line", chunks.heading_class(F.col("line")).alias("c")).collect()
    assert {r.line: tuple(r.c) if r.c else None for r in rows} == cases


def test_tree_and_chunks(spark):
    text = "top\n### lost\n## A\na1\n### A1\na2\n## B\n1. C\nc\n2.1 D\nd\n### D1\n## E"
    found = [(r.node_id, r.number, r.title, r.parent, r.content) for r in chunks.tree_nodes(docs_of(spark, text, None)).orderBy("doc_id", "node").collect()]
    assert found == [
        ("document_root", "0", "Document Root", None, "top\n"), ("chapter_auto", "1", "Document Sections", 0, ""), ("section_1", "1", "A", 1, "a1\na2\n"), ("subsection_1", "1", "A1", 2, ""), ("section_2", "2", "B", 1, ""), ("chapter_1", "1", "C", 0, "c\n"),
        ("section_2.1", "2.1", "D", 5, "d\n"), ("subsection_1", "1", "D1", 6, ""), ("section_3", "3", "E", 5, ""), ("document_root", "0", "Document Root", None, ""),
    ]
    whole = chunks.build_chunks(docs_of(spark, text, None)).orderBy("doc_id").collect()
    assert [(r.chunk_id, list(r.nodes)) for r in whole] == [("document_full", [0]), ("document_full", [0])] and whole[0].text.startswith("top\n\n\n# Document Sections\n\n## A\n\na1\na2\n\n\n### A1\n\n## B")
    long = "\n".join(["## S"] + [f"## S{i}\n" + "x" * 1500 for i in range(8)])
    parts = chunks.build_chunks(docs_of(spark, long), 800).orderBy("chunk").collect()
    assert [(r.chunk_id, list(r.nodes), r.boundary_rule) for r in parts] == [("merged_1_to_3", [2, 3, 4], "token_based_merge"), ("merged_4_to_5", [5, 6], "token_based_merge"), ("merged_6_to_7", [7, 8], "token_based_merge"), ("merged_8_to_9", [9, 10], "token_based_merge")]


def test_merged_graphs_keep_the_last_value_and_the_first_edge(spark):
    nodes = spark.createDataFrame([(1, "a", "X", {"p": "1", "q": "1"}), (2, "a", "Y", {"p": "2"}), (2, "b", "Y", {}), (3, "b", "Z", None)], "graph int, id string, type string, props map<string,string>")
    edges = spark.createDataFrame([(2, "a", "b", "T"), (1, "a", "b", "T"), (1, "b", "a", "T")], "graph int, source string, target string, type string")
    merged, once = chunks.merge_graphs(nodes, edges)
    assert sorted((r.id, r.type, r.props, r.graphs) for r in merged.collect()) == [("a", "X", {"p": "2", "q": "1"}, 2), ("b", "Y", {}, 2)]
    assert sorted(tuple(r) for r in once.collect()) == [("a", "b", "T", 1), ("b", "a", "T", 1)]


def test_tables_by_numerals_of_any_kind(spark):
    from corpusmill.operators import structure

    rows = structure.element_counts(docs_of(spark, "see 표 三, it is long enough to be no heading at all, as it ends.\n表十 of these long lines that are no heading at all, as it ends.\nTable 3, in a long line that is no heading at all, as it ends.\nnone of them, in a long line."))
    assert [r.tables for r in rows.collect()] == [3]


def test_names_are_told_in_any_case(spark):
    from corpusmill.operators import keywords

    rows = keywords.pattern_entities(docs_of(spark, "Which Alpha and ALPHA They were Was Berlin", None, "")).collect()
    assert [(r.keyword, r.category) for r in rows] == [("Alpha", "MISC"), ("Was", "MISC"), ("Berlin", "MISC")]


def test_an_extractor_that_fails_leaves_the_others_alone(spark):
    from corpusmill.operators import keywords

    def bad(docs):
        raise RuntimeError("no model")

    def picky(text):
        if "x" in text:
            raise KeyError("x")
        return [(text.split()[0], 0.5, None)]

    keywords.register("test_bad", bad)
    keywords.register("test_picky", keywords.text_extractor("test_picky", picky))
    try:
        assert {"simple", "pattern", "freq", "test_bad", "test_picky"} <= set(keywords.available())
        rows = keywords.extract_occurrences(docs_of(spark, "alpha beta\nalpha", "xalpha yes", None), ["simple", "test_bad", "test_picky"]).collect()
    finally:
        del keywords.EXTRACTORS["test_bad"], keywords.EXTRACTORS["test_picky"]
    found = {(r.doc_id, r.extractor, r.keyword): (r.start_position, r.line_number, r.column_number, r.error) for r in rows}
    assert found[0, "simple", "alpha"] == (0, 1, 1, None) and found[0, "test_picky", "alpha"] == (0, 1, 1, None)
    assert found[1, "test_picky", None] == (None, None, None, "KeyError: 'x'") and found[1, "simple", "xalpha"][0] == 0
    assert {d for d, e, k in found if e == "test_bad" and k is None and found[d, e, k][3] == "RuntimeError: no model"} == {0, 1, 2}
    with pytest.raises(ValueError):
        keywords.extract_occurrences(docs_of(spark, "a"), ["none"])


def test_box_rows_against_a_plain_version(spark):
    from corpusmill.operators import layout

    rng = random.Random(9)
    tokens = [(d, p, i, rng.choice("abcdef"), rng.choice([0.2, 0.3, 0.9, None]), float(x := rng.randrange(0, 400, 50)), x + 20.0, float(y := rng.randrange(0, 200, 6)), y + 10.0) for d in range(3) for p in range(2) for i in range(40)]
    schema = "doc_id int, page int, i int, text string, confidence double, x_min double, x_max double, y_min double, y_max double"
    found = {(r.doc_id, r.page): (r.text, r.tables) for r in layout.ocr_text(spark.createDataFrame(tokens, schema)).collect()}
    expected = {}
    for d, p in {t[:2] for t in tokens}:
        rows = []
        for t in sorted((t for t in tokens if t[:2] == (d, p) and t[4] and t[4] > 0.3), key=lambda t: ((t[7] + t[8]) / 2, t[2])):
            y = (t[7] + t[8]) / 2
            if rows and abs(y - sum(r[0] for r in rows[-1]) / len(rows[-1])) < 15:
                rows[-1].append((y, t))
            else:
                rows.append([(y, t)])
        cells = [[t[3] for _, t in sorted(r, key=lambda x: x[1][5] + x[1][6])] for r in rows]
        parts, run = [], []
        for c in [*cells, None]:
            if c is not None and len(c) > 1 and (not run or abs(len(c) - sum(map(len, run)) / len(run)) <= 2):
                run.append(c)
                continue
            if len(run) > 1:
                n = max(map(len, run))
                lines = ["| " + " | ".join(r + [""] * (n - len(r))) + " |" for r in run]
                parts.append((1, "\n".join([lines[0], "|" + "---|" * n, *lines[1:]]) + ("\n" if c is not None else "")))
            elif run:
                parts.append((0, " ".join(run[0])))
            run = []
            if c is not None:
                parts.append((0, " ".join(c)))
        expected[d, p] = ("\n".join(t for _, t in parts), sum(k for k, _ in parts))
    assert found == expected and max(n for _, n in found.values()) > 0


def test_outlines(spark):
    from corpusmill.operators import outlines

    deep = {"title": "t0", "keywords": ["a"]}
    for i in range(1, 400):
        deep = {"title": f"t{i}", "children": [deep]}
    import json

    replies = [(1, "n", json.dumps({"structureAnalysis": [deep]})), (2, "n", "no json"), (3, None, None), (4, "n", "[1]"), (5, "n", json.dumps({"structureAnalysis": [{"unit": " CHAPTER ", "number": 1.5, "keywords": [" a ", "a", {"text": "b"}, 3], "sections": [{"name": 7}]}, "x"]}))]
    nodes, edges = outlines.outline_graph(spark.createDataFrame(replies, "doc_id int, name string, reply string"))
    found = nodes.collect()
    assert {r.doc_id for r in found} == {1, 5} and max(r.level for r in found if r.doc_id == 1) == 400
    five = [(r.type, r.title, r.unit, r.number, r.level, r.path, list(r.keywords)) for r in found if r.doc_id == 5]
    assert five == [("Document", "n", None, None, 0, None, []), ("DocumentSection", "Level1_Section_1", "chapter", "15", 1, "0", ["a", "b"]), ("SectionKeyword", "a", "chapter", "15", 1, "0", []), ("SectionKeyword", "b", "chapter", "15", 1, "0", []), ("DocumentSubsection", "7", "절", "1", 2, "0.0", [])]
    assert sorted(r.type for r in edges.filter("doc_id = 5").collect()) == ["CONTAINS_SECTION", "HAS_KEYWORD", "HAS_KEYWORD", "HAS_SUBSECTION"]


def test_nouns_and_richness(spark):
    from corpusmill.operators import keywords, records

    found = [(r.doc_id, r.keyword, r.score) for r in keywords.noun_extract(docs_of(spark, "나무 하늘 나무 가 abc", "", None), 1).collect()]
    assert found == [(0, "나무", 1.0)]
    cases = {'{"a": 1}': 11, "{}": 10, '{"docling_structure": {"tables": [1, 2], "sections": 3}}': 51, "[1]": None, "none": None}
    rows = spark.createDataFrame([(c,) for c in [*cases, None]], "r string").select("r", records.richness(F.col("r")).alias("n")).collect()
    assert {r.r: r.n for r in rows} == {**cases, None: None}
