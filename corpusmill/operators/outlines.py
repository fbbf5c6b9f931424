"""Nested outlines of documents, as JSON of any depth and several spellings, as nodes and edges."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys under which an outline keeps the sections below one, a title, a text, pages and a keyword's text, in the order in which they are tried.
CHILDREN = ("subStructure", "substructure", "substructures", "subSections", "subsections", "sections", "children")
TITLES, CONTENTS, PAGES, WORDS = ("title", "heading", "name"), ("mainContent", "summary", "content", "description", "body"), ("pageRange", "page", "pages"), ("text", "name", "keyword")
#: Names of units that are kept, and those by level for all others.
UNITS, UNIT_BY_LEVEL = ("장", "절", "소절", "소소절", "chapter", "section", "subsection", "subsubsection"), ("장", "절", "소절", "소소절")

NODE = "doc_id {}, id string, type string, title string, unit string, number string, level int, path string, section_path string, parent_section string, parent_id string, page string, content string, keywords array<string>"
_FIELDS = ("id", "type", "title", "unit", "number", "level", "path", "section_path", "parent_section", "parent_id", "page", "content", "keywords")


def _hash(text: str) -> str:
    return hashlib.sha1(text.encode("utf-8", "ignore")).hexdigest()[:16]


def _text(value: Any) -> str:
    return value.strip() if isinstance(value, str) else "" if value is None else str(value)


def _first(node: dict, keys: tuple[str, ...]) -> Any:
    return next((node[k] for k in keys if node.get(k)), None)


def _unit(raw: Any, level: int) -> str:
    name = _text(raw) if isinstance(raw, str) else ""
    return next((u for u in (name, name.lower()) if u in UNITS), UNIT_BY_LEVEL[min(level, 4) - 1])


def _keywords(node: dict) -> list[str]:
    raw = node.get("keywords") or []
    found = (_text(k) if isinstance(k, str) else _text(_first(k, WORDS)) if isinstance(k, dict) else "" for k in ([raw] if isinstance(raw, dict) else raw if isinstance(raw, list) else []))
    return list(dict.fromkeys(k for k in found if k))


def _below(node: dict) -> list[dict]:
    found = _first(node, CHILDREN)
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else [found] if isinstance(found, dict) else []


def outline_nodes(reply: str | None, name: str) -> Iterator[tuple]:
    """The nodes of one outline in page order, each section before its keywords and the sections below it; none for what is no outline."""
    try:
        outline = json.loads(reply or "")
    except ValueError:
        return
    if not isinstance(outline, dict):
        return
    info = outline.get("documentInfo")
    title = _text(info.get("title")) if isinstance(info, dict) else name
    root = f"doc_{_hash(name)}"
    yield root, "Document", title, None, None, 0, None, title, None, None, None, None, []
    top = outline.get("structureAnalysis")
    todo = [(1, str(i), i, node, root, title, [title]) for i, node in reversed(list(enumerate(top if isinstance(top, list) else [])))]
    while todo:  # a stack, so that no depth is too deep
        level, path, index, node, parent, above, titles = todo.pop()
        if not isinstance(node, dict):
            continue
        own = _text(_first(node, TITLES)) or f"Level{level}_Section_{index + 1}"
        digits = re.findall(r"\d+", str(node["number"])) if isinstance(node.get("number"), (int, float, str)) else []
        unit, number, words = _unit(node.get("unit"), level), "".join(digits) or str(index + 1), _keywords(node)
        identity = f"llm_{'section' if level == 1 else 'subsection'}_{_hash(f'{own}|{path}|{level}|{parent}')}"
        page = next((str(v) for v in map(node.get, PAGES) if isinstance(v, (int, float)) or isinstance(v, str) and v.strip()), "")
        content = next((v for v in map(node.get, CONTENTS) if isinstance(v, str) and v.strip()), "")
        yield identity, "DocumentSection" if level == 1 else "DocumentSubsection", own, unit, number, level, path, " > ".join(t for t in [*titles, own] if t), above, parent, page, content, words
        for i, word in enumerate(words):
            yield f"llm_kw_{_hash(word + identity)}_{i}", "SectionKeyword" if level == 1 else "SubsectionKeyword", word, unit, number, level, path, None, above, identity, None, None, []
        todo += [(level + 1, f"{path}.{i}", i, child, identity, own, [*titles, own]) for i, child in reversed(list(enumerate(_below(node))))]


def outline_graph(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of stored outlines (doc_id, name, reply): documents, their sections to any depth, and the sections' keywords.

    Paths number the sections from 0 (`0.1.2`); a section without a title, number or known unit is named by its level and place. Of several keys for
    the sections below, the first that is not empty counts. A reply that is no JSON object gives no nodes, one without sections its document.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, (name, reply) in enumerate(zip(batch["name"].to_pylist(), batch["reply"].to_pylist(), strict=True)):
                found = list(outline_nodes(reply, name or ""))
                rows += found
                at += [i] * len(found)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
            kinds = {"level": pa.int32(), "keywords": pa.list_(pa.string())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(at, pa.int64())), **{f: pa.array(c, kinds.get(f, pa.string())) for f, c in zip(_FIELDS, columns, strict=True)}})

    nodes = replies.select("doc_id", "name", "reply").mapInArrow(walk, NODE.format(dict(replies.dtypes)["doc_id"]))
    kind = F.when(F.col("type") == "DocumentSection", "CONTAINS_SECTION").when(F.col("type") == "DocumentSubsection", "HAS_SUBSECTION").otherwise("HAS_KEYWORD")
    identity = F.concat(F.lit("rel_"), F.substring(F.sha1(F.concat("parent_id", "id")), 1, 16))
    edges = nodes.filter("parent_id IS NOT NULL").select("doc_id", identity.alias("id"), kind.alias("type"), F.col("parent_id").alias("source"), F.col("id").alias("target"), "unit", F.col("path").alias("hierarchical_path"))
    return nodes, edges
