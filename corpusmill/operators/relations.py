"""Relations between entities of a document: which pairs stand near each other, in what words, what that says and how sure it is."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources import tables

from .graph import entity_type
from .hierarchy import DEFAULT_RELATION

#: Relations of two types of entities by domain. In the technical domain a pair the other way round has the reversed name.
RULES = {
    "technical": {("Technology", "Database"): "USES", ("Framework", "Database"): "CONNECTS_TO", ("Technology", "Framework"): "INTEGRATES_WITH", ("API", "Database"): "ACCESSES", ("Service", "Technology"): "IMPLEMENTS", ("Tool", "Framework"): "SUPPORTS"},
    "academic": {("Author", "Research_Method"): "USES", ("Theory", "Research_Method"): "APPLIED_BY", ("Concept", "Theory"): "RELATED_TO", ("Dataset", "Research_Method"): "ANALYZED_BY"},
    "business": {("Company", "Product"): "PRODUCES", ("Strategy", "Goal"): "ACHIEVES", ("Process", "Tool"): "UTILIZES"},
}
REVERSED = {"USES": "USED_BY", "CONNECTS_TO": "CONNECTED_BY", "INTEGRATES_WITH": "INTEGRATED_BY", "ACCESSES": "ACCESSED_BY", "IMPLEMENTS": "IMPLEMENTED_BY", "SUPPORTS": "SUPPORTED_BY"}
#: Cues of a relation in other domains, in the order in which they are tried; and what a relation's name is worth.
CUES = (("USES", ("사용", "활용", "이용")), ("INTEGRATES_WITH", ("연결", "연동", "통합")), ("IMPLEMENTS", ("구현", "개발")), ("SUPPORTS", ("지원", "도구")))
WEIGHTS = {"USES": 0.9, "INTEGRATES_WITH": 0.85, "IMPLEMENTS": 0.8, "CONNECTS_TO": 0.8, "COMPLEMENTS": 0.75, "SUPPORTS": 0.7, "RELATED_TO": 0.5}
DEFAULT_WEIGHT, CONTEXT_BONUS, LEAST_CONFIDENCE = 0.6, 0.1, 0.5
#: Technologies that are known to go together, the relation between them, its confidence, and the types that count.
STACKS = ((("fastapi", "sqlalchemy"), "INTEGRATES_WITH"), (("react", "node.js"), "WORKS_WITH"), (("postgresql", "redis"), "COMPLEMENTS"), (("docker", "kubernetes"), "ORCHESTRATED_BY"))
STACK_CONFIDENCE, STACK_TYPES = 0.8, ("Technology", "Framework", "Database", "Tool")
AROUND, CONTEXT_CHARS = 100, 200
#: Marks that end a sentence or block, wherever they begin, as each may begin within another.
_MARK = re.compile(r"(?=(\n\n|\. |\.\n|\||- \*\*|## ))")


def _hits(low: str, word: str) -> np.ndarray:
    found, at = [], low.find(word)
    while at >= 0:
        found.append(at)
        at = low.find(word, at + 1)
    return np.array(found, np.int64)


def _near_pairs(low: str, words: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(i, j, gap, place of i, place of j) at the closest hits of each two words, i before j in the list, that stand near somewhere in the text.

    For every hit the next hit of each word is looked up in its sorted places, so the work is words times hits, never hits times hits.
    """
    places = [_hits(low, w) for w in words]
    here = [i for i, p in enumerate(places) if len(p)]
    if len(here) < 2:
        return []
    hits = np.concatenate([places[i] for i in here])
    first = np.concatenate([[0], np.cumsum([len(places[i]) for i in here])[:-1]])
    marks = [(m.start(), m.start() + len(m[1])) for m in _MARK.finditer(low)]
    limit = hits + AROUND  # the last place where a partner still is near: within reach, and no mark ends before it
    if marks:
        begins, ends = (np.array(x, np.int64) for x in zip(*marks, strict=True))
        ends = np.concatenate([np.minimum.accumulate(ends[::-1])[::-1], [len(low) + AROUND]])
        limit = np.minimum(limit, ends[np.searchsorted(begins, hits)] - 1)
    forth = np.empty((len(here), len(here)), np.int64)  # from each word (row) to the next hit of another (column): gap and place
    near = np.empty((len(here), len(here)), bool)
    for c, j in enumerate(here):
        at = np.searchsorted(places[j], hits)
        known = at < len(places[j])
        following = places[j][np.minimum(at, len(places[j]) - 1)]
        forth[:, c] = np.minimum.reduceat(np.where(known, following - hits << 32 | hits, np.iinfo(np.int64).max), first)
        near[:, c] = np.logical_or.reduceat(known & (following <= limit), first)
    out = []
    for x, i in enumerate(here):
        for y in range(x + 1, len(here)):
            if near[x, y] or near[y, x]:
                ways = [(g >> 32, a := (g & 0xFFFFFFFF) + (g >> 32) * back, a + (g >> 32) * (-1 if back else 1)) for g, back in ((int(forth[x, y]), 0), (int(forth[y, x]), 1)) if g != np.iinfo(np.int64).max]
                out.append((i, here[y], *min(ways)))
    return out


def _contexts(batches: Iterator[pa.RecordBatch], carried: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("row", "source", "target", "gap", "context")}
        for row, (text, low, words) in enumerate(zip(batch["text"].to_pylist(), batch["low"].to_pylist(), batch["words"].to_pylist(), strict=True)):
            for i, j, gap, a, b in _near_pairs(low, words):
                context = text[max(0, min(a, b) - AROUND) : max(a + len(words[i]), b + len(words[j])) + AROUND].strip(" \t\n\r\f\v")
                for c, value in zip(rows, (row, words[i], words[j], gap, context[:CONTEXT_CHARS] + "..." * (len(context) > CONTEXT_CHARS)), strict=True):
                    rows[c].append(value)
        at = pa.array(rows.pop("row"), pa.int64())
        yield pa.RecordBatch.from_pydict({**{c: batch[c].take(at) for c in ("doc_id", *carried)}, "source": pa.array(rows["source"], pa.string()), "target": pa.array(rows["target"], pa.string()), "gap": pa.array(rows["gap"], pa.int32()), "context": pa.array(rows["context"], pa.string())})


def near_contexts(words: DataFrame, docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, *carried, source, target, gap, context): each two words (doc_id, word, score) of a document that stand near, and the text around their closest hits.

    Near are hits, of words in lower case, at most 100 characters apart with no end of a sentence or block between. The better scored word is
    the source, equal ones in order. Of equally close hits the first of the source, then of the target counts. A hundred characters around
    the hits, bare at its ends, cut at 200. Words of a document meet its text in one row; documents without words have no rows. `carried` are string
    columns of `words` that are the same in all rows of a document.
    """
    best = words.groupBy("doc_id", "word").agg(F.max("score").alias("score"), *[F.first(c).alias(c) for c in carried])
    ranked = best.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in carried], F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("key"), "word"))).alias("w"))
    both = docs.select("doc_id", "text").join(ranked.select("doc_id", *carried, F.transform("w", lambda x: x["word"]).alias("words")), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    return both.withColumn("low", F.lower("text")).mapInArrow(lambda batches: _contexts(batches, carried), f"doc_id {dict(docs.dtypes)['doc_id']}, {''.join(f'{c} string, ' for c in carried)}source string, target string, gap int, context string")


def relation_rule(domain: Column, type1: Column, type2: Column, context: Column) -> Column:
    """The relation of two types of entities in a domain, null without one; domains without rules go by cues in the context."""
    name = lambda a, b: F.concat_ws("|", domain, a, b)
    direct = {f"{d}|{a}|{b}": r for d, rules in RULES.items() for (a, b), r in rules.items()}
    back = {f"{d}|{b}|{a}": REVERSED.get(r, r) if d == "technical" else r for d, rules in RULES.items() for (a, b), r in rules.items()}
    table = F.create_map(*[F.lit(x) for pair in (back | direct).items() for x in pair])
    low, by_cue = F.lower(F.coalesce(context, F.lit(""))), F.lit(DEFAULT_RELATION)
    for relation, cues in reversed(CUES):
        fits = F.lit(False)
        for cue in cues:
            fits = fits | low.contains(cue)
        by_cue = F.when(fits, relation).otherwise(by_cue)
    return F.when(domain.isin(*RULES), F.try_element_at(table, name(type1, type2))).otherwise(by_cue)


def relation_confidence(relation: Column, score1: Column, score2: Column, context: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    bonus = F.when(F.coalesce(context, F.lit("")) != "", CONTEXT_BONUS).otherwise(0.0)
    return F.round(F.least(F.least(score1, score2) * F.coalesce(F.try_element_at(table, relation), F.lit(DEFAULT_WEIGHT)) + bonus, F.lit(1.0)), 6)


def entity_relations(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, source, target, relationship_name, confidence, context_snippet, extractor): relations of entities that share a structure and stand near.

    `entities` is what `hierarchy.structure_entities` gives. The better scored word comes first, equal ones in order. Only named relations of confidence 0.5
    or more count. A structure's entities are paired through the near pairs of its document, never all with all.
    """
    entities = tables.written(entities.select("doc_id", "node", "id", "word", "score", "extractor", "domain"), "entities")
    contexts = near_contexts(entities.select("doc_id", "word", "score", "domain"), docs, "domain")
    # a word's type follows from its document's domain, so pairs without a relation go before anything is joined
    kind = lambda c: entity_type(F.col(c), F.col("domain"))
    related = contexts.withColumn("relationship_name", relation_rule(F.col("domain"), kind("source"), kind("target"), F.col("context"))).filter(F.col("relationship_name").isNotNull() & (F.col("relationship_name") != DEFAULT_RELATION))
    side = lambda name: entities.select("doc_id", "node", F.col("word").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("id", "score", "extractor")])
    named = related.join(side("source"), ["doc_id", "source"]).join(side("target"), ["doc_id", "target", "node"])
    sure = named.withColumn("confidence", relation_confidence(F.col("relationship_name"), F.col("source_score"), F.col("target_score"), F.col("context"))).filter(F.col("confidence") >= LEAST_CONFIDENCE)
    return sure.select("doc_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relationship_name", "confidence", F.substring("context", 1, 100).alias("context_snippet"), F.col("source_extractor").alias("extractor"))


def known_stacks(entities: DataFrame) -> DataFrame:
    """(doc_id, source, target, relationship_name, confidence): pairs of a technical document's entities that one known stack names.

    Entities meet only within a stack, the better scored first, equal ones by word, then by id.
    """
    low = F.lower("word")
    named = F.array(*[F.when(F.array_contains(F.transform(F.array(*map(F.lit, names)), lambda n: low.contains(n)), True), F.struct(F.lit(i).alias("stack"), F.lit(relation).alias("relationship_name"))) for i, (names, relation) in enumerate(STACKS)])
    fitting = entities.filter((F.col("domain") == "technical") & F.col("entity_type").isin(*STACK_TYPES)).select("doc_id", "id", "word", "score", F.explode(F.array_compact(named)).alias("s"))
    listed = fitting.groupBy("doc_id", "s").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("key"), "word", "id"))).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a["id"].alias("source"), b["id"].alias("target")))))
    return listed.select("doc_id", "s.relationship_name", F.explode(pairs).alias("p")).select("doc_id", "p.*", "relationship_name", F.lit(STACK_CONFIDENCE).alias("confidence"))
