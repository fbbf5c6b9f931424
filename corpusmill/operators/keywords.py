"""Keyword extractors: documents in, located and scored occurrences out; and the rules that combine them."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as t

OCCURRENCE = "doc_id bigint, keyword string, extractor string, score double, category string, start_position int, end_position int, context_snippet string, page_number int, line_number int, column_number int"
#: Words, in lower case, that are no names though they begin with a capital.
NO_NAMES = (
    "the", "and", "for", "are", "but", "not", "you", "all", "this", "that", "with", "from", "they", "have", "more", "will", "been", "were", "said", "each", "which", "their", "time", "would", "there", "what", "about", "when", "after", "first", "other", "many",
    "some", "very", "come", "could", "make", "know", "just", "into", "over", "think", "also", "back", "only", "good", "work", "life", "way", "even", "new", "want", "because", "any", "these", "give", "day", "most", "us",
)
#: Confidence of entity labels, those of English models first, then those of Korean ones; any other label gets the default.
LABEL_CONFIDENCE = {
    "PERSON": 0.9, "ORG": 0.85, "LOC": 0.8, "DATE": 0.75, "TIME": 0.7, "MONEY": 0.85, "PERCENT": 0.8, "MISC": 0.6,
    "PS": 0.85, "LC": 0.8, "OG": 0.85, "DT": 0.75, "TI": 0.7, "QT": 0.8, "CV": 0.75, "AM": 0.7, "PT": 0.7, "MT": 0.7, "TR": 0.7, "EV": 0.75, "AF": 0.7, "FD": 0.75, "TM": 0.7,
}
DEFAULT_CONFIDENCE = 0.65
#: Endings of the names of organisations and of places.
ORGANISATION_ENDINGS = "전자|그룹|회사|기업|산업|코퍼레이션|Corporation|Inc|Ltd"
PLACE_ENDINGS = "시|도|구|군|동|면|읍|특별시|광역시"


_TOKEN, _HANGUL = re.compile(r"\w+"), re.compile("[가-힣]{2,}")
#: Letters that Unicode 15.1 added are none yet for the SQL.
_LONG_TOKEN, _STOPS = re.compile(r"[^\W\U0002EBF0-\U0002EE5D]{2,}"), frozenset(t.STOP_WORDS)
#: Fixed value: rows of a batch that leaves a task.
_ROWS = 1 << 16


def _by_count(word: tuple[str, int, int]) -> tuple[int, int]:
    return -word[1], word[2]


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, i (from 0), w: runs of letters, numbers and underscores."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(t.TOKEN), 0)).alias("i", "w"))


def find_positions(text: Column, keyword: Column, ignore_case: bool = True) -> Column:
    """All 0-based places of the keyword, overlapping ones too."""
    hay, needle = (F.lower(text), F.lower(keyword)) if ignore_case else (text, keyword)
    last = F.length(hay) - F.length(needle)
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substr(hay, i + 1, F.length(needle)) == needle))


def snippet(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    """The text around a place, with dots on the sides that are cut."""
    a, b = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    return F.concat(F.when(a > 0, "...").otherwise(""), F.substr(text, a + 1, b - a), F.when(b < F.length(text), "...").otherwise(""))


def entity_context(text: Column, keyword: Column, around: int = 100) -> Column:
    """The text around the first hit in any case; empty without one."""
    at = F.position(F.lower(keyword), F.lower(text))
    return F.when(at > 0, F.substr(text, F.greatest(at - around, F.lit(1)), F.length(keyword) + 2 * around + F.least(at - around - 1, F.lit(0)))).otherwise("")


def per_document(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text, found): each document's rows as one array, so that its text moves once."""
    fields = [c for c in rows.columns if c != "doc_id"]
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("found"))
    return docs.select("doc_id", "text").join(listed, "doc_id")


def located(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (doc_id, keyword, extractor, score, category, ...) with the place of their first hit, line, column, page and snippet; further columns stay.

    A document's rows meet its text in one row. A keyword that is null or does not occur has no place; line, column and page are then null too.
    """
    text = F.col("text")

    def place(x: Column) -> Column:
        return x.withField("start_position", F.when(F.position(x["keyword"], text) > 0, F.position(x["keyword"], text) - 1))

    placed = per_document(rows, docs).select("doc_id", "text", F.explode(F.transform("found", place)).alias("x")).select("doc_id", "text", "x.*")
    placed = placed.withColumn("end_position", (F.col("start_position") + F.length("keyword")).cast("int"))
    before = F.expr("substring(text, 1, start_position)")
    return placed.select(
        "doc_id", "keyword", "extractor", "score", "category", "start_position", "end_position", snippet(text, F.col("start_position"), F.col("end_position")).alias("context_snippet"),
        (F.regexp_count(before, F.lit("\f")) + 1).alias("page_number"), (F.regexp_count(before, F.lit("\n")) + 1).alias("line_number"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column_number"),
        *[c for c in rows.columns if c not in ("doc_id", "keyword", "extractor", "score", "category")],
    )


def top(rows: DataFrame, by: list, n: int, group: str = "doc_id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("rank") <= n)


def _count_words(text: str) -> list[tuple[str, int, int]]:
    """(keyword, number, first place among all tokens) of a text's words."""
    tokens = _TOKEN.findall(text)
    first = dict(zip(reversed(tokens), range(len(tokens) - 1, -1, -1)))  # the first place is set last
    found: dict[str, tuple[int, int]] = {}
    for token, n in Counter(tokens).items():
        if not token.isascii() and (hangul := _HANGUL.match(token)):
            before = found.get(hangul[0], (0, first[token]))
            found[hangul[0]] = (before[0] + n, min(before[1], first[token]))
        elif len(token) >= 3 and token.isascii() and token.isalpha():
            found[token] = (n, first[token])
    return [(k, n, at) for k, (n, at) in found.items()]


def counted_words(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, keyword, n, first, rank: Hangul words of two, Latin words of three or more characters with their counts, the most frequent first, ties to the
    earlier word; all of them, or the `most` best.

    A document's words are counted where its row is: nothing is shuffled, and only the words that are asked for leave the row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, int, int, int]] = []
            for row, text in enumerate(batch["text"]):
                if text.is_valid:
                    words = _count_words(text.as_py())
                    best = sorted(words, key=_by_count) if most is None else heapq.nsmallest(most, words, key=_by_count)
                    rows += [(row, *w, rank) for rank, w in enumerate(best, 1)]
            at, keyword, n, first, rank = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(at, pa.int64())), "keyword": pa.array(keyword, pa.string()), "n": pa.array(n, pa.int64()), "first": pa.array(first, pa.int32()), "rank": pa.array(rank, pa.int32())})

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, keyword string, n bigint, first int, rank int")


def simple_keywords(docs: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent words of a document; ties to the earlier word; the score falls by a tenth a rank."""
    return counted_words(docs, n).select("doc_id", "keyword", F.lit("simple").alias("extractor"), F.round(0.8 - (F.col("rank") - 1) * 0.1, 1).alias("score"), F.lit("noun").alias("category"), "rank", "n")


def pattern_entities(docs: DataFrame, n: int = 20) -> DataFrame:
    """Years, sums of money, organisations and places by their Hangul endings, and capitalised words, once per document in any case, as they are first spelled."""
    suffixes = ORGANISATION_ENDINGS, PLACE_ENDINGS
    kinds = [("DATE", 0.8, r"\d{4}년"), ("MONEY", 0.85, r"\d+[억만천]?원"), ("ORG", 0.75, f"[가-힣]{{2,}}(?:{suffixes[0]})"), ("LOC", 0.7, f"[가-힣]{{2,}}(?:{suffixes[1]})")]
    every = [docs.select("doc_id", F.lit(c).alias("category"), F.lit(s).alias("score"), F.posexplode(F.regexp_extract_all("text", F.lit(p), 0)).alias("i", "keyword")) for c, s, p in kinds]
    names = tokens(docs).filter(F.col("w").rlike("^[A-Z][A-Za-z]{2,}$") & ~F.lower("w").isin(*NO_NAMES)).select("doc_id", F.lit("MISC").alias("category"), F.lit(0.6).alias("score"), "i", F.col("w").alias("keyword"))
    found = reduce(DataFrame.unionByName, [*every, names]).groupBy("doc_id", F.lower("keyword").alias("low"), "category", "score").agg(F.min(F.struct("i", "keyword")).alias("f"))
    best = top(found.select("doc_id", "category", "score", F.col("f.i").alias("first"), F.col("f.keyword").alias("keyword")), [F.desc("score"), "first", "keyword"], n)
    return best.select("doc_id", "keyword", F.lit("pattern").alias("extractor"), "score", "category")


def noun_extract(docs: DataFrame, n: int = 10) -> DataFrame:
    """Words of two or more Hangul syllables that may be keywords, scored by their count against the document's most frequent; ties to the earlier.

    Every word of this length passes the rule for likely nouns. All in the document's row; a text without such words, or null, has no rows.
    """
    runs = F.filter(F.regexp_extract_all("text", F.lit("[가-힣]{2,}"), 0), t.is_meaningful)
    found = docs.select("doc_id", runs.alias("runs")).withColumn("words", F.array_distinct("runs"))
    counted = F.transform("words", lambda w, i: F.struct((-F.size(F.filter("runs", lambda r: r == w))).alias("n"), i.alias("i"), w.alias("keyword")))
    best = found.select("doc_id", F.array_sort(counted).alias("w")).withColumn("most", F.get("w", F.lit(0))["n"])
    rows = best.select("doc_id", "most", F.explode(F.slice("w", 1, n)).alias("w"))
    return rows.select("doc_id", "w.keyword", F.lit("nouns").alias("extractor"), F.round(F.col("w.n") / F.col("most"), 6).alias("score"), F.lit("noun").alias("category"))


def freq_keywords(docs: DataFrame, n: int = 10, distinct_first: bool = False) -> DataFrame:
    """Words that may be keywords, scored by their share of all such words of the document."""
    words = tokens(docs).filter(F.col("w").rlike("^[A-Za-z]{3,}$|^[가-힣]{2,}$") & t.is_meaningful(F.col("w")))
    counts = words.groupBy("doc_id", F.lower("w").alias("keyword")).agg((F.lit(1) if distinct_first else F.count(F.lit(1))).alias("n"), F.min("i").alias("first"))
    total = counts.withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    best = top(total, [F.desc("n"), "first"], n)
    return best.select("doc_id", "keyword", F.lit("freq").alias("extractor"), F.round(F.least(F.lit(1.0), F.col("n") / F.col("all") * 10), 6).alias("score"), F.lit(None).cast("string").alias("category"))


Extractor = Callable[[DataFrame], DataFrame]
#: Extractors by name; each takes documents and gives (doc_id, keyword, extractor, score, category), and may give `error`.
EXTRACTORS: dict[str, Extractor] = {"simple": simple_keywords, "pattern": pattern_entities, "freq": freq_keywords, "nouns": noun_extract}


def available() -> list[str]:
    return sorted(EXTRACTORS)


def register(name: str, extractor: Extractor) -> None:
    """Add an extractor; a name is given once."""
    if name in EXTRACTORS:
        raise ValueError(f"there is an extractor {name}")
    EXTRACTORS[name] = extractor


def text_extractor(name: str, extract: Callable[[str], Iterable[tuple[str, float, str | None]]]) -> Extractor:
    """An extractor from a function of one text that gives (keyword, score, category). A text on which it fails gives one row without a keyword, with
    the error; the other texts are not affected. A null text is not shown to it.
    """

    def run(docs: DataFrame) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch["text"].to_pylist()):
                    try:
                        found = [(k, name, float(score), category, None) for k, score, category in extract(text)] if text is not None else []
                    except Exception as error:  # whatever a foreign function raises is that text's alone
                        found = [(None, name, None, None, f"{type(error).__name__}: {error}")]
                    at += [i] * len(found)
                    rows += found
                keyword, extractor, score, category, error = zip(*rows, strict=True) if rows else ((),) * 5
                strings = {"keyword": keyword, "extractor": extractor, "category": category, "error": error}
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(at, pa.int64())), "score": pa.array(score, pa.float64()), **{c: pa.array(v, pa.string()) for c, v in strings.items()}})

        return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, keyword string, extractor string, category string, error string")

    return run


def multi_extract(docs: DataFrame, methods: list[str]) -> DataFrame:
    """Occurrences of all chosen extractors; an unknown name is refused before anything runs."""
    if unknown := set(methods) - set(EXTRACTORS):
        raise ValueError(f"unknown extractors: {sorted(unknown)}")
    columns = ["doc_id", "keyword", "extractor", "score", "category"]
    return reduce(DataFrame.unionByName, [EXTRACTORS[m](docs).select(*columns) for m in methods])


def extract_occurrences(docs: DataFrame, methods: list[str]) -> DataFrame:
    """All ten columns of the occurrences of the chosen extractors, and `error`: null but for texts on which an extractor failed.

    An unknown name is refused before anything runs. An extractor that cannot be planned gives a row with its error for every document and leaves
    the others alone.
    """
    if unknown := set(methods) - set(EXTRACTORS):
        raise ValueError(f"unknown extractors: {sorted(unknown)}")
    columns, parts = ["doc_id", "keyword", "extractor", "score", "category"], []
    for name in methods:
        try:
            rows = EXTRACTORS[name](docs)
            parts.append(rows.select(*columns, F.col("error") if "error" in rows.columns else F.lit(None).cast("string").alias("error")))
        except Exception as error:  # the extractor is foreign code; its failure is reported in its rows
            none = F.lit(None).cast("string")
            parts.append(docs.select("doc_id", none.alias("keyword"), F.lit(name).alias("extractor"), F.lit(None).cast("double").alias("score"), none.alias("category"), F.lit(f"{type(error).__name__}: {error}").alias("error")))
    return located(reduce(DataFrame.unionByName, parts), docs)


def best_per_keyword(occ: DataFrame) -> DataFrame:
    """The best row of each keyword and extractor."""
    w = Window.partitionBy("keyword", "extractor").orderBy(F.desc("score"), "doc_id")
    return occ.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def entity_top(occ: DataFrame, n: int) -> DataFrame:
    """Per document and category one row for each keyword in any case, then the n best."""
    w = Window.partitionBy("doc_id", F.lower("keyword"), "category").orderBy(F.desc("score"), "keyword")
    return top(occ.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r"), [F.desc("score"), "keyword", "extractor"], n)


def label_confidence(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABEL_CONFIDENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit(DEFAULT_CONFIDENCE))


def noun_score(docs: DataFrame) -> DataFrame:
    """Frequency against the document's most frequent word, and up to a fifth for length."""
    c = counted_words(docs).withColumn("most", F.max("n").over(Window.partitionBy("doc_id")))
    bonus = F.least(F.lit(0.2), (F.length("keyword") - 2) * 0.05)
    return c.select("doc_id", "keyword", F.round(F.least(F.lit(1.0), F.col("n") / F.col("most") + bonus), 6).alias("score"))


def group_mean(occ: DataFrame) -> DataFrame:
    """One row for each keyword in any case, with the mean of its scores."""
    w = Window.partitionBy(F.lower("keyword"))
    first = w.orderBy(F.desc("score"), "doc_id", "extractor", "keyword")
    return occ.withColumn("mean", F.avg("score").over(w)).withColumn("r", F.row_number().over(first)).filter("r = 1").select("doc_id", "keyword", (F.floor(F.col("mean") * 1000 + 1e-6) / 1000).alias("score"))


def _count_ngrams(text: str, n: int, most: int | None) -> list[tuple[str, int]]:
    """(n-gram, number) of a text; its `most` most frequent, ties in order of the n-gram.

    A character is put in lower case by itself: İ has one in the SQL, and Σ the same one at the end of a word.
    """
    words = [w for w in _LONG_TOKEN.findall(text.replace("İ", "i").replace("Σ", "σ").lower()) if w not in _STOPS]
    counts = Counter(words)
    for k in range(2, n + 1):
        counts.update(map(" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    if most is None or len(counts) <= most:
        return list(counts.items())
    least = sorted(counts.values(), reverse=True)[most - 1]
    best = [(w, c) for w, c in counts.items() if c > least]
    return best + [(w, least) for w in sorted(w for w, c in counts.items() if c == least)[:most - len(best)]]


def ngrams(docs: DataFrame, n: int = 2, most: int | None = None) -> DataFrame:
    """(doc_id, ngram, tf): lower-cased words of two or more characters, stop words out, as runs of 1 to n; all of them, or a document's `most` most
    frequent, ties in order of the n-gram.

    A document's n-grams are counted where its row is, and leave it a few rows at a time: no n-gram is shuffled. Only if some rows share a doc_id, which
    is looked for at once, are the counts of those rows shuffled and added up.
    """

    def count(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for row, text in enumerate(batch["text"]):
                found = _count_ngrams(text.as_py(), n, most) if text.is_valid else []
                at += [row] * len(found)
                rows += found
                while len(rows) >= _ROWS or row == batch.num_rows - 1 and rows:
                    ngram, tf = zip(*rows[:_ROWS], strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(at[:_ROWS], pa.int64())), "ngram": pa.array(ngram, pa.string()), "tf": pa.array(tf, pa.int64())})
                    at, rows = at[_ROWS:], rows[_ROWS:]

    def counted(rows: DataFrame, most: int | None) -> DataFrame:
        return rows.select("doc_id", "text").mapInArrow(lambda batches: count(batches, most), f"doc_id {dict(docs.dtypes)['doc_id']}, ngram string, tf bigint")

    shared = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("shared"))
    if shared.isEmpty():
        return counted(docs, most)
    same = F.col("doc_id").eqNullSafe(F.col("shared"))
    added = counted(docs.join(shared, same, "left_semi"), None).groupBy("doc_id", "ngram").agg(F.sum("tf").alias("tf"))
    return counted(docs.join(shared, same, "left_anti"), most).unionByName(added if most is None else top(added, [F.desc("tf"), "ngram"], most).drop("rank"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similarity_rank(vectors: DataFrame, n: int) -> DataFrame:
    """Within each label the n vectors nearest to the label's mean."""
    mean = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centre"))
    scored = vectors.join(mean, "label").select("label", "vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))
    return top(scored, [F.desc("similarity"), "vec_id"], n, "label")


def mmr_select(vectors: DataFrame, k: int = 5, diversity: float = 0.5, candidates: int = 50) -> DataFrame:
    """Per label k vectors, each near the label's mean and far from those chosen; from the nearest `candidates` only."""
    pool = similarity_rank(vectors, candidates).join(vectors.select("vec_id", "embedding"), "vec_id").select("label", "vec_id", "similarity", "embedding")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf.embedding.to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        between, near = v @ v.T, pdf.similarity.to_numpy()
        chosen = [0]
        while len(chosen) < min(k, len(pdf)):
            gain = (1 - diversity) * near - diversity * between[:, chosen].max(axis=1)
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        return pd.DataFrame({"label": pdf.label[chosen].to_numpy(), "rank": range(1, len(chosen) + 1), "vec_id": pdf.vec_id[chosen].to_numpy()})

    return pool.groupBy("label").applyInPandas(choose, "label int, rank int, vec_id bigint")


def overlap_chunks(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, start, end): windows that end after the last full stop, else line end, of their second half."""
    step = f"""
      aggregate(sequence(0, CAST(length(text) / {size // 2 - overlap} AS INT) + 1), named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRUCT<s: INT, e: INT>>)),
        (st, i) -> IF(st.at < 0, st, aggregate(array(1), st, (acc, one) -> named_struct(
          'at', IF(E >= length(text), -1, greatest(E - {overlap}, st.at + 1)), 'out', concat(st.out, array(named_struct('s', st.at, 'e', E)))))),
        st -> st.out)"""
    window = f"substring(text, st.at + 1, {size})"
    stop = lambda mark: f"(length({window}) - locate('{mark}', reverse({window})) + 1)"
    has = lambda mark: f"locate('{mark}', {window}) > 0 AND {stop(mark)} > {size // 2}"
    end = f"IF(st.at + {size} >= length(text), length(text), CASE WHEN {has('.')} THEN st.at + {stop('.')} WHEN {has(chr(10))} THEN st.at + {stop(chr(10))} ELSE st.at + {size} END)"
    return docs.select("doc_id", F.posexplode(F.expr(step.replace("E >=", f"({end}) >=").replace("(E -", f"(({end}) -").replace("'e', E", f"'e', {end}"))).alias("chunk", "c")).select("doc_id", "chunk", F.col("c.s").alias("start"), F.col("c.e").alias("end"))
