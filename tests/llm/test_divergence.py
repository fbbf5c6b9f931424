"""The source divergence audit against exact counts by hand, and the perfect hash it stands on."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusmill.llm import divergence
from corpusmill.llm.perfect_hash import PerfectHash, Shard

LONG = "straße " * 20_000
ROWS = [
    (1, "The cat, the CAT", "en", "a"), (2, "the dog's cat", "en", "a"), (2, "the dog's cat", "en", "a"), (3, "The dog; a cat", "en", "b"), (4, None, "en", "c"), (5, "", None, None), (6, LONG, "de", "a"), (7, "Straße STRASSE", "de", ""),
    (8, "straße über", "de", "b"), (9, "x", "fr", "a"), (10, "x x", "fr", "b"), (11, "x", None, "a"), (12, "x", "", "b"), (13, "x", "", None), (None, "Éa éa a b", "en", "b"), (14, "éa Éa Éa", "en", "a"), (15, "Éa", "en", None),
]


def by_hand(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(upper))) for _, t, la, s in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), {(la, s) for la, s, _ in docs}
    for la, _, terms in docs:
        df[la].update(set(terms))
    kept = {la: {t for t, n in c.items() if n >= 3} for la, c in df.items()}
    for la, s, terms in docs:
        counts[la, s].update(t for t in terms if t in kept[la])
    p = lambda c, n, v: 1 + 1_000_000_000 * (c + 1) // (n + v)
    out = []
    for la, s in groups:
        v, mine, all_of = len(kept[la]), counts[la, s], sum((counts[x] for x in groups if x[0] == la), Counter())
        pair = []
        for other in (x for x in groups if x[0] == la and x[1] != s):
            theirs, value = counts[other], 0
            for t in kept[la]:
                a, b = p(mine[t], mine.total(), v), p(theirs[t], theirs.total(), v)
                value += (a - b) ** 2 // b
            pair.append((-value, other[1]))
        term = []
        for t in mine:
            a, b = p(mine[t], mine.total(), v), p(all_of[t], all_of.total(), v)
            if a > b:
                term.append((-((a - b) ** 2 // b), t))
        for part, found in (("pair", sorted(pair)), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:200])):
            out += [(la, s, part, item, -f, r) for r, (f, item) in enumerate(found, 1)]
    return sorted(out)


SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, term int"


@pytest.mark.parametrize(("broadcast", "shard_terms"), [(10_000, 50_000), (10_000, 2), (0, 2)])
def test_by_hand(spark, broadcast, shard_terms):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)
    assert sorted(tuple(r) for r in divergence.divergence(docs, broadcast, shard_terms).collect()) == by_hand(ROWS)


def test_many_terms_are_cut_at_200_with_ties(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "klm" for b in "éab" for c in map(chr, range(97, 123))] + [f"z{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=150)), "en", f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    found = sorted(tuple(r) for r in divergence.divergence(docs, 10_000, 100).collect())
    assert found == by_hand(rows) and max(r[5] for r in found) == 200


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts_stay_exact():
    counts, total = np.array([1, 7 * 10**14, 9 * 10**14], np.int64), 10**15 - 3
    assert divergence.scaled(counts, total).tolist() == [1 + 10**9 * int(c) // total for c in counts]


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 5000):
        hashes = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        found = PerfectHash.build(hashes).slots(hashes)
        assert sorted(found.tolist()) == list(range(len(hashes)))


def test_shard_tells_strangers_and_clashing_keys_apart():
    keys = [b"a", b"b", b"c", b"d"]
    sizes, words, stored, clashing = Shard.pack(keys, np.array([5, 5, 9, 5], np.uint64))
    assert clashing == 2 and sorted(stored) == keys
    shard = Shard(sizes, words, stored, clashing)
    asked = np.array([*keys, b"e", b"f"], object)
    slots = shard.find(asked, np.array([5, 5, 9, 5, 5, 77], np.uint64))
    assert sorted(slots[:4].tolist()) == [0, 1, 2, 3] and slots[4:].tolist() == [-1, -1]
    assert [stored[s] for s in slots[:4]] == keys
