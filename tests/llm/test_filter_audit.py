"""The filter audit against all orders walked row by row."""

import itertools
import re
from collections import Counter

from corpusmill.llm import filter_audit

LONG = "word other third " * 30_000
WORDS = " ".join(f"w{i}" for i in range(300))
ROWS = [(1, WORDS), (2, WORDS), (2, WORDS), (3, None), (4, ""), (5, LONG), (6, "A B C #"), (None, WORDS), (None, ""), (7, WORDS + " %"), (8, WORDS + " x" * 400), (9, WORDS.upper()), (0, "A B C #"), (10, "über ß | a")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (6, 0, 1), (9, 1, None), (99, 1, 1), (None, 1, 1)]


def by_hand(rows, labels):
    text = [t or "" for _, t, _ in rows]
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    fails = []
    for k, (i, _, _) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text[k])
        copy = i is not None and any(j is not None and j < i and text[x] == text[k] for x, (j, _, _) in enumerate(rows))
        fails.append({x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text[k])) > 2 * len(text[k]), re.search(r"[#$%&*|]", text[k]), copy)) if bad})
    out, shares = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p or "" for _, _, p in rows}:
            left = [k for k, r in enumerate(rows) if (r[2] or "") == part]
            for s, x in enumerate(order, 1):
                gone = [k for k in left if x in fails[k]]
                mine = [k for k, r in enumerate(rows) if (r[2] or "") == part and x in fails[k]]
                left = [k for k in left if x not in fails[k]]
                shares[part, x] += len(gone)
                out[part, order, s] = [len(left), len(gone), len(mine) - len(gone), sum(len(fails[k]) == 1 for k in mine), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
    return {(*key, *v, shares[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_every_order(spark):
    rows = [(i, t, ("a", "b", None, "")[k % 4]) for k, (i, t) in enumerate(ROWS)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, part string, mask int")
    labels = spark.createDataFrame([(*r, "y") for r in LABELS], "doc_id bigint, quality int, toxic int, text string")
    found = [tuple(r) for r in filter_audit.filter_audit(docs, labels).collect()]
    assert len(found) == len(set(found)) == 3 * 120 * 5
    assert set(found) == by_hand(rows, LABELS)


def test_empty_tables(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.filter_audit(make_docs([]), labels).count() == 0
    rows = filter_audit.filter_audit(make_docs([(1, "a")]), labels).collect()
    assert len(rows) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in rows)
    assert {r.kept for r in rows if r.step == 5} == {0} and {r.shapley for r in rows} == {0, 120}


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 1, 4, 1, 0), ("p", 3, 2, 0, 2), ("p", 0, 7, 0, 0)], "part string, mask int, n bigint, good bigint, toxic bigint")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.interactions(cells, "XY").collect()}
    assert found == {("XY", 1): (7, 6, 0, 4, 10), ("XY", 2): (7, 0, 2, 0, 2), ("YX", 1): (11, 2, 0, 0, 2), ("YX", 2): (7, 4, 2, 4, 10)}
