"""Top-k search where ids repeat."""

import math

from corpusmill.llm import topk


def test_repeated_ids_are_queries_and_candidates_of_their_own(spark):
    vectors = [(100, [1.0, 0.0]), (100, [0.9, 0.1]), (200, [0.5, 0.5]), (200, [0.5, 0.5]), *((i, [math.sin(i), math.cos(i)]) for i in range(1, 40)), (7, [2.0, 2.0])]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id bigint, embedding array<double>, row string, length int")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors]
    expected = []
    for n, (q, v) in enumerate(whole):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(whole) if m != n)[:10]
            expected += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(expected)
