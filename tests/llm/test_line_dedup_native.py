"""Line dedup in DataFrame operations alone, against brute force."""

import random

from corpusmill.llm import line_dedup

STEPS = ("MapInArrow", "PythonUDF", "MapInPandas", "ArrowEval", "BatchEval")


def brute(rows):
    seen, out = [], {}
    for doc, text in sorted(rows):
        out[doc] = []
        for n, line in enumerate((text or "").split("\n")):
            words = set(line.encode().split())
            if words and any(len(words & w) * 5 >= len(words | w) * 4 for w in seen):
                out[doc].append(n)
            if words:
                seen.append(words)
    return out


def test_line_dedup_runs_no_python_and_matches_brute_force(make_docs, monkeypatch):
    r, rows = random.Random(5), []
    common, gaps = [f"c{i}" for i in range(30)], [" ", " ", " ", "  ", "\t", "\x0b", "\r", "\x0c "]
    for doc in range(60):
        lines = []
        for _ in range(4):
            words = [r.choice(common) if r.random() < 0.6 else f"w{r.randrange(4000)}" for _ in range(r.choice([1, 4, 5, 9, 30, 160]))]
            if rows and r.random() < 0.5:
                words = r.choice(rows[-1][1].split("\n")).split() or words
                words = [w if r.random() < 0.93 else f"n{r.randrange(99)}" for w in words]
            lines.append(r.choice(["", " "]) + "".join(w + r.choice(gaps) for w in words))
        rows.append((doc, "\n".join([*lines, " " if doc % 3 else "Ünï\u00a0x y z q w"])))
    plans, written = [], line_dedup.common.written

    def noted(df, label, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, label, **options)

    monkeypatch.setattr(line_dedup.common, "written", noted)
    found = line_dedup.dedup_lines(make_docs(rows))
    assert {x.doc_id: x.removed for x in found.collect()} == brute(rows)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert not [step for step in STEPS for plan in plans if step in plan]


def test_long_lines_without_likeness_are_no_pairs(make_docs):
    """Lines of 100 tokens that share a third of them fill 64 bits set by any token, which then tell nothing; parity bits do."""
    r, threshold = random.Random(1), line_dedup.THRESHOLD
    texts = make_docs([(i, " ".join({f"c{r.randrange(150)}" for _ in range(55)} | {f"w{i} {k}" for k in range(60)})) for i in range(40)]).selectExpr("doc_id doc", "text")
    sets = line_dedup.line_keys(texts, line_dedup.token_steps(texts), threshold).selectExpr("*", "true open")
    assert line_dedup.candidate_pairs(sets, threshold).count() == 0


def test_near_copies_with_rare_tokens_of_their_own_make_no_square_of_pairs(make_docs, monkeypatch):
    """The four rarest tokens of each copy are in one other line alone, so only the tokens that all copies share lead to the first of them."""
    r, base = random.Random(8), [f"c{k}" for k in range(96)]
    copies = [(i, " ".join(r.sample([*base, *(f"own{i}x{k}" for k in range(4))], 100))) for i in range(150)]
    others = [(1000 + i, " ".join([*(f"own{i}x{k}" for k in range(4)), *(f"o{i}x{k}" for k in range(9))])) for i in range(150)]
    made, pairs = [], line_dedup.candidate_pairs

    def counted(sets, threshold):
        made.append(pairs(sets, threshold).count())
        return pairs(sets, threshold)

    monkeypatch.setattr(line_dedup, "candidate_pairs", counted)
    found = line_dedup.dedup_lines(make_docs([*copies, *others])).collect()
    assert {x.doc_id: x.removed for x in found} == brute([*copies, *others])
    assert made[0] < 300


def test_sets_are_shuffled_once_by_token_for_the_first_pairs(make_docs):
    """A join of all sets with the first ones took two shuffles by token, with an aggregate between them."""
    texts = make_docs([(i, f"a b c d e f g h i j {i % 7}") for i in range(20)]).selectExpr("doc_id doc", "text")
    sets = line_dedup.line_keys(texts, line_dedup.token_steps(texts), line_dedup.THRESHOLD)
    plan = line_dedup.first_pairs(sets, line_dedup.THRESHOLD)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(digest") == 1


def test_similar_sets_meet_at_their_first_shared_tokens_alone(make_docs):
    """30 tokens of 31: of the prefix's 7, those after the fourth leave fewer tokens than similar sets share."""
    r, base = random.Random(3), [f"c{k}" for k in range(30)]
    rows = [(i, " ".join(r.sample([*base, f"own{i}"], 31))) for i in range(12)]
    texts = make_docs(rows).selectExpr("doc_id doc", "text")
    sets = line_dedup.line_keys(texts, line_dedup.token_steps(texts), line_dedup.THRESHOLD).selectExpr("*", "true open")
    pairs = line_dedup.candidate_pairs(sets, line_dedup.THRESHOLD)
    assert pairs.count() == 66
    joined = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "least(abs(left" in joined


def test_open_sets_are_those_not_gone(make_docs, spark):
    sets = spark.range(500).selectExpr("id doc", "cast(id % 3 as int) line_no")
    gone = sets.filter("doc % 5 = 0")
    found = line_dedup.with_open(sets, gone).collect()
    assert len(found) == 500 and all(x.open == (x.doc % 5 != 0) for x in found)
