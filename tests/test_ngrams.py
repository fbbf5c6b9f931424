"""N-grams of documents against the SQL, and that none is shuffled."""

import random

import duckdb

from corpusmill.functions import text as t
from corpusmill.operators import keywords
from corpusmill.plans import registry

NAME = "d04_ngram_candidates"


def check(spark, folder, rows):
    rows.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = registry.QUERIES[NAME](spark, str(folder))
    assert found.columns == ["doc_id", "ngram", "tf"]
    expected = sorted(duck.sql(registry.ORACLES[NAME]).select("doc_id", "ngram", "tf").fetchall(), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected and expected
    return found


def texts():
    rng = random.Random(4)
    words = [*(f"w{i}" for i in range(900)), *(w for w in t.STOP_WORDS[:20]), "A", "é", "ÉTÉ", "데이터", "x_1", "½", "Ⅷb", "ΟΔΟΣ", "ΣΑΣ,", "İSTİNYE", "ǅungla", "\U0002EBF0\U0002EBF1", "ab\U0002EC00cd", "éé"]
    return [" ".join(rng.choice(words) for _ in range(n)) for n in (5000, 3000, 1500, 600, 2, 1)] + ["", None, "a b c", "the and", "\n\n", "same same same same"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_ngram_is_shuffled(spark, make_docs, tmp_path):
    found = check(spark, tmp_path, make_docs(list(enumerate(texts()))))
    assert "Exchange" not in plan(found) and "MapInArrow" in plan(found)
    per_document = {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert per_document[0] == per_document[1] == 1000 and per_document[4] <= 3


def test_rows_that_share_an_id_are_one_document(spark, make_docs, tmp_path):
    check(spark, tmp_path, make_docs([(None if i % 5 == 4 else i % 5, x) for i, x in enumerate(texts() + texts()[3:])]))


def test_batches_that_leave_a_task(spark, make_docs, monkeypatch):
    """A batch of results ends within a document, and null texts come last."""
    monkeypatch.setattr(keywords, "_ROWS", 7)
    rows = [(1, "red blue green white black grey"), (2, None), (3, "red blue red blue"), (4, " ".join(f"w{i}" for i in range(40))), (5, None)]
    found = [tuple(r) for r in keywords.ngrams(make_docs(rows).coalesce(1)).collect()]
    assert len(found) == 11 + 4 + 79 and len(set(found)) == len(found)
    assert {x for x in found if x[0] == 3} == {(3, "red", 2), (3, "blue", 2), (3, "red blue", 2), (3, "blue red", 1)}
    assert {x[0] for x in keywords.ngrams(make_docs(rows), 3).filter("ngram = 'white black grey'").collect()} == {1}
