"""Rules that trim each line or sentence: spaces go from its ends, digits never."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.plans import registry
from corpusmill.sources import files

LINES = ["0 apples and 7 pears 0", "  1 apple 1", "\u00a02 plums for two 2\u3000", "3", "", "   ", "5 pears, five 5 ", "6", "7", "8", "  9 figs", "1101 nuts 10"]
TEXTS = {
    1: "\n".join(LINES), 2: "\n".join(LINES[::-1]), 3: "012345678 in all 10", 4: "", 5: "  \n\u00a0\n", 6: None,
    7: " ".join(f"{i} sentences end here {i}." for i in range(60)), 8: "0! 1! 2! \u00a0 \u30003! " + "some words. 10 " * 80,
    9: "\n".join(f"  line {i} of a long text, with more than a hundred characters in it, so that only its first hundred are kept {i}  " for i in range(12)),
}


@pytest.fixture(scope="module")
def folder(make_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trimmed"))
    make_docs(list(TEXTS.items())).coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return path


def check(spark, folder, name):
    found = registry.QUERIES[name](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    columns = sorted(found.columns)
    expected = duck.sql(registry.ORACLES[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    rows = {r["doc_id"]: tuple(r) for r in found.select(*columns).collect()}
    assert rows == {r[columns.index("doc_id")]: r for r in expected}
    return {d: dict(zip(columns, r, strict=True)) for d, r in rows.items()}


def test_fallback_title(spark, folder):
    found = check(spark, folder, "d24_fallback_metadata")
    assert found[1]["title"] == "0 apples and 7 pears 0" and found[2]["title"] == "1101 nuts 10" and found[3]["title"] == "012345678 in all 10"
    assert found[4]["title"] is found[5]["title"] is found[6]["title"] is None


def test_reflow(spark, folder):
    found = check(spark, folder, "e06_reflow_single_line")
    assert found[7]["value"].split("\n")[:13] == [f"{i} sentences end here {i}." for i in range(13)]
    assert found[8]["value"].startswith("0!\n1!\n2!\n3!\nsome words.\n10 some words.\n10 ") and found[8]["value"].endswith("\n10")


def test_chunk_summary(spark, folder):
    found = check(spark, folder, "f08_chunk_summary")
    assert found[1]["intro"] == "0 apples and 7 pears 0" and found[1]["conclusion"] == "1101 nuts 10" and found[1]["lines"] == 10
    assert found[5]["lines"] == 0 and found[9]["intro"].startswith("line 0 of") and len(found[9]["conclusion"]) == 103


def test_text_to_markdown(spark, folder):
    found = check(spark, folder, "a08_text_to_markdown")
    lines = found[1]["md"].split("\n")
    assert lines[0] == "## 2.2 Title" and lines[1:4] == ["# 0 apples and 7 pears 0", "# 1 apple 1", "# 2 plums for two 2"] and lines[4] == "3"
    assert found[6]["md"] == "## 7.2 Title\n"
    rows = spark.createDataFrame([("1.2.3 x\n10.20.30.40 y\n1.2.3.4.5.6.7 z\n| 1 |\n - a ",)], "text string")
    assert rows.select(files.text_to_markdown(F.col("text"))).first()[0] == "### 1.2.3 x\n#### 10.20.30.40 y\n###### 1.2.3.4.5.6.7 z\n| 1 |\n - a "
