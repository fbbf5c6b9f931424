"""Streaming jobs against the batch operators, with documents that come again."""

from pyspark.sql import functions as F

from corpusmill.operators import keywords
from corpusmill.streaming import jobs

METHODS = ["simple", "pattern"]


def rows_of(df):
    return {tuple(r) for r in df.select("doc_id", "keyword", "extractor").collect()}


def arrive(docs, folder, n):
    docs.coalesce(1).write.parquet(f"{folder}/part{n}")


def test_a_document_that_comes_again_counts_once(spark, make_docs, tmp_path):
    one = make_docs([(i, f"Alpha beta gamma alpha number{i}") for i in range(20)])
    two = make_docs([(3, "Delta epsilon"), (4, ""), (50, "Alpha omega")])
    now = one.filter("doc_id NOT IN (3, 4)").unionByName(two)
    for n, docs in enumerate((one, two, two)):
        arrive(docs, f"{tmp_path}/in", n)
        stream = spark.readStream.schema(jobs.DOCUMENT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        jobs.stream_upsert(stream, f"{tmp_path}/occ", f"{tmp_path}/c1").awaitTermination()
        jobs.stream_stats(stream, f"{tmp_path}/counts", f"{tmp_path}/c2").awaitTermination()
        assert rows_of(jobs.latest(spark, f"{tmp_path}/occ")) == rows_of(keywords.multi_extract(one if n == 0 else now, METHODS))
    totals = {r.keyword: (r.n, r.documents) for r in jobs.totals(spark, f"{tmp_path}/counts").collect()}
    assert totals["alpha"] == (18 * 2 + 1, 19) and totals["delta"] == (1, 1) and "number4" not in totals


def test_a_repeated_batch_counts_once_and_old_versions_go(spark, make_docs, tmp_path):
    table = f"{tmp_path}/t"
    write = lambda docs, n: jobs.replace_slices(docs, docs.select("doc_id", F.col("text").alias("keyword"), F.lit(1).cast("bigint").alias("n")), table, n, 1)
    state = lambda: sorted((r.doc_id, r.keyword) for r in jobs.latest(spark, table, jobs.COUNTS).collect())
    write(make_docs([(1, "a"), (2, "b")]), 0)
    for _ in range(2):
        write(make_docs([(2, "c"), (3, "d")]), 1)
        assert state() == [(1, "a"), (2, "c"), (3, "d")]
    write(make_docs([]), 2)
    write(make_docs([(1, "e")]), 3)
    assert state() == [(1, "e"), (2, "c"), (3, "d")]
    assert not list(tmp_path.glob("t/rows/batch=0/bucket=*")) and list(tmp_path.glob("t/rows/batch=1/bucket=*"))


def test_files_become_rows(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo", encoding="utf-8")
    (folder / "b.txt").write_bytes(b"bad \xff byte")
    (folder / "c.exe").write_bytes(b"no")
    query = jobs.stream_files(spark, str(folder)).writeStream.format("memory").queryName("files_seen").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {r.path.rsplit("/", 1)[1]: (r.text, r.parse_status) for r in spark.table("files_seen").collect()}
    assert found == {"a.txt": ("one\ntwo", "success"), "b.txt": ("bad \ufffd byte", "failed")}
