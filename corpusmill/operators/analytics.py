"""Aggregations over keyword occurrences (doc_id, keyword, extractor, score, category) and their files and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(keyword: Column | str = "keyword") -> Column:
    return F.lower(F.trim(keyword))


def mean(value: Column) -> Column:
    """A mean cut to three decimals; sums in another order give the same."""
    return F.floor(value * 1000 + 1e-6) / 1000


def joined(set_of: Column) -> Column:
    """A set as sorted text."""
    return F.concat_ws(",", F.array_sort(F.collect_set(set_of)))


def with_files(occ: DataFrame, docs: DataFrame) -> DataFrame:
    """Occurrences with their project; occurrences of unknown files drop out."""
    return occ.join(docs.select("doc_id", F.col("source").alias("project")), "doc_id")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the same file and extractor as any new row give way to the new rows."""
    keys = new.select("doc_id", "extractor").distinct()
    return old.join(keys, ["doc_id", "extractor"], "left_anti").select(*new.columns).unionByName(new)


def global_stats(occ: DataFrame, docs: DataFrame) -> DataFrame:
    files = docs.agg(F.countDistinct("source").alias("projects"), F.count(F.lit(1)).alias("files"))
    words = occ.agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(norm()).alias("keywords"), joined(F.col("extractor")).alias("extractors"))
    return files.join(F.broadcast(words), F.lit(True))  # one row each


def project_stats(occ: DataFrame, docs: DataFrame) -> DataFrame:
    left = docs.select("doc_id", F.col("source").alias("project")).join(occ, "doc_id", "left")
    return left.groupBy("project").agg(F.countDistinct("doc_id").alias("files"), F.count("keyword").alias("occurrences"), F.countDistinct(norm()).alias("keywords"), joined(F.col("extractor")).alias("extractors"))


def all_stats(occ: DataFrame, docs: DataFrame) -> DataFrame:
    """The row of each project and one of all of them, in one pass."""
    rolled = with_files(occ, docs).rollup("project").agg(F.grouping("project").alias("all_projects"), F.count(F.lit(1)).alias("occurrences"), F.countDistinct(norm()).alias("keywords"), F.countDistinct("doc_id").alias("files"))
    return rolled.withColumn("all_projects", F.col("all_projects").cast("int"))


def keyword_stats(occ: DataFrame) -> DataFrame:
    return occ.groupBy("keyword").agg(joined(F.col("extractor")).alias("extractors"), F.greatest(F.max("score"), F.lit(0.0)).alias("max_score"), F.count(F.lit(1)).alias("occurrences"), joined(F.col("category")).alias("categories"), F.countDistinct("doc_id").alias("files"))


def extractor_stats(occ: DataFrame, *more: Column) -> DataFrame:
    return occ.groupBy("extractor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("keyword").alias("keywords"), mean(F.avg("score")).alias("mean_score"), *more)


def category_stats(occ: DataFrame, *more: Column) -> DataFrame:
    named = occ.filter("category IS NOT NULL AND trim(category) <> ''")
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("keyword").alias("keywords"), *more)


def projects_overview(occ: DataFrame, docs: DataFrame) -> DataFrame:
    return with_files(occ, docs).groupBy("project").agg(
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("doc_id").alias("files"), F.countDistinct("keyword").alias("keywords"), mean(F.avg("score")).alias("mean_score"), joined(F.col("extractor")).alias("extractors"), joined(F.col("category")).alias("categories")
    )


def top_per_project(occ: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    counts = with_files(occ, docs).groupBy("project", "keyword").agg(F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("project").orderBy(F.desc("max_score"), F.desc("n"), "keyword")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def page(occ: DataFrame, docs: DataFrame, condition: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of filtered occurrences by falling score."""
    return with_files(occ, docs).filter(condition).orderBy(F.desc("score"), "doc_id", "keyword", "extractor").offset(offset).limit(limit)


def rollup(occ: DataFrame) -> DataFrame:
    """Per keyword in any case and extractor."""
    return occ.groupBy(norm().alias("norm"), "extractor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("files"), F.max("score").alias("max_score"), mean(F.avg("score")).alias("mean_score"))


def unified(occ: DataFrame) -> DataFrame:
    """Per keyword in any case, its extractors from the best down."""
    parts = occ.groupBy(norm().alias("norm"), "extractor").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("m"), F.sum("score").alias("s"))
    by_best = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("o"), "extractor", "n")))
    found = parts.groupBy("norm").agg(by_best.alias("e"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    return found.select("norm", F.array_join(F.transform("e", lambda x: F.concat(x["extractor"], F.lit(":"), x["n"].cast("string"))), ",").alias("extractors"), "n", mean(F.col("mean")).alias("mean_score"))


def several_extractors(occ: DataFrame) -> DataFrame:
    """Occurrences whose keyword another extractor found in the same file too."""
    w = Window.partitionBy("keyword", "doc_id")
    return occ.withColumn("found_by", F.concat_ws(",", F.array_sort(F.collect_set("extractor").over(w)))).withColumn("several", F.col("found_by").contains(","))


def extractor_top(occ: DataFrame, names: list[str], n: int = 5) -> DataFrame:
    """The best rows of each named extractor; one without rows appears once, empty."""
    w = Window.partitionBy("extractor").orderBy(F.desc("score"), "doc_id", "keyword")
    best = occ.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    asked = occ.sparkSession.createDataFrame([(x,) for x in names], "extractor string")
    return F.broadcast(asked).join(best, "extractor", "left").select("extractor", "rank", "doc_id", "keyword", "score")
