"""Queries over keyword occurrences and run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as t
from corpusmill.operators import analytics as a
from corpusmill.operators import keywords as k

from .extraction import D_COUNTED, D_OCC, occurrences
from .texts import d_words, docs

ALL: dict = {}


def add(name: str, run, sql: str = "") -> None:
    ALL[name] = (run, sql)


def over(name: str, run, sql: str) -> None:
    """A query over the occurrences of the documents."""
    add(name, lambda s, d: run(occurrences(s, d), docs(s, d)), f"WITH {D_OCC}, of AS (SELECT occ.*, source AS project FROM occ JOIN documents USING (doc_id)) {sql}")


D_SET = "coalesce(string_agg(DISTINCT {x}, ',' ORDER BY {x}), '')"


def d_set(x: str) -> str:
    return D_SET.format(x=x)


over("a09_occurrence_upsert", lambda o, d: a.upsert(o, o.filter("extractor = 'freq' AND doc_id % 2 = 0").withColumn("score", F.col("score") * 2)), "SELECT doc_id, keyword, extractor, CASE WHEN extractor = 'freq' AND doc_id % 2 = 0 THEN score * 2 ELSE score END AS score, category FROM occ")
over("g01_global_stats", a.global_stats, f"SELECT (SELECT count(DISTINCT source) FROM documents) AS projects, (SELECT count(*) FROM documents) AS files, count(*) AS occurrences, count(DISTINCT lower(trim(keyword))) AS keywords, {d_set('extractor')} AS extractors FROM occ")
over("g02_project_stats", a.project_stats, f"SELECT source AS project, count(DISTINCT d.doc_id) AS files, count(keyword) AS occurrences, count(DISTINCT lower(trim(keyword))) AS keywords, {d_set('extractor')} AS extractors FROM documents d LEFT JOIN occ ON d.doc_id = occ.doc_id GROUP BY source")
over("g03_refresh_all_stats", a.all_stats, "SELECT project, CAST(grouping(project) AS INT) AS all_projects, count(*) AS occurrences, count(DISTINCT lower(trim(keyword))) AS keywords, count(DISTINCT doc_id) AS files FROM of GROUP BY ROLLUP (project)")
add("g04_stats_staleness", lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("last")).filter(F.col("last") < F.expr("TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTES")).select("user_id"), "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE")
_KS = f"SELECT keyword, {d_set('extractor')} AS extractors, greatest(max(score), 0.0) AS max_score, count(*) AS occurrences, {d_set('category')} AS categories, count(DISTINCT doc_id) AS files"
over("g05_project_keywords", lambda o, d: a.keyword_stats(a.with_files(o, d).filter("project = 'src1'")), f"{_KS} FROM of WHERE project = 'src1' GROUP BY keyword")
over("g06_file_keywords", lambda o, d: o.withColumn("total", F.count(F.lit(1)).over(a.Window.partitionBy("doc_id"))), "SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM occ")
over("g07_keyword_stats_project", lambda o, d: a.keyword_stats(o), f"{_KS} FROM occ GROUP BY keyword")
over("g08_extractor_stats", lambda o, d: a.extractor_stats(o), "SELECT extractor, count(*) AS n, count(DISTINCT keyword) AS keywords, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean_score FROM occ GROUP BY extractor")
over("g09_category_stats", lambda o, d: a.category_stats(o), "SELECT category, count(*) AS n, count(DISTINCT keyword) AS keywords FROM occ WHERE category IS NOT NULL GROUP BY category")
over("g10_project_summary", lambda o, d: a.with_files(o, d).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("keyword").alias("keywords"), F.countDistinct("extractor").alias("extractors"), F.countDistinct("category").alias("categories")), "SELECT project, count(*) AS n, count(DISTINCT keyword) AS keywords, count(DISTINCT extractor) AS extractors, count(DISTINCT category) AS categories FROM of GROUP BY project")
over("g11_projects_overview", a.projects_overview, f"SELECT project, count(*) AS occurrences, count(DISTINCT doc_id) AS files, count(DISTINCT keyword) AS keywords, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean_score, {d_set('extractor')} AS extractors, {d_set('category')} AS categories FROM of GROUP BY project")
over("g12_top_keywords_per_project", a.top_per_project, "SELECT project, keyword, max(score) AS max_score, count(*) AS n, row_number() OVER (PARTITION BY project ORDER BY max(score) DESC, count(*) DESC, keyword) AS rank FROM of GROUP BY project, keyword QUALIFY rank <= 5")
over("g13_global_keywords", lambda o, d: a.with_files(o, d).groupBy("keyword").agg(F.countDistinct("project").alias("projects"), F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("max_score"), F.desc("n"), "keyword").limit(50), "SELECT keyword, count(DISTINCT project) AS projects, max(score) AS max_score, count(*) AS n FROM of GROUP BY keyword ORDER BY max_score DESC, n DESC, keyword LIMIT 50")
over("g14_global_extractors", lambda o, d: a.extractor_stats(a.with_files(o, d), F.countDistinct("project").alias("projects")), "SELECT extractor, count(*) AS n, count(DISTINCT keyword) AS keywords, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean_score, count(DISTINCT project) AS projects FROM of GROUP BY extractor")
over("g15_global_categories", lambda o, d: a.category_stats(a.with_files(o, d), F.countDistinct("project").alias("projects")), "SELECT category, count(*) AS n, count(DISTINCT keyword) AS keywords, count(DISTINCT project) AS projects FROM of WHERE category IS NOT NULL GROUP BY category")
over("g16_keyword_list", lambda o, d: a.page(o, d, F.col("extractor") == "pattern", 100, 200), "SELECT * FROM of WHERE extractor = 'pattern' ORDER BY score DESC, doc_id, keyword, extractor LIMIT 100 OFFSET 200")
over("g17_keyword_extractor_rollup", lambda o, d: a.rollup(o), "SELECT lower(trim(keyword)) AS norm, extractor, count(*) AS n, count(DISTINCT doc_id) AS files, max(score) AS max_score, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean_score FROM occ GROUP BY ALL")
over("g18_unified_keywords", lambda o, d: a.unified(o), "SELECT norm, string_agg(extractor || ':' || n, ',' ORDER BY m DESC, extractor) AS extractors, CAST(sum(n) AS BIGINT) AS n, floor(sum(s) / sum(n) * 1000 + 1e-6) / 1000 AS mean_score FROM (SELECT lower(trim(keyword)) AS norm, extractor, count(*) AS n, max(score) AS m, sum(score) AS s FROM occ GROUP BY ALL) GROUP BY norm")
over("g19_keyword_browse", lambda o, d: a.rollup(o).filter(F.col("norm").contains("th") & (F.col("extractor") == "simple")).orderBy(F.desc("n"), "norm"), "SELECT lower(trim(keyword)) AS norm, extractor, count(*) AS n, count(DISTINCT doc_id) AS files, max(score) AS max_score, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean_score FROM occ WHERE contains(lower(keyword), 'th') AND extractor = 'simple' GROUP BY ALL")
over("g20_keyword_extractor_global", lambda o, d: a.with_files(o, d).groupBy(a.norm().alias("norm"), "extractor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project").alias("projects"), a.joined(F.col("project")).alias("names")), f"SELECT lower(trim(keyword)) AS norm, extractor, count(*) AS n, count(DISTINCT project) AS projects, {d_set('project')} AS names FROM of GROUP BY ALL")
over("g21_keyword_weighted_mean", lambda o, d: o.groupBy(a.norm().alias("norm"), "extractor").agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("n")).groupBy("norm").agg(a.mean(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean_score")), "SELECT lower(trim(keyword)) AS norm, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean_score FROM occ GROUP BY 1")
over("g22_extractor_top5", lambda o, d: a.extractor_top(o, ["freq", "pattern", "absent"]), "SELECT x.extractor, r.rank, doc_id, keyword, score FROM (VALUES ('freq'), ('pattern'), ('absent')) x(extractor) LEFT JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY extractor ORDER BY score DESC, doc_id, keyword) AS INT) AS rank FROM occ QUALIFY rank <= 5) r ON r.extractor = x.extractor")
over("g23_file_keyword_map", lambda o, d: d.select("doc_id").join(o.filter("extractor = 'freq'").groupBy("doc_id").agg(a.joined(F.col("keyword")).alias("keywords")), "doc_id", "left"), "SELECT d.doc_id, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords FROM documents d LEFT JOIN (SELECT * FROM occ WHERE extractor = 'freq') o ON d.doc_id = o.doc_id GROUP BY d.doc_id")
over("g24_multi_extractor_flag", lambda o, d: a.several_extractors(o), "SELECT o.*, found_by, contains(found_by, ',') AS several FROM occ o JOIN (SELECT keyword, doc_id, string_agg(DISTINCT extractor, ',' ORDER BY extractor) AS found_by FROM occ GROUP BY ALL) USING (keyword, doc_id)")
over("g25_multi_field_search", lambda o, d: a.with_files(o, d).filter(F.lower("keyword").contains("ou") | F.lower("project").contains("src7")), "SELECT * FROM of WHERE contains(lower(keyword), 'ou') OR contains(lower(project), 'src7')")
over("g26_keyword_detail", lambda o, d: o.filter(F.length("keyword") == 3).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("files"), a.joined(F.col("extractor")).alias("extractors"), a.mean(F.avg("score")).alias("mean"), F.max("score").alias("top"), F.min("score").alias("low")), f"SELECT keyword, count(*) AS n, count(DISTINCT doc_id) AS files, {d_set('extractor')} AS extractors, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean, max(score) AS top, min(score) AS low FROM occ WHERE length(keyword) = 3 GROUP BY keyword")
over("g27_project_delete", lambda o, d: a.with_files(o, d.filter("source <> 'src3'")).groupBy("project").agg(F.count(F.lit(1)).alias("n")), "SELECT project, count(*) AS n FROM of WHERE project <> 'src3' GROUP BY project")
add("g28_unique_name_check", lambda s, d: docs(s, d).select(F.concat(F.lit("src"), F.col("doc_id") % 40).alias("name")).distinct().join(docs(s, d).select(F.col("source").alias("name")).distinct().withColumn("taken", F.lit(True)), "name", "left").select("name", F.col("taken").isNull().alias("accepted")), "SELECT DISTINCT concat('src', doc_id % 40) AS name, concat('src', doc_id % 40) NOT IN (SELECT source FROM documents) AS accepted FROM documents")
_SECTION_RULES = [("summary", "noun"), ("structure", "misc"), ("statistics", "date")]
over("g29_metadata_sections", lambda o, d: o.join(F.broadcast(o.sparkSession.createDataFrame(_SECTION_RULES, "section string, cue string")), F.lower("category").contains(F.col("cue"))).groupBy("section").agg(F.count(F.lit(1)).alias("n")), "SELECT section, count(*) AS n FROM occ JOIN (VALUES ('summary', 'noun'), ('structure', 'misc'), ('statistics', 'date')) r(section, cue) ON contains(lower(category), cue) GROUP BY section")
over("a14_keyword_csv_export", lambda o, d: a.with_files(o, d).select(F.concat_ws(",", F.concat(F.lit('"'), F.replace("keyword", F.lit('"'), F.lit('""')), F.lit('"')), F.concat(F.lit('"'), "extractor", F.lit('"')), F.concat(F.format_number(F.floor(F.col("score") * 1000 + 0.5) / 10, 1), F.lit("%")), F.concat(F.lit('"'), "project", F.lit('"'))).alias("line")), """SELECT concat_ws(',', concat('"', replace(keyword, '"', '""'), '"'), concat('"', extractor, '"'), printf('%.1f', floor(score * 1000 + 0.5) / 10) || '%', concat('"', project, '"')) AS line FROM of""")
over("e07_analysis_summary", lambda o, d: d.select("doc_id", F.length("text").alias("length")).join(o.groupBy("doc_id").agg(a.joined(F.concat("extractor", F.lit(":"), "keyword")).alias("keywords")), "doc_id", "left"), "SELECT d.doc_id, CAST(length(text) AS INT) AS length, k AS keywords FROM documents d LEFT JOIN (SELECT doc_id, string_agg(DISTINCT extractor || ':' || keyword, ',' ORDER BY extractor || ':' || keyword) AS k FROM occ GROUP BY 1) USING (doc_id)")
# run metrics
_W = lambda: t.words(F.col("text"))
add("h01_text_stats", lambda s, d: docs(s, d).select("doc_id", F.length("text").alias("length"), F.size(_W()).alias("words"), F.size(F.array_distinct(_W())).alias("different"), F.round(F.size(F.array_distinct(_W())) / F.greatest(F.size(_W()), F.lit(1)), 6).alias("diversity")), f"SELECT doc_id, CAST(length(text) AS INT) AS length, CAST(len({d_words('text')}) AS INT) AS words, CAST(len(list_distinct({d_words('text')})) AS INT) AS different, round(len(list_distinct({d_words('text')})) / greatest(len({d_words('text')}), 1), 6) AS diversity FROM documents")
add("h02_candidate_stats", lambda s, d: k.counted_words(docs(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidates"), F.round(F.avg(F.length("keyword")), 6).alias("mean_length")), f"WITH {D_COUNTED} SELECT doc_id, count(*) AS candidates, round(avg(length(keyword)), 6) AS mean_length FROM counted GROUP BY doc_id")
over("h03_similarity_stats", lambda o, d: o.groupBy("extractor").agg(F.count(F.lit(1)).alias("n"), a.mean(F.avg("score")).alias("mean"), F.round(F.stddev_pop("score"), 4).alias("std"), F.min("score").alias("low"), F.max("score").alias("top"), F.round(F.expr("percentile(score, 0.5)"), 6).alias("median")), "SELECT extractor, count(*) AS n, floor(avg(score) * 1000 + 1e-6) / 1000 AS mean, round(stddev_pop(score), 4) AS std, min(score) AS low, max(score) AS top, round(quantile_cont(score, 0.5), 6) AS median FROM occ GROUP BY extractor")
add("h04_selection_stats", lambda s, d: k.counted_words(docs(s, d)).join(k.simple_keywords(docs(s, d)).select("doc_id", "keyword", F.lit(1).alias("chosen")), ["doc_id", "keyword"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("input"), F.count("chosen").alias("output")), f"WITH {D_OCC} SELECT doc_id, count(*) AS input, least(count(*), 10) AS output FROM counted GROUP BY doc_id")
add("h05_position_stats", lambda s, d: k.located(k.freq_keywords(docs(s, d)), docs(s, d)).groupBy("doc_id").agg(F.count("start_position").alias("found"), F.count(F.lit(1)).alias("n"), F.min("start_position").alias("low"), F.max("start_position").alias("top")), f"WITH {D_OCC}, l AS (SELECT doc_id, nullif(strpos(text, keyword) - 1, -1) AS p FROM fr JOIN documents USING (doc_id)) SELECT doc_id, count(p) AS found, count(*) AS n, CAST(min(p) AS INT) AS low, CAST(max(p) AS INT) AS top FROM l GROUP BY doc_id")
add("h06_run_log_summary", lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.get_json_object("props", "$.k").cast("int") < 50).alias("ok"), F.round(F.avg("value"), 3).alias("mean_value")), "SELECT user_id, count(*) AS runs, CAST(count_if(CAST(json_extract_string(props, '$.k') AS INT) < 50) AS BIGINT) AS ok, round(avg(value), 3) AS mean_value FROM events GROUP BY user_id")
