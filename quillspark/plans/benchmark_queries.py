"""Queries over the benchmark store with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark as b
from .fixtures import oracle, view

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = oracle(sql)


def results(spark, d):
    return view(spark, d, "v_results")


#: Language dimension of the fixtures: two known codes, the others fall back.
def languages(spark):
    return spark.createDataFrame([("en", "English", "european_major", False), ("fr", "French", "european_major", False), ("es", "Spanish", "romance", False)], "code string, name string, category string, is_rtl boolean")


DIM = "dim(code, name, category, is_rtl) AS (VALUES ('en','English','european_major',false),('fr','French','european_major',false),('es','Spanish','romance',false))"
OK = "error IS NULL AND coalesce(translated_text, '') <> ''"
SC = f"{OK} AND overall IS NOT NULL"
AVGS = ", ".join(f"coalesce(avg({s}) FILTER ({SC}), 0.0) AS avg_{s}" for s in b.SCORES)


add("f1_success", lambda s, d: results(s, d).where(b.success()).select("ord", "model"), f"SELECT ord, model FROM v_results WHERE {OK}")
add("f19_score_band", lambda s, d: results(s, d).where("overall IS NOT NULL").select("ord", b.band(F.col("overall")).alias("band")),
    "SELECT ord, CASE WHEN overall>=9 THEN 'excellent' WHEN overall>=7 THEN 'good' WHEN overall>=5 THEN 'acceptable' WHEN overall>=3 THEN 'poor' ELSE 'failed' END AS band FROM v_results WHERE overall IS NOT NULL")
add("a1_model_stats", lambda s, d: b.model_stats(results(s, d)).withColumn("band", b.band(F.col("avg_overall"))),
    f"SELECT *, CASE WHEN avg_overall>=9 THEN 'excellent' WHEN avg_overall>=7 THEN 'good' WHEN avg_overall>=5 THEN 'acceptable' WHEN avg_overall>=3 THEN 'poor' ELSE 'failed' END AS band FROM (SELECT model, count(*) AS total, count(*) FILTER ({SC}) AS successful, {AVGS} FROM v_results GROUP BY model)")
BEST = """
, p AS (SELECT {key}, {other}, avg(overall) AS mean, min(ord) AS seen FROM v_results WHERE {ok} GROUP BY 1, 2),
e AS (SELECT {key}, arg_max({other}, row(mean, -seen)) AS best_{other}, arg_min({other}, row(mean, seen)) AS worst_{other} FROM p GROUP BY 1)
"""


def best(key, other, ok):
    return BEST.format(key=key, other=other, ok=ok)


def oracle_more(ctes: str, body: str) -> str:
    """Further table expressions after the views that they and the body name."""
    from .fixtures import TABLES, VIEWS

    used = [v for v in VIEWS if v in body or v in ctes]
    made = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES}).strip()})" for v in used]
    return "WITH RECURSIVE " + ",\n".join([*made, ctes.strip().lstrip(",").strip()]) + "\n" + body


def add2(name, query, ctes, body):
    QUERIES[name], ORACLES[name] = query, oracle_more(ctes, body)


add2("a2_language_stats", lambda s, d: b.language_stats(results(s, d)), best("target_language", "model", SC),
     f"SELECT t.*, best_model, worst_model FROM (SELECT target_language, count(*) AS total, count(*) FILTER ({SC}) AS successful, {AVGS} FROM v_results GROUP BY 1) t LEFT JOIN e ON t.target_language = e.target_language")
add2("a3_model_extremes", lambda s, d: b.model_extremes(results(s, d)), best("model", "target_language", "overall IS NOT NULL"), "SELECT * FROM e")
add("a4_run_summary", lambda s, d: b.run_summary(results(s, d)),
    "SELECT count(*) AS total, count(overall) AS with_scores, count(*) - count(overall) AS without_scores, coalesce(avg(overall), 0.0) AS avg_overall, coalesce(min(overall), 0.0) AS min_overall, coalesce(max(overall), 0.0) AS max_overall FROM v_results")
add("a5_run_progress", lambda s, d: b.run_progress(results(s, d)),
    "SELECT total_expected, done, round(CASE WHEN total_expected > 0 THEN done * 100.0::DOUBLE / total_expected ELSE 0 END, 6) AS progress_percent FROM (SELECT CAST(5 * count(DISTINCT model) * count(DISTINCT target_language) AS BIGINT) AS total_expected, count(*) AS done FROM v_results)")
add("a6_histogram", lambda s, d: b.histogram(results(s, d), "target_language"),
    "SELECT target_language, count(*) FILTER (overall >= 9) AS excellent, count(*) FILTER (overall >= 7 AND overall < 9) AS good, count(*) FILTER (overall >= 5 AND overall < 7) AS acceptable, count(*) FILTER (overall >= 3 AND overall < 5) AS poor, count(*) FILTER (overall < 3) AS failed FROM v_results WHERE overall IS NOT NULL GROUP BY 1")
add("a7_pair_means", lambda s, d: b.pair_means(results(s, d)),
    "SELECT target_language, model, count(*) AS n, " + ", ".join(f"round(avg({s}), 6) AS avg_{s}" for s in b.SCORES) + " FROM v_results WHERE overall IS NOT NULL GROUP BY 1, 2")
add2("a8_category_means", lambda s, d: b.category_means(results(s, d), languages(s)), DIM + ", m AS (SELECT target_language, avg(overall) AS mean, min(ord) AS seen FROM v_results WHERE overall IS NOT NULL GROUP BY 1)",
     "SELECT coalesce(category, 'Unknown') AS category, count(*) AS languages, round(avg(mean), 6) AS avg_overall, min(seen) AS first_seen FROM m LEFT JOIN dim ON target_language = code GROUP BY 1")
add("a9_a10_mean_time", lambda s, d: b.mean_time(results(s, d)),
    "SELECT model, round(coalesce(avg(translation_time_ms) FILTER (translation_time_ms > 0), 0.0), 6) AS avg_time_ms, count(DISTINCT target_language) AS languages FROM v_results GROUP BY 1")


def runs(s, d):
    r = results(s, d)
    return r.groupBy(F.col("source_text_id").alias("seq")).agg(
        F.collect_set("model").alias("models"), F.collect_set("target_language").alias("languages"),
        F.concat(F.lit("2024-01-"), F.lpad(F.min("ord").cast("string"), 2, "0")).alias("started_at"),
        F.concat(F.lit("2024-02-"), F.lpad(F.min("ord").cast("string"), 2, "0")).alias("ended_at"),
        F.concat(F.lit("judge"), F.min("ord").cast("string")).alias("evaluator"), F.count("*").alias("n_results"))


add2("a11_merge_runs", lambda s, d: b.merge_runs(runs(s, d)),
     "r AS (SELECT source_text_id AS seq, '2024-01-' || lpad(min(ord)::VARCHAR, 2, '0') AS sa, '2024-02-' || lpad(min(ord)::VARCHAR, 2, '0') AS ea, 'judge' || min(ord) AS ev, count(*) AS n FROM v_results GROUP BY 1)",
     "SELECT (SELECT string_agg(model, ',' ORDER BY model) FROM (SELECT DISTINCT model FROM v_results)) AS models, (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT target_language AS l FROM v_results)) AS languages, min(sa) AS started_at, max(ea) AS ended_at, arg_min(ev, seq) AS evaluator, CAST(sum(n) AS BIGINT) AS results, 'completed' AS status FROM r")


def dims(s, d):
    r = results(s, d)
    return r.select("model").distinct(), r.select("target_language").distinct(), s.range(7).select(F.col("id").cast("int").alias("source_text_id"))


add2("j1_j2_jobs_to_run", lambda s, d: b.jobs_to_run(results(s, d), *dims(s, d)), "t AS (SELECT CAST(range AS INT) AS source_text_id FROM range(7))",
     f"SELECT model, target_language, source_text_id FROM (SELECT DISTINCT model FROM v_results), (SELECT DISTINCT target_language FROM v_results), t WHERE (model, target_language, source_text_id) NOT IN (SELECT (model, target_language, source_text_id) FROM v_results WHERE {OK})")
add("j2b_completed_keys", lambda s, d: b.completed_keys(results(s, d)), "SELECT DISTINCT source_text_id, target_language, model FROM v_results")
add2("j3_language_info", lambda s, d: b.with_language_info(results(s, d).select("ord", "target_language"), languages(s)), DIM,
     "SELECT ord, target_language, coalesce(name, target_language) AS language_name, coalesce(category, 'Unknown') AS category, coalesce(is_rtl, false) AS is_rtl FROM v_results LEFT JOIN dim ON target_language = code")


def texts(s, d):
    from .fixtures import table

    return table(s, d, "benchmark").where("item_id < 4").select(F.col("item_id").cast("int").alias("id"), F.col("text").alias("content"), F.concat(F.lit("text "), F.col("item_id").cast("string")).alias("title"))


add("j4_source_excerpt", lambda s, d: b.with_source_excerpt(results(s, d).select("ord", "source_text_id"), texts(s, d)),
    "SELECT v.ord, v.source_text_id, CASE WHEN b.item_id IS NOT NULL THEN 'text ' || b.item_id END AS title, substr(coalesce(b.text, ''), 1, 500) AS source_excerpt FROM v_results v LEFT JOIN (SELECT * FROM benchmark WHERE item_id < 4) b ON v.source_text_id = b.item_id")
for _key in ("model", "target_language"):
    add(f"o1_ranking_{_key}", lambda s, d, k=_key: b.ranking(results(s, d), k),
        f"SELECT {_key}, round(m, 6) AS avg_overall, CAST(row_number() OVER (ORDER BY m DESC, seen) AS INT) AS position FROM (SELECT {_key}, avg(overall) AS m, min(ord) AS seen FROM v_results WHERE overall IS NOT NULL GROUP BY 1)")
add("o2_top_examples", lambda s, d: b.top_examples(results(s, d)),
    f"SELECT target_language, position, ord, model, overall FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_language ORDER BY overall DESC, ord) AS INT) AS position FROM v_results WHERE {SC}) WHERE position <= 3")
add("o3_extreme_examples", lambda s, d: b.extreme_examples(results(s, d)),
    f"SELECT model, arg_max(ord, row(overall, -ord)) AS best_ord, max(overall) AS best_overall, arg_min(ord, row(overall, ord)) AS worst_ord, min(overall) AS worst_overall FROM v_results WHERE {SC} GROUP BY 1")


def stored_runs(s, d):
    r = results(s, d)
    return r.groupBy(F.col("source_text_id").alias("run_id")).agg(
        F.collect_list("model").alias("models"), F.collect_list("target_language").alias("languages"),
        F.when(F.max("ord") % 2 == 0, "completed").otherwise("running").alias("status"))


add("o8_resumable_runs", lambda s, d: b.resumable_runs(stored_runs(s, d), [f"src{i}" for i in range(20)][::-5], ["en"]).select("run_id", "status").unionByName(
        b.resumable_runs(stored_runs(s, d), [r[0] for r in results(s, d).where("source_text_id = 1").select("model").distinct().collect()], ["fr", "en", "de", "es", "en"]).select("run_id", "status")),
    "SELECT run_id, status FROM (SELECT source_text_id AS run_id, list_sort(list_distinct(list(model))) AS m, list_sort(list_distinct(list(target_language))) AS l, CASE WHEN max(ord) % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM v_results GROUP BY 1) WHERE status <> 'completed' AND ((m = ['src0','src4','src14','src19'] AND l = ['en']) OR (m = (SELECT list_sort(list_distinct(list(model))) FROM v_results WHERE source_text_id = 1) AND l = ['de','en','es','fr']))")
add("o9_union_results", lambda s, d: results(s, d).select("ord", "model").unionByName(results(s, d).where("source_text_id = 1").select("ord", "model")).groupBy("model").agg(F.count("*").alias("n")),
    "SELECT model, count(*) AS n FROM (SELECT ord, model FROM v_results UNION ALL SELECT ord, model FROM v_results WHERE source_text_id = 1) GROUP BY 1")
add2("o11_category_order", lambda s, d: b.group_categories(b.with_language_info(results(s, d).select("ord", "target_language"), languages(s))), DIM,
     "SELECT category, min(ord) AS first_seen, count(*) AS n, CAST(row_number() OVER (ORDER BY min(ord)) AS INT) AS position FROM (SELECT ord, coalesce(category, 'Unknown') AS category FROM v_results LEFT JOIN dim ON target_language = code) GROUP BY 1")
add("k12_home_report", lambda s, d: b.grouping_report(results(s, d)),
    f"SELECT model, target_language, CAST(grouping_id(model, target_language) AS BIGINT) AS level, count(*) AS total, count(*) FILTER ({SC}) AS successful, {AVGS} FROM v_results GROUP BY GROUPING SETS ((model), (target_language), ())")
add("k9_csv_rows", lambda s, d: b.csv_rows(results(s, d)),
    "SELECT ord, CAST(source_text_id AS VARCHAR) AS source_text_id, target_language, model, " + ", ".join(f"CASE WHEN {s} IS NULL THEN '' ELSE printf('%.1f', {s}) END AS {s}" for s in b.SCORES)
    + f", CAST(translation_time_ms AS VARCHAR) AS translation_time_ms, coalesce(error, '') AS error, CASE WHEN {OK} THEN 'true' ELSE 'false' END AS success FROM v_results")
add("f13_language_subset", lambda s, d: s.createDataFrame([(0, "xx"), (1, "fr"), (2, "en")], "position int, code string").join(languages(s), "code").select("position", "code", "name"),
    "SELECT position, code, name FROM (VALUES (0,'xx'),(1,'fr'),(2,'en')) w(position, code) JOIN (VALUES ('en','English'),('fr','French'),('es','Spanish')) l(code, name) USING (code)")
add("z25_run_summary_view", lambda s, d: b.run_summary(results(s, d)).select("total", F.format_string("%.1f", F.col("with_scores") * 100.0 / F.col("total")).alias("success_percent"),
        *[F.format_string("%.1f", F.col(f"{x}_overall")).alias(f"{x}_score") for x in ("min", "avg", "max")]),
    "SELECT count(*) AS total, printf('%.1f', count(overall) * 100.0::DOUBLE / count(*)) AS success_percent, printf('%.1f', min(overall)) AS min_score, printf('%.1f', avg(overall)) AS avg_score, printf('%.1f', max(overall)) AS max_score FROM v_results")
add("z24_run_list_view", lambda s, d: runs(s, d).select("seq", F.concat(F.array_join(F.slice(F.array_sort("models"), 1, 2), ", "),
        F.when(F.size("models") > 2, F.concat(F.lit(" (+"), (F.size("models") - 2).cast("string"), F.lit(")"))).otherwise("")).alias("models"), F.substring("started_at", 1, 19).alias("started")),
    "SELECT source_text_id AS seq, array_to_string(list_sort(list_distinct(list(model)))[1:2], ', ') || CASE WHEN count(DISTINCT model) > 2 THEN ' (+' || (count(DISTINCT model) - 2) || ')' ELSE '' END AS models, substr('2024-01-' || lpad(min(ord)::VARCHAR, 2, '0'), 1, 19) AS started FROM v_results GROUP BY 1")
