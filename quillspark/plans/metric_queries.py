"""Queries over metrics, errors, progress, the prompt optimizer and small look-ups, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import lookups as z
from ..operators import metrics as m
from ..operators import optimizer as o
from .benchmark_queries import oracle_more
from .fixtures import oracle, table, view

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, query, sql=None, ctes=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = oracle_more(ctes, sql) if ctes else oracle(sql)


def ascii_pages(s, d):
    """Word ends beyond ASCII differ between the engines."""
    return table(s, d, "pages").select("page_id", F.regexp_replace("html", r"[^\x00-\x7F]", " ").alias("html"))


CHUNKS = "SELECT l_orderkey % 10 AS job, l_returnflag <> 'R' AS ok, l_returnflag = 'A' AS fallback, 1 + l_linenumber % 3 AS attempt, CAST(l_quantity AS BIGINT) AS size FROM {lineitem}"


def chunks(s, d):
    return s.sql(CHUNKS, lineitem=table(s, d, "lineitem"))


C = "(" + CHUNKS.format(lineitem="lineitem") + ")"
COUNTS = "count(*) AS total, count(*) FILTER (ok AND attempt = 1) AS first_try, count(*) FILTER (ok AND attempt > 1) AS after_retry, count(*) FILTER (fallback) AS fallbacks, count(*) FILTER (NOT ok) AS failed, CAST(sum(size) AS BIGINT) AS size_sum, coalesce(min(size), 0) AS size_min, coalesce(max(size), 0) AS size_max"
add("a13_pipeline_metrics", lambda s, d: m.pipeline_metrics(chunks(s, d), "job"),
    f"SELECT *, round_even((first_try + after_retry) * 100.0::DOUBLE / total, 1) AS success_rate, round_even(fallbacks * 100.0::DOUBLE / total, 1) AS fallback_rate, round_even(size_sum / total::DOUBLE, 1) AS size_avg FROM (SELECT job, {COUNTS} FROM {C} GROUP BY 1)")
add("a14_merge_metrics", lambda s, d: m.merge_metrics(m.pipeline_metrics(chunks(s, d), "job", "attempt").drop("attempt"), "job"), f"SELECT job, {COUNTS} FROM {C} GROUP BY 1")
add("a14_merge_maps", lambda s, d: m.merge_maps(chunks(s, d).groupBy("job").agg(F.count_if("ok").alias("a"), F.count("*").alias("b")).select(F.create_map(F.lit("ok"), "a", F.lit("all"), "b").alias("counts")), "counts"),
    f"SELECT 'ok' AS k, count(*) FILTER (ok) AS v FROM {C} UNION ALL SELECT 'all', count(*) FROM {C}")
add("a15_retry_distribution", lambda s, d: m.retry_distribution(chunks(s, d)), f"SELECT attempt, count(*) AS n FROM {C} WHERE ok GROUP BY 1")
add("a16_error_summary", lambda s, d: m.error_summary(view(s, d, "v_errors")),
    "SELECT error_type, severity, count(*) AS total, count(*) FILTER (recovered) AS recovered, count(*) FILTER (severity = 'critical') AS critical, round(count(*) FILTER (recovered) / count(*)::DOUBLE, 6) AS recovery_rate FROM v_errors GROUP BY GROUPING SETS ((error_type), (severity), ())".replace("count(*) FILTER (severity = 'critical') AS critical", "count(*) FILTER (sev = 'critical') AS critical").replace("FROM v_errors", "FROM (SELECT *, severity AS sev FROM v_errors)"))
add("f18_error_lookup", lambda s, d: view(s, d, "v_errors").where((F.col("severity") == "critical") & ~F.col("recovered")).select("event_id", "error_type", "operation_id"), "SELECT event_id, error_type, operation_id FROM v_errors WHERE severity = 'critical' AND NOT recovered")
add("a17_recovery_counts", lambda s, d: view(s, d, "v_errors").where("recovered").groupBy("error_type").agg(F.count("*").alias("n")), "SELECT error_type, count(*) AS n FROM v_errors WHERE recovered GROUP BY 1")
add("a18_success_rate", lambda s, d: m.success_rate(chunks(s, d), "job"), f"SELECT job, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate FROM {C} GROUP BY 1")
add("z15_partial_recovery", lambda s, d: m.success_rate(chunks(s, d), "job", "attempt").withColumn("recovered", F.col("success_rate") > 0), f"SELECT job, attempt, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, bool_or(ok) AS recovered FROM {C} GROUP BY 1, 2")
add("a19_usage_window", lambda s, d: m.usage_window(table(s, d, "documents"), "source", "doc_id", "n_chars"),
    "SELECT source, doc_id, round(avg(n_chars) OVER w, 6) AS avg_usage, max(n_chars) OVER w AS max_usage, min(n_chars) OVER w AS min_usage FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
add("a26_t8_session_totals", lambda s, d: m.running_totals(table(s, d, "documents").withColumn("cost", F.col("n_chars") * 0.5), "source", ["doc_id"], "n_chars", "cost"),
    "SELECT source, doc_id, CAST(sum(n_chars) OVER w AS BIGINT) AS total_n_chars, round(sum(n_chars * 0.5::DOUBLE) OVER w, 6) AS total_cost FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
add("w9_smoothed_rate", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 100 / 100.0).alias("r")))).alias("p")).select("conv_id", F.round(m.smoothed_rate(F.transform("p", lambda v: v["r"])), 6).alias("rate")),
    "SELECT conv_id, round(CASE WHEN n < 5 THEN 0.01 ELSE 0.01 * pow(0.7, n - 4) + list_sum(list_transform(range(5, n + 1), lambda i: 0.3 * pow(0.7, n - i) * l[i])) END, 6) AS rate FROM (SELECT conv_id, count(*) AS n, list((length(text) % 100) / 100.0::DOUBLE ORDER BY turn) AS l FROM conversations GROUP BY 1)".replace("list_sum(list_transform(range(5, n + 1)", "list_sum(list_transform(range(5, greatest(n, 5) + 1)").replace("l[i]", "coalesce(l[i], 0)"))
for _n in ("w10", "t5"):
    add(f"{_n}_progress", lambda s, d: table(s, d, "documents").select("doc_id", m.progress_percent(F.col("n_chars") % 10, F.col("doc_id") % 11, F.col("doc_id") % 2 + 1).alias("percent")),
        "SELECT doc_id, round((doc_id % 2 + CASE WHEN doc_id % 11 > 0 THEN (n_chars % 10) / (doc_id % 11)::DOUBLE ELSE 0 END) * 50.0, 6) AS percent FROM documents")
add("w11_remaining", lambda s, d: table(s, d, "documents").select("doc_id", F.round(m.remaining_seconds(F.col("doc_id") % 9, F.col("n_chars"), F.lit(0.01)), 6).alias("eta")), "SELECT doc_id, round(doc_id % 9 * 3.0::DOUBLE + n_chars * 0.01::DOUBLE, 6) AS eta FROM documents")
add("e4_elapsed", lambda s, d: table(s, d, "events").groupBy("user_id").agg(m.elapsed_seconds(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).alias("elapsed")), "SELECT user_id, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 6) AS elapsed FROM events GROUP BY 1")
add("e3_iso_range", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.min(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("first"), F.max(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("last")), "SELECT user_id, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS first, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last FROM events GROUP BY 1")
add("a25_total_size", lambda s, d: m.total_size(table(s, d, "documents").select(F.col("n_chars").alias("size_bytes"))), "SELECT CAST(sum(n_chars) AS BIGINT) AS total_bytes, round_even(sum(n_chars) / 1048576.0::DOUBLE, 2) AS total_mb FROM documents")
add("a29_pattern_counts", lambda s, d: z.pattern_counts(table(s, d, "pages"), "page_id", "html"))
add("x1b_formula_or_currency", lambda s, d: table(s, d, "documents").select("doc_id", z.is_formula(F.expr("CASE doc_id % 5 WHEN 0 THEN 'x_1' WHEN 1 THEN '10.50' WHEN 2 THEN 'price' WHEN 3 THEN 'a + b' ELSE substr(text, 1, 5) END")).alias("formula")),
    "SELECT doc_id, CASE WHEN regexp_matches(v, '[_^\\\\{}]') THEN true WHEN regexp_full_match(v, '\\d+(?:\\.\\d{1,2})?') THEN false WHEN regexp_full_match(v, '[a-zA-Z]+') THEN false ELSE true END AS formula FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'x_1' WHEN 1 THEN '10.50' WHEN 2 THEN 'price' WHEN 3 THEN 'a + b' ELSE substr(text, 1, 5) END AS v FROM documents)")
add("a30_first_error", lambda s, d: m.first_error(table(s, d, "conversations").select("conv_id", "turn", F.substring("text", 1, 9).alias("value"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat(F.lit("e"), "turn")).alias("error")), "conv_id", "turn"),
    "SELECT conv_id, arg_min(e, turn) FILTER (e IS NOT NULL) AS error, CASE WHEN count(e) = 0 THEN string_agg(substr(text, 1, 9), '|' ORDER BY turn) END AS joined FROM (SELECT *, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'e' || turn END AS e FROM conversations) GROUP BY 1")

# optimizer
W = "(accuracy * 0.35::DOUBLE + fluency * 0.30::DOUBLE + style * 0.20::DOUBLE + overall * 0.15::DOUBLE)"
evals = lambda s, d: view(s, d, "v_prompt_evals")
prompts = lambda s, d: table(s, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("prompt_id"), F.concat(F.lit("Watson "), "text").alias("text"))
add("a20_base_score", lambda s, d: o.base_scores(evals(s, d)),
    "SELECT prompt_id, round(" + " + ".join(f"coalesce(avg({c}) FILTER (success), 0) * {w}::DOUBLE" for c, w in x.WEIGHTS.items()) + ", 6) AS base_score, count(*) FILTER (success) AS successes, count(*) AS evaluations FROM v_prompt_evals GROUP BY 1")
FIT = "SELECT prompt_id, coalesce(avg(w) FILTER (success AND {t}), 0.0) AS train_score, coalesce(avg(w) FILTER (success AND NOT {t}), 0.0) AS test_score, coalesce(var_samp(w) FILTER (success AND {t}), 0.0) AS variance FROM (SELECT *, " + W + " AS w FROM v_prompt_evals) GROUP BY 1"
TERMS = "len(list_filter([" + ", ".join(f"'{t}'" for t in x.TEXT_SPECIFIC_TERMS) + "], lambda t: contains(lower('Watson ' || text), t)))"
add("a21_a22_fitness", lambda s, d: o.fitness(evals(s, d), prompts(s, d)),
    f"SELECT prompt_id, round(train_score, 6) AS train_score, round(test_score, 6) AS test_score, round(variance, 6) AS variance, round(g, 6) AS gap_penalty, round(train_score - (variance * 0.1::DOUBLE + greatest(0, coalesce(length(text) + 7, 0) - 500) * 0.001::DOUBLE + CASE WHEN text IS NULL THEN 0 ELSE {TERMS} END * 0.05::DOUBLE + g), 6) AS fitness FROM (SELECT f.*, b.text, greatest(0.0, train_score - test_score) * 0.5 AS g FROM ({FIT.format(t='NOT is_test')}) f LEFT JOIN benchmark b ON f.prompt_id = 'src' || b.item_id)")
add("a23_quick_fitness", lambda s, d: o.fitness(evals(s, d), quick=True),
    f"SELECT prompt_id, round(train_score, 6) AS train_score, round(test_score, 6) AS test_score, round(variance, 6) AS variance, 0.0::DOUBLE AS gap_penalty, round(train_score - variance * 0.1::DOUBLE, 6) AS fitness FROM ({FIT.format(t='true')})")
pop = lambda s, d: view(s, d, "v_results").groupBy(F.col("model").alias("prompt_id")).agg(F.min("ord").alias("ord"), F.coalesce(F.sum("overall"), F.lit(0.0)).alias("fitness"), (F.min("ord") % 3).alias("iteration"))
POP = "pop AS (SELECT model AS prompt_id, min(ord) AS ord, coalesce(sum(overall), 0.0) AS fitness, min(ord) % 3 AS iteration FROM v_results GROUP BY 1)"
add("w6_rank_prompts", lambda s, d: o.rank(pop(s, d)).select("prompt_id", "position"), "SELECT prompt_id, CAST(row_number() OVER (ORDER BY fitness DESC, ord) AS INT) AS position FROM pop", POP)
add("o4_elites", lambda s, d: o.elites(pop(s, d), 5).select("prompt_id", "fitness"), "SELECT prompt_id, fitness FROM pop ORDER BY fitness DESC, ord LIMIT 5", POP)
add("o4_tournament", lambda s, d: o.tournament(pop(s, d), 6, 3, 42))
for _n in ("o5", "k14"):
    add(f"{_n}_top_prompts", lambda s, d: o.elites(pop(s, d), 10).select("prompt_id", F.bround("fitness", 4).alias("fitness")), "SELECT prompt_id, round_even(fitness, 4) AS fitness FROM pop ORDER BY pop.fitness DESC, ord LIMIT 10", POP)
add("a24_iteration_summary", lambda s, d: o.iteration_summary(pop(s, d)), "SELECT iteration, coalesce(max(fitness) FILTER (fitness > 0), 0.0) AS best, round(coalesce(avg(fitness) FILTER (fitness > 0), 0.0), 6) AS mean, coalesce(min(fitness) FILTER (fitness > 0), 0.0) AS worst, count(*) AS prompts_evaluated FROM pop GROUP BY 1", POP)
items = lambda s, d: table(s, d, "benchmark").select(F.col("item_id").alias("ord"))
add("o12_folds", lambda s, d: o.folds(items(s, d), 4), "SELECT f.range AS fold, ord, CASE WHEN place = f.range THEN 'test' ELSE 'train' END AS part FROM range(4) f, (SELECT item_id AS ord, row_number() OVER (ORDER BY item_id) - 1 AS place FROM benchmark WHERE item_id <> 0)")
add("o13_simple_split", lambda s, d: o.simple_split(items(s, d), 0.3), "SELECT ord, CASE WHEN r > n - greatest(1, floor(n * 0.3::DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM (SELECT item_id AS ord, row_number() OVER (ORDER BY item_id) AS r, count(*) OVER () AS n FROM benchmark)")
add("o14_fold_rotation", lambda s, d: items(s, d).select("ord", o.fold_of(F.col("ord") + 1, 4).alias("fold")), "SELECT item_id AS ord, item_id % 4 AS fold FROM benchmark")
add("a31_train_test_gap", lambda s, d: o.fitness(evals(s, d)).select("prompt_id", "train_score", "test_score", F.round(F.col("train_score") - F.col("test_score"), 5).alias("gap")), f"SELECT prompt_id, round(train_score, 6) AS train_score, round(test_score, 6) AS test_score, round(round(train_score, 6) - round(test_score, 6), 5) AS gap FROM ({FIT.format(t='NOT is_test')})")
add("z16_optimizer_warnings", lambda s, d: items(s, d).select("ord", F.array_join(o.config_warnings(F.col("ord") % 4, F.lit(3), F.col("ord") % 7, F.lit(5), 0.9 + (F.col("ord") % 3) / 10), "; ").alias("warnings")),
    "SELECT item_id AS ord, array_to_string(list_filter([CASE WHEN item_id % 4 < 2 THEN 'At least two texts are needed' END, CASE WHEN 3 > item_id % 4 THEN 'More folds than texts' END, CASE WHEN item_id % 7 >= 5 THEN 'Elite count must be below the population' END, CASE WHEN item_id % 3 <> 1 THEN 'Weights must sum to 1' END], lambda w: w IS NOT NULL), '; ') AS warnings FROM benchmark")
add("z26_weakness_lines", lambda s, d: o.weakness_lines(table(s, d, "documents").select(F.col("source").alias("prompt_id"), F.col("doc_id").alias("ord"), "text")),
    "SELECT source AS prompt_id, string_agg('- ' || substr(text, 1, 150), chr(10) ORDER BY doc_id) AS tried FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY 1")

# look-ups and views
def lang():
    return F.expr("CASE doc_id % 4 WHEN 0 THEN 'French' WHEN 1 THEN ' DE ' WHEN 2 THEN 'Klingon' ELSE '' END")


add("x24_voice", lambda s, d: table(s, d, "documents").select("doc_id", z.voice(lang()).alias("voice")), "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fr-FR-DeniseNeural' WHEN 1 THEN 'de-DE-KatjaNeural' ELSE '' END AS voice FROM documents")
add("z3_effective_voice", lambda s, d: table(s, d, "documents").select("doc_id", z.effective_voice(F.when(F.col("doc_id") % 3 == 0, "own").otherwise(""), lang()).alias("voice")),
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN doc_id % 4 = 0 THEN 'fr-FR-DeniseNeural' WHEN doc_id % 4 = 1 THEN 'de-DE-KatjaNeural' ELSE 'en-US-AriaNeural' END AS voice FROM documents".replace("en-US-AriaNeural", z.VOICES["english"]))
add("z4_speech_language", lambda s, d: table(s, d, "documents").select("doc_id", z.speech_language(lang()).alias("code")), "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'en' END AS code FROM documents")
add("z5_audio_extension", lambda s, d: table(s, d, "documents").select("doc_id", z.audio_extension(F.expr("CASE doc_id % 3 WHEN 0 THEN 'MP3' WHEN 1 THEN 'ogg' ELSE 'flac' END")).alias("ext")), "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.ogg' ELSE '.opus' END AS ext FROM documents")
voices = lambda s: s.createDataFrame([(0, "en-US-A", "en-US", "English (US)", "Male"), (1, "en-GB-B", "en-GB", "English (UK)", "Female"), (2, "fr-FR-C", "fr-FR", "French", "Male")], "ord int, name string, language string, locale string, gender string")
add("z1_voice_filter", lambda s, d: z.voices_of(voices(s), "ENGLISH").select("name"), "SELECT unnest(['en-US-A', 'en-GB-B']) AS name")
add("z2_voice_pick", lambda s, d: z.pick_voice(voices(s), "en", "Female").unionByName(z.pick_voice(voices(s), "fr", "Female")), "SELECT unnest(['en-GB-B', 'fr-FR-C']) AS name")
add("z7_language_pairs", lambda s, d: z.language_pairs(table(s, d, "documents").select(F.col("lang").alias("code")).distinct()), "SELECT a.lang AS source, b.lang AS target FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT lang FROM documents) b WHERE a.lang <> b.lang")
examples = lambda s: s.createDataFrame([("en", "fr", "e1"), ("en", "en", "e0"), ("de", "fr", "e2")], "source string, target string, example string")
for _n in ("z6", "z8"):
    add(f"{_n}_example_lookup", lambda s, d: z.example_for(table(s, d, "documents").select("doc_id", F.col("lang").alias("source"), F.when(F.col("doc_id") % 2 == 0, "fr").otherwise("xx").alias("target")), examples(s), "en"),
        "SELECT doc_id, lang AS source, CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE 'xx' END AS target, CASE WHEN doc_id % 2 = 0 AND lang = 'de' THEN 'e2' WHEN doc_id % 2 = 0 THEN 'e1' ELSE 'e0' END AS example FROM documents")
MODELS = "SELECT 'm' || doc_id || CASE doc_id % 5 WHEN 0 THEN ':free' WHEN 1 THEN '-vl' ELSE '' END AS id, CASE WHEN doc_id % 7 = 0 THEN 'text+image->text' ELSE 'text->text' END AS modality, doc_id / 100.0 AS prompt_price, n_chars / 1000.0 AS completion_price FROM {documents}"
add("z11_model_catalogue", lambda s, d: z.catalogue(s.sql(MODELS, documents=table(s, d, "documents")), z.fallback_models(s)).select("id"),
    "SELECT id FROM (" + MODELS.format(documents="documents") + ") WHERE NOT contains(id, ':free') AND NOT contains(modality, 'image') AND NOT contains(id, 'vl')")
add("s22_catalogue_fallback", lambda s, d: z.catalogue(s.sql(MODELS + " WHERE doc_id < 3", documents=table(s, d, "documents")), z.fallback_models(s)).select("id"), "SELECT 'm2' AS id UNION ALL SELECT unnest(['stub/small', 'stub/medium', 'stub/large']) AS id")
add("z12_recovery_overlays", lambda s, d: z.recovery_attempts(table(s, d, "documents").select("doc_id", F.lit(0.3).alias("temperature"), F.lit(1.1).alias("repeat_penalty"))),
    "SELECT doc_id, a.attempt, a.temperature, a.repeat_penalty FROM documents, (VALUES (1, 0.7::DOUBLE, 1.1::DOUBLE), (2, 0.7::DOUBLE, 1.3::DOUBLE), (3, 1.0::DOUBLE, 1.5::DOUBLE)) a(attempt, temperature, repeat_penalty)")
add("z17_benchmark_config", lambda s, d: items(s, d).select("ord", F.array_join(z.benchmark_errors(F.col("ord") % 3, F.col("ord") % 2, F.col("ord") % 5 - 1), "; ").alias("errors")),
    "SELECT item_id AS ord, array_to_string(list_filter([CASE WHEN item_id % 3 = 0 THEN 'No models given' END, CASE WHEN item_id % 2 = 0 THEN 'No languages given' END, CASE WHEN item_id % 5 = 0 THEN 'Timeout must be positive' END], lambda e: e IS NOT NULL), '; ') AS errors FROM benchmark")
add("f17_chunk_warnings", lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(z.chunk_warnings(F.col("n_chars") % 150), "; ").alias("warnings")),
    "SELECT doc_id, CASE WHEN n_chars % 150 < 5 THEN 'Chunk size is very small' WHEN n_chars % 150 > 100 THEN 'Chunk size is very large' ELSE '' END AS warnings FROM documents")
add("z18_file_units", lambda s, d: z.file_units(table(s, d, "pages").select((F.col("page_id") % 10).alias("book"), F.col("page_id").alias("position"), F.col("url").alias("href"), (F.col("page_id") % 3 != 0).alias("present"))),
    "SELECT * EXCLUDE (p) FROM (SELECT page_id % 10 AS book, page_id AS position, url AS href, coalesce(lag(url) OVER w, '') AS previous, coalesce(lead(url) OVER w, '') AS next, page_id % 3 <> 0 AS p FROM pages WINDOW w AS (PARTITION BY page_id % 10 ORDER BY page_id)) WHERE p")
add("z20_existing_paths", lambda s, d: z.split_existing(table(s, d, "pages").select((F.col("page_id") * 2).alias("path")), table(s, d, "pages").select(F.col("page_id").alias("path"))), "SELECT page_id * 2 AS path, page_id * 2 IN (SELECT page_id FROM pages) AS present FROM pages")
add("z21_confidence", lambda s, d: table(s, d, "documents").select("doc_id", F.bround(F.col("n_chars") / 997.0, 2).alias("confidence")), "SELECT doc_id, round_even(n_chars / 997.0::DOUBLE, 2) AS confidence FROM documents")
add("z23_strict_merge", lambda s, d: z.strict_runs(view(s, d, "v_results").select(F.col("source_text_id").alias("run")), [1, 3]), "SELECT source_text_id AS run, count(*) AS results FROM v_results WHERE source_text_id IN (1, 3) GROUP BY 1")
add("z31_f16_partial_state", lambda s, d: table(s, d, "documents").select("doc_id", z.state_percent(F.col("doc_id") % 9, F.col("doc_id") % 5 * 2).alias("percent"), z.state_valid(F.col("doc_id") % 9, F.col("doc_id") % 5 * 2, F.col("doc_id") % 3).alias("valid")),
    "SELECT doc_id, round(CASE WHEN doc_id % 5 > 0 THEN doc_id % 9 * 100.0::DOUBLE / (doc_id % 5 * 2) ELSE 0 END, 6) AS percent, doc_id % 9 <= doc_id % 5 * 2 AND doc_id % 3 <= doc_id % 9 AS valid FROM documents")
add("z13_missing_placeholders", lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.filter(F.array(F.lit("[id0]"), F.lit("[id1]")), lambda p: ~F.contains(F.when(F.col("doc_id") % 2 == 0, "[id0] a").otherwise("[id0][id1]"), p)), ",").alias("missing")),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[id1]' ELSE '' END AS missing FROM documents")
add("t4_retry_policy", lambda s, d: view(s, d, "v_errors").select("event_id", z.retry_policy(F.col("error_type")).alias("p")).select("event_id", "p.*"),
    "SELECT event_id, CASE error_type WHEN 'ContextOverflowError' THEN 3 WHEN 'LLMError' THEN 3 ELSE 2 END AS attempts, CASE error_type WHEN 'ContextOverflowError' THEN 'immediate' WHEN 'LLMError' THEN 'exponential' ELSE 'linear' END AS strategy FROM v_errors")
add("x36_x37_prompts", lambda s, d: table(s, d, "documents").select("doc_id", z.render_prompt(F.col("text"), F.col("lang"), F.lit("English"), F.lit("")).alias("p")).select("doc_id", F.md5("p.user").alias("user"), F.md5("p.system").alias("system")),
    "SELECT doc_id, md5('# Text' || chr(10) || '<SOURCE_TEXT>' || chr(10) || text || chr(10) || '</SOURCE_TEXT>') AS user, md5('You translate from ' || lang || ' into English.' || chr(10) || 'Answer between <TRANSLATION> and </TRANSLATION> only.') AS system FROM documents")
add("d9_partial_states", lambda s, d: table(s, d, "pages").select("page_id", F.col("url").alias("href"), (F.col("page_id") % 7).alias("current")).where("current > 0"))
add("window_events", lambda s, d: table(s, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp(F.col("w.start")).alias("start"), "event_type", "n"),
    "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
