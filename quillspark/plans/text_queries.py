"""Queries over the text functions with their oracle SQL (RE2 has no look-around; classes are spelled out)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from .benchmark_queries import oracle_more
from .fixtures import oracle, table, view

QUERIES: dict = {}
ORACLES: dict = {}


def add(name, query, sql=None, ctes=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = oracle_more(ctes, sql) if ctes else oracle(sql)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def docs(s, d):
    return table(s, d, "documents")


def pages(s, d):
    return table(s, d, "pages")


def nested(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


# cleaning
add("x12_clean_entities", lambda s, d: pages(s, d).select("page_id", x.clean_entities(F.col("html")).alias("cleaned")),
    f"SELECT page_id, {nested('html', [('&nbsp;', chr(160)), *x.ENTITIES])} AS cleaned FROM pages")
SPACED = "regexp_replace(regexp_replace(regexp_replace({e}, ' +', ' ', 'g'), '\\s+([.,!?;:])', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
add("x13_clean_spaces", lambda s, d: docs(s, d).select("doc_id", x.clean_spaces(F.replace("text", F.lit("a"), F.lit("  "))).alias("cleaned")),
    "SELECT doc_id, " + sql_strip(SPACED.format(e="replace(text, 'a', '  ')")) + " AS cleaned FROM documents")
add("x14_rule_pipeline", lambda s, d: pages(s, d).select("page_id", x.Rules().add(x.drop_placeholders)(F.concat(F.lit(" [id3]"), F.col("html"))).alias("cleaned")),
    "SELECT page_id, regexp_replace(" + sql_strip(SPACED.format(e=nested("' [id3]' || html", [("&nbsp;", chr(160)), *x.ENTITIES]))) + ", '\\[id\\d+\\]', '', 'g') AS cleaned FROM pages")
add("x15_drop_placeholders", lambda s, d: docs(s, d).select("doc_id", x.custom_rule("[aeiou]{3,}", "#")(x.drop_placeholders(F.replace("text", F.lit(" "), F.lit(" [id12]")))).alias("cleaned")),
    "SELECT doc_id, regexp_replace(regexp_replace(replace(text, ' ', ' [id12]'), '\\[id\\d+\\]', '', 'g'), '[aeiou]{3,}', '#', 'g') AS cleaned FROM documents")
CLEAN = sql_strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace({e}, '\\s+', ' ', 'g'), '<[^>]+>', '', 'g'), 'https?://\\S+', '', 'g'), '\\S+@\\S+', '', 'g')")
add("x17_clean_for_detection", lambda s, d: pages(s, d).select("page_id", x.clean_for_detection(F.concat_ws(" ", "html", "url", F.lit("a@b.c"))).alias("cleaned")),
    "SELECT page_id, " + CLEAN.format(e="html || ' ' || url || ' a@b.c'") + " AS cleaned FROM pages")
add("x18_sample_for_detection", lambda s, d: docs(s, d).select("doc_id", x.sample_for_detection(F.col("text")).alias("sample")),
    "SELECT doc_id, CASE WHEN length(text) < 50 THEN NULL WHEN length(text) > 10000 THEN substr(text, 1, 3333) || ' ' || substr(text, length(text) // 2 - 1666 + 1, 3332) || ' ' || substr(text, length(text) - 3332, 3333) ELSE text END AS sample FROM documents")
add("x20_strip_invisible", lambda s, d: docs(s, d).select("doc_id", x.strip_invisible(F.replace("text", F.lit("e"), F.lit("e\u200b\u2060\u200d"))).alias("stripped"), x.has_invisible(F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit("\u200c")).otherwise(""))).alias("marked")),
    "SELECT doc_id, text AS stripped, doc_id % 2 = 0 AS marked FROM documents")
add("x38_br_to_newline", lambda s, d: pages(s, d).select("page_id", x.br_to_newline(F.col("html")).alias("plain")),
    "SELECT page_id, regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS plain FROM pages")
add("s5_body_html", lambda s, d: pages(s, d).select("page_id", x.body_html(F.col("html")).alias("body")),
    "SELECT page_id, " + sql_strip("regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)") + " AS body FROM pages")
TEXT = nested("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))", x.TEXT_ENTITIES)
add("s6_html_to_text", lambda s, d: pages(s, d).select("page_id", x.html_to_text(F.col("html")).alias("text")), f"SELECT page_id, {TEXT} AS text FROM pages")

# answers
R = "regexp_replace(" + sql_strip("regexp_replace(" + sql_strip("raw") + ", '(?is)<think>.*?</think>', '', 'g')") + ", '(?is)^.*?</think>', '')"
ANSWER = f"CASE WHEN t LIKE '<TRANSLATION>%' AND t LIKE '%</TRANSLATION>' THEN {sql_strip('substr(t, 14, length(t) - 27)')} WHEN regexp_matches(t, '(?s)<TRANSLATION>.*?</TRANSLATION>') THEN {sql_strip(chr(39).join(['regexp_extract(t, ', '(?s)<TRANSLATION>(.*?)</TRANSLATION>', ', 1)']))} END"
add("x7_extract_answer", lambda s, d: view(s, d, "v_responses").select("conv_id", "turn", x.extract_answer(F.col("raw")).alias("answer")),
    f"SELECT conv_id, turn, {ANSWER} AS answer FROM (SELECT *, {sql_strip(R)} AS t FROM v_responses)")
add("x8_answer_or_raw", lambda s, d: view(s, d, "v_responses").select("conv_id", "turn", x.answer_or_raw(F.col("raw"), F.substring("source", 1, F.when(F.col("conv_id") % 2 == 0, 3).otherwise(10_000))).alias("answer")),
    f"SELECT conv_id, turn, coalesce({ANSWER}, CASE WHEN NOT contains(raw, substr(source, 1, CASE WHEN conv_id % 2 = 0 THEN 3 ELSE 10000 END)) THEN {sql_strip('raw')} END) AS answer FROM (SELECT *, {sql_strip(R)} AS t FROM v_responses)")
add("p17_corrected_text", lambda s, d: view(s, d, "v_responses").select("conv_id", "turn", x.corrected_text(F.col("raw"), "<TRANSLATION>", "</TRANSLATION>").alias("corrected")),
    f"SELECT conv_id, turn, CASE WHEN regexp_matches(raw, '(?s)<TRANSLATION>.*</TRANSLATION>') THEN {sql_strip(chr(39).join(['regexp_extract(raw, ', '(?s)<TRANSLATION>(.*?)</TRANSLATION>', ', 1)']))} END AS corrected FROM v_responses")
BODY = "regexp_extract(regexp_replace(reply, '^```(?:json)?\\s*|\\s*```$', '', 'g'), '\\{[^{}]*\\}')"
SCORE = ", ".join(f"CASE WHEN b <> '' THEN greatest(1.0, least(10.0, coalesce(TRY_CAST(json_extract_string(b, '$.{n}') AS DOUBLE), 5.0))) END AS {n}" for n in x.WEIGHTS)
for _n in ("x9", "x10"):
    add(f"{_n}_evaluation_scores", lambda s, d: view(s, d, "v_eval_json").select("doc_id", x.evaluation_scores(F.col("reply")).alias("e")).select("doc_id", "e.*"),
        f"SELECT doc_id, {SCORE}, CASE WHEN b <> '' THEN substr(coalesce(json_extract_string(b, '$.feedback'), ''), 1, 500) END AS feedback FROM (SELECT doc_id, CASE WHEN v = '' THEN '' ELSE v END AS b FROM (SELECT doc_id, {BODY} AS v FROM v_eval_json))")
add("x11_weighted_score", lambda s, d: view(s, d, "v_results").where("overall IS NOT NULL").select("ord", F.round(x.weighted_score(*[F.col(c) for c in x.WEIGHTS]), 6).alias("score")),
    "SELECT ord, round(accuracy * 0.35::DOUBLE + fluency * 0.30::DOUBLE + style * 0.20::DOUBLE + overall * 0.15::DOUBLE, 6) AS score FROM v_results WHERE overall IS NOT NULL")
add("x39_failed_marker", lambda s, d: view(s, d, "v_results").where("error IS NOT NULL").select("ord", x.failed_marker(F.col("error"), F.col("translated_text")).alias("marked")),
    "SELECT ord, '[TRANSLATION_ERROR: ' || error || '] ' || translated_text AS marked FROM v_results WHERE error IS NOT NULL")

# predicates
PIECES = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'XIV.' WHEN 1 THEN ' 1.2 ' WHEN 2 THEN '' WHEN 3 THEN '(42)' WHEN 4 THEN '– 7' ELSE substr(text, 1, 9) END AS piece FROM documents"


def pieces(s, d):
    return s.sql(PIECES.replace("FROM documents", "FROM {documents}"), documents=docs(s, d))


add("f3_non_translatable", lambda s, d: pieces(s, d).select("doc_id", x.is_non_translatable(F.col("piece")).alias("skip")),
    f"SELECT doc_id, trim(piece) = '' OR regexp_matches(trim(piece), '(?i)^[\\d.\\-–—)(\\sIVXLCDM]+$') AS skip FROM ({PIECES})")
add("f4_short_chunk", lambda s, d: pieces(s, d).select("doc_id", x.is_short_chunk(F.col("piece")).alias("short")), f"SELECT doc_id, length({sql_strip('piece')}) <= 1 AS short FROM ({PIECES})")
add("f2_drop_blank_cues", lambda s, d: view(s, d, "v_cues").where(F.col("text").rlike(r"\S")).select("file_id", "idx"), "SELECT file_id, idx FROM v_cues WHERE regexp_matches(text, '\\S')")
add("f5_use_original", lambda s, d: docs(s, d).select("doc_id", x.should_use_original(F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).when(F.col("doc_id") % 3 == 1, F.concat(F.repeat(F.lit("so it goes "), 5000))).otherwise(F.col("text"))).alias("original")),
    "SELECT doc_id, trim(t) = '' OR length(t) < length(text) * 0.3 OR (len(w) > 10 AND len(list_distinct(w)) / len(w) < 0.3) AS original FROM (SELECT *, list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda a: a <> '') AS w FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 40) WHEN 1 THEN repeat('so it goes ', 5000) ELSE text END AS t FROM documents))")
EXT = "regexp_extract(lower({e}), '[^/.](\\.[^./]*)$', 1)"
FILES = "SELECT page_id, filename FROM v_files UNION ALL SELECT page_id + 1000000, substr(html, 1, 300) || '.txt' FROM pages"


def files(s, d):
    more = pages(s, d).select((F.col("page_id") + 1000000).alias("page_id"), F.concat(F.substring("html", 1, 300), F.lit(".txt")).alias("filename"))
    return view(s, d, "v_files").select("page_id", "filename").unionByName(more)


add("s21_file_type", lambda s, d: view(s, d, "v_files").select("page_id", x.file_type(F.col("filename")).alias("file_type")),
    f"SELECT page_id, CASE WHEN e IN ('.txt','.epub','.srt','.docx') THEN substr(e, 2) ELSE 'unknown' END AS file_type FROM (SELECT page_id, {EXT.format(e='filename')} AS e FROM v_files)")
add("s8_dispatch_by_extension", lambda s, d: view(s, d, "v_files").where("page_id % 5 <> 4").select("page_id", x.file_type_or_error(F.col("filename")).alias("file_type")),
    f"SELECT page_id, substr({EXT.format(e='filename')}, 2) AS file_type FROM v_files WHERE page_id % 5 <> 4")
add("f6_filename_rules", lambda s, d: files(s, d).select("page_id", x.filename_error(F.col("filename")).alias("error")),
    f"SELECT page_id, CASE WHEN e NOT IN ('.txt','.epub','.srt','.docx') THEN 'File type ''' || e || ''' not allowed' WHEN regexp_matches(b, '[<>:\"|?*\\x00-\\x1f]') THEN 'Filename contains invalid characters' WHEN length(b) > 255 THEN 'Filename too long' END AS error FROM (SELECT *, {EXT.format(e='b')} AS e FROM (SELECT page_id, string_split({sql_strip('filename')}, '/')[-1] AS b FROM ({FILES})))")
add("f7_path_rules", lambda s, d: files(s, d).select("page_id", x.path_error(F.col("filename")).alias("error")),
    f"SELECT page_id, CASE WHEN filename LIKE '/%' THEN 'Invalid filename: absolute path not allowed' WHEN contains(filename, '/..') OR contains(filename, '\\..') THEN 'Invalid filename: directory traversal not allowed' WHEN contains(filename, '/') THEN 'Invalid filename: path separators not allowed' WHEN length(filename) > 255 THEN 'Filename too long (max 255 characters)' WHEN substr(filename, 2, 1) = ':' AND length(filename) > 2 THEN 'Absolute paths not allowed' END AS error FROM ({FILES})")
SUS = "list_filter([" + ", ".join(q(p) for p in x.SUSPICIOUS) + "], lambda p: contains(lower(substr({e}, 1, 8192)), p))"
add("f8_text_content", lambda s, d: pages(s, d).select("page_id", x.text_content_error(F.when(F.col("page_id") % 2 == 0, F.col("html")).when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.col("url"))).alias("error"), F.round(x.special_ratio(F.col("url")), 6).alias("special")),
    f"SELECT page_id, CASE WHEN len(f) > 0 THEN 'Suspicious content detected: ' || array_to_string(f[1:3], ', ') WHEN t = '' THEN 'Empty file not allowed' END AS error, round(length(regexp_replace(url, '[\\pL\\pN\\s]', '', 'g')) * 1.0::DOUBLE / length(url), 6) AS special FROM (SELECT *, {SUS.format(e='t')} AS f FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN html WHEN page_id % 3 = 0 THEN '' ELSE url END AS t FROM pages))".replace("length(regexp_replace(url, '[\\pL\\pN\\s]', '', 'g')) * 1.0::DOUBLE / length(url)", "CAST(length(regexp_replace(url, '[\\pL\\pN\\s]', '', 'g')) AS DOUBLE) / length(url)"))
SRT = "CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text ELSE '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || 'eval(1)' END"
add("f9_srt_content", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", x.srt_content_error(F.expr(SRT)).alias("error")),
    f"SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'Empty SRT file' WHEN NOT regexp_matches(t, '\\d+\\s*\\n\\d{{2}}:\\d{{2}}:\\d{{2}},\\d{{3}}\\s*-->') THEN 'Invalid SRT structure' WHEN len(f) > 0 THEN 'Suspicious content detected: ' || array_to_string(f[1:3], ', ') END AS error FROM (SELECT *, {SUS.format(e='t')} AS f FROM (SELECT *, {SRT} AS t FROM conversations))")
add("s3_srt_probe", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.expr(SRT).rlike(r"\d+\s*\n\d{2}:\d{2}:\d{2},\d{3}\s*-->").alias("valid")),
    f"SELECT conv_id, turn, regexp_matches({SRT}, '\\d+\\s*\\n\\d{{2}}:\\d{{2}}:\\d{{2}},\\d{{3}}\\s*-->') AS valid FROM conversations")
add("s10_srt_detection_text", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", x.srt_detection_text(F.expr(SRT)).alias("plain")),
    f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split({SRT}, chr(10)), lambda a: trim(a)), lambda a: a <> '' AND NOT regexp_matches(a, '^\\d+$') AND NOT contains(a, '-->')), ' ') AS plain FROM conversations")
add("f11_safe_filename", lambda s, d: files(s, d).select("page_id", x.safe_filename(F.col("filename")).alias("safe")),
    f"SELECT page_id, substr(sha256(filename), 1, 16) || '_' || CASE WHEN length(f) > 100 THEN substr(f, 1, 80) || CASE WHEN length(e) > 20 THEN right(e, 20) ELSE e END ELSE f END AS safe FROM (SELECT *, regexp_extract(f, '[^.](\\.[^.]+)$', 1) AS e FROM (SELECT *, regexp_replace(string_split({sql_strip('filename')}, '/')[-1], '[^A-Za-z0-9.\\-_]', '_', 'g') AS f FROM ({FILES})))")
add("f20_slug", lambda s, d: pages(s, d).select("page_id", x.slug(F.col("url")).alias("slug")),
    "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[^a-z0-9\\-_]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")

# estimates
LANG = "CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE 'klingon' END"
RATIO = "CASE lang WHEN 'fr' THEN 3.5 WHEN 'de' THEN 3.8 ELSE 4.0 END::DOUBLE"
for _n in ("x3", "c1"):
    add(f"{_n}_estimate_tokens", lambda s, d: docs(s, d).select("doc_id", x.estimate_tokens(F.col("text"), F.expr(LANG)).alias("tokens")),
        f"SELECT doc_id, CAST(trunc(length(text) / ({RATIO}) * 1.1::DOUBLE) AS INT) AS tokens FROM documents")
add("x4_round_to_context", lambda s, d: docs(s, d).select("doc_id", x.round_to_context((F.col("n_chars") * 30).cast("int")).alias("context")),
    "SELECT doc_id, CAST(coalesce(list_filter([2048,4096,8192,16384,32768,65536,131072], lambda a: a >= n_chars * 30)[1], n_chars * 30) AS INT) AS context FROM documents")
add("x5_optimal_chunk_size", lambda s, d: docs(s, d).select("doc_id", x.optimal_chunk_size(F.col("n_chars") * 2).alias("lines")),
    "SELECT doc_id, CAST(CASE WHEN b <= 0 THEN 5 ELSE greatest(5, least(100, trunc(b / 23))) END AS INT) AS lines FROM (SELECT doc_id, n_chars - 2000.0::DOUBLE AS b FROM documents)")
add("x6_adjust_context", lambda s, d: docs(s, d).select("doc_id", x.adjust_context(F.col("n_chars").cast("int"), F.col("doc_id") % 2 == 0, F.lit(4096)).alias("context")),
    "SELECT doc_id, CAST(greatest(4096, coalesce(list_filter([2048,4096,8192,16384,32768,65536,131072], lambda a: a >= r)[1], r)) AS INT) AS context FROM (SELECT doc_id, n_chars + 950 + CASE WHEN doc_id % 2 = 0 THEN 2000 ELSE 0 END AS r FROM documents)")
add("x27_usage", lambda s, d: docs(s, d).select("doc_id", F.round(x.usage_ratio(F.col("n_chars"), F.col("doc_id") % 7 * 1000), 6).alias("ratio"), (x.usage_ratio(F.col("n_chars"), F.col("doc_id") % 7 * 1000) >= 0.95).alias("near")),
    "SELECT doc_id, round(r, 6) AS ratio, r >= 0.95 AS near FROM (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN n_chars / (doc_id % 7 * 1000.0::DOUBLE) ELSE 0 END AS r FROM documents)")
add("x28_completion_tokens", lambda s, d: docs(s, d).select("doc_id", x.completion_tokens(F.when(F.col("doc_id") % 2 == 0, F.lit(500)), F.lit("thinking..."), F.col("text")).alias("tokens")),
    "SELECT doc_id, greatest(CASE WHEN doc_id % 2 = 0 THEN 500 ELSE 0 END, 3 + length(text) // 3) AS tokens FROM documents")
add("x29_log_tokens", lambda s, d: docs(s, d).select("doc_id", F.concat(F.lit("tokens prompt="), "n_chars", F.when(F.col("doc_id") % 2 == 0, F.lit(" completion=7")).otherwise("")).alias("l")).select("doc_id", x.log_tokens(F.col("l"), "prompt").alias("prompt"), x.log_tokens(F.col("l"), "completion").alias("completion")),
    "SELECT doc_id, n_chars AS prompt, CASE WHEN doc_id % 2 = 0 THEN 7::BIGINT END AS completion FROM documents")
add("x30_delay", lambda s, d: docs(s, d).select("doc_id", x.delay_ms(F.col("source"), F.col("doc_id")).alias("ms")),
    "SELECT doc_id, CAST(CAST('0x' || substr(sha256(source || '-' || doc_id), 1, 4) AS INT) % 40 + 10 AS INT) AS ms FROM documents")
add("x31_hash_bucket", lambda s, d: docs(s, d).select("doc_id", x.hash_bucket(F.col("text")).alias("bucket")), "SELECT doc_id, substr(sha256(text), 1, 4) AS bucket FROM documents")
add("x32_retry_delay", lambda s, d: docs(s, d).select("doc_id", x.retry_delay((F.col("doc_id") % 9 + 1).cast("double"), F.when(F.col("doc_id") % 3 == 0, "linear").when(F.col("doc_id") % 3 == 1, "immediate").otherwise("exponential")).alias("delay")),
    "SELECT doc_id, least(CASE doc_id % 3 WHEN 0 THEN (doc_id % 9 + 1)::DOUBLE WHEN 1 THEN 0 ELSE pow(2.0, doc_id % 9) END, 60.0)::DOUBLE AS delay FROM documents")
add("x33_severity", lambda s, d: view(s, d, "v_errors").select("event_id", x.severity(F.concat("error_type", F.when(F.col("event_id") % 5 == 0, "Warning").when(F.col("event_id") % 5 == 1, "Fatal").otherwise("")), F.col("operation_id") % 4 == 0, F.col("recovered") & (F.col("operation_id") % 8 == 0)).alias("level")),
    "SELECT event_id, CASE WHEN operation_id % 4 = 0 AND NOT (recovered AND operation_id % 8 = 0) THEN 'critical' WHEN operation_id % 4 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'warning' WHEN event_id % 5 = 1 THEN 'critical' ELSE 'error' END AS level FROM v_errors")
add("x34_mutation_weights", lambda s, d: docs(s, d).select("doc_id", F.array_join(F.transform(x.mutation_weights(F.col("n_chars") / 10, F.col("doc_id") % 10, F.col("doc_id") % 5), lambda v: v.cast("string")), ",").alias("weights")),
    "SELECT doc_id, CASE WHEN n_chars / 10 > 300 THEN '0.2,0.5,0.2,0.1' WHEN doc_id % 10 < 6 THEN '0.5,0.1,0.2,0.2' WHEN doc_id % 5 < 3 THEN '0.2,0.1,0.2,0.5' ELSE '0.3,0.2,0.3,0.2' END AS weights FROM documents")
add("x35_prompt_size", lambda s, d: docs(s, d).select("doc_id", x.prompt_tokens(F.col("text")).alias("tokens"), x.specific_terms(F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("Ishmael and Watson ")).otherwise(""), "text")).alias("terms")),
    "SELECT doc_id, length(text) // 4 AS tokens, CAST(len(list_filter([" + ", ".join(q(t) for t in x.TEXT_SPECIFIC_TERMS) + "], lambda t: contains(lower(CASE WHEN doc_id % 2 = 0 THEN 'Ishmael and Watson ' ELSE '' END || text), t))) AS INT) AS terms FROM documents")
add("x40_request_cost", lambda s, d: docs(s, d).select("doc_id", F.round(x.request_cost(F.when(F.col("doc_id") % 3 == 0, F.lit(0.25)), F.col("n_chars"), F.col("doc_id")), 9).alias("cost")),
    "SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN 0.25::DOUBLE ELSE n_chars * 0.5::DOUBLE / 1e6 + doc_id * 1.5::DOUBLE / 1e6 END, 9) AS cost FROM documents")

# models and voices: a model name is made from a document
MODEL = "CASE doc_id % 9 WHEN 0 THEN 'qwen3:30b' WHEN 1 THEN 'qwen3:30b-instruct' WHEN 2 THEN 'Qwen3-VL:8b' WHEN 3 THEN 'phi4-reasoning' WHEN 4 THEN 'qwen3:8b' WHEN 5 THEN 'gpt-4-turbo' WHEN 6 THEN 'deepseek-r1:7b' WHEN 7 THEN 'qwq' ELSE 'llama3' END"
KIND = "CASE WHEN doc_id % 9 IN (0, 2, 3, 6, 7) THEN 'uncontrollable' WHEN doc_id % 9 = 4 THEN 'controllable' END"
add("f12_model_pattern", lambda s, d: docs(s, d).select("doc_id", x.matches_model(F.expr(MODEL), "qwen3:30b").alias("sized"), x.matches_model(F.expr(MODEL), "qwen3-vl").alias("family")),
    "SELECT doc_id, doc_id % 9 = 0 AS sized, doc_id % 9 = 2 AS family FROM documents")
for _n in ("x26", "d10"):
    add(f"{_n}_thinking_behaviour", lambda s, d: docs(s, d).select("doc_id", x.thinking_behaviour(F.expr(MODEL)).alias("behaviour")), f"SELECT doc_id, {KIND} AS behaviour FROM documents")
add("x25_family_context", lambda s, d: docs(s, d).select("doc_id", x.family_context(F.expr(MODEL)).alias("context")),
    "SELECT doc_id, CASE doc_id % 9 WHEN 3 THEN 2048 WHEN 5 THEN 128000 WHEN 6 THEN 16384 WHEN 7 THEN 2048 WHEN 8 THEN 4096 ELSE 8192 END AS context FROM documents")
add("z33_model_warning", lambda s, d: docs(s, d).select("doc_id", x.model_warning(F.expr(MODEL)).alias("warning")),
    "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN w || chr(10) || 'Recommended: qwen3:30b-instruct' WHEN 2 THEN w || chr(10) || 'Recommended: qwen3:8b-instruct' WHEN 3 THEN w || chr(10) || 'Recommended: phi4:latest' WHEN 6 THEN w || chr(10) || 'Recommended: Use a non-reasoning model' WHEN 7 THEN w || chr(10) || 'Recommended: Use a non-reasoning model' END AS warning FROM documents, (SELECT '⚠️ This model cannot disable thinking mode (slower, uses more tokens)' AS w)")
add("z10_probe_behaviour", lambda s, d: docs(s, d).select("doc_id", x.probe_behaviour(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0).alias("kind")),
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'uncontrollable' ELSE 'standard' END WHEN doc_id % 5 = 0 THEN 'uncontrollable' WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN 'controllable' ELSE 'standard' END AS kind FROM documents")
add("z9_context_chain", lambda s, d: docs(s, d).select("doc_id", x.first_truthy(F.when(F.col("doc_id") % 2 == 0, F.lit(0)), (F.col("doc_id") % 3).cast("int"), F.lit(2048)).alias("context")),
    "SELECT doc_id, CAST(CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 ELSE 2048 END AS INT) AS context FROM documents")
