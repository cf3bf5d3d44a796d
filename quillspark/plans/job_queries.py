"""Queries over the job store with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as j
from .benchmark_queries import oracle_more
from .fixtures import oracle, table, view

QUERIES: dict = {}
ORACLES: dict = {}
SQL_AS_OF = "TIMESTAMP '2000-01-01 00:00:00'"


def as_of():
    return F.lit("2000-01-01 00:00:00").cast("timestamp")


def add(name, query, sql, ctes=None):
    QUERIES[name] = query
    ORACLES[name] = oracle_more(ctes, sql) if ctes else oracle(sql)


def jobs(s, d):
    return view(s, d, "v_jobs").withColumn("created_at", F.col("created_at").cast("timestamp"))


def writes(s, d):
    return view(s, d, "v_chunk_writes")


ORDER = ["completed_at", "write_seq", "write_seq2", "token_count", "status"]
ROW = "row(completed_at, write_seq, write_seq2, token_count, status)"
add("d2_upsert_chunks", lambda s, d: j.upsert(writes(s, d), ["translation_id", "chunk_index"], ORDER),
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY translation_id, chunk_index ORDER BY completed_at DESC, write_seq DESC, write_seq2 DESC, token_count DESC, status DESC) AS rn FROM v_chunk_writes) WHERE rn = 1")
add("s16_job_chunks", lambda s, d: j.upsert(writes(s, d), ["translation_id", "chunk_index"], ORDER).where("translation_id = 7").select("chunk_index", "status"),
    "SELECT chunk_index, status FROM (SELECT *, row_number() OVER (PARTITION BY translation_id, chunk_index ORDER BY completed_at DESC, write_seq DESC, write_seq2 DESC, token_count DESC, status DESC) AS rn FROM v_chunk_writes WHERE translation_id = 7) WHERE rn = 1")
add("d1_insert_ignore", lambda s, d: j.insert_ignore(jobs(s, d).where("translation_id % 3 = 0"), jobs(s, d).withColumn("status", F.lit("new"))).select("translation_id", "status"),
    "SELECT translation_id, CASE WHEN translation_id % 3 = 0 THEN status ELSE 'new' END AS status FROM v_jobs")


def with_progress(s, d):
    p = F.struct((F.col("translation_id") % 5 - 1).cast("int").alias("current_chunk_index"), F.lit(10).alias("total_chunks"), (F.col("translation_id") % 5).cast("int").alias("completed_chunks"))
    none = F.lit(None).cast("timestamp")
    return jobs(s, d).select("translation_id", "status", p.alias("progress"), none.alias("paused_at"), none.alias("completed_at"))


def patches(s, d):
    k = F.col("translation_id")
    return jobs(s, d).where("translation_id % 2 = 0").select(
        "translation_id", F.when(k % 4 == 0, "completed").when(k % 6 == 0, "paused").alias("status"),
        F.when(k % 3 == 0, 9).alias("current_chunk_index"), F.lit(None).cast("int").alias("total_chunks"), F.lit(10).alias("completed_chunks"))


add("d3_patch_progress", lambda s, d: j.patch_progress(with_progress(s, d), patches(s, d), as_of()).select("translation_id", "status", "progress.*", "paused_at", "completed_at"),
    f"""SELECT translation_id, coalesce(CASE WHEN e AND translation_id % 4 = 0 THEN 'completed' WHEN e AND translation_id % 6 = 0 THEN 'paused' END, status) AS status,
    CAST(CASE WHEN e AND translation_id % 3 = 0 THEN 9 ELSE translation_id % 5 - 1 END AS INT) AS current_chunk_index, 10 AS total_chunks, CAST(CASE WHEN e THEN 10 ELSE translation_id % 5 END AS INT) AS completed_chunks,
    CASE WHEN e AND translation_id % 4 <> 0 AND translation_id % 6 = 0 THEN {SQL_AS_OF} END AS paused_at, CASE WHEN e AND translation_id % 4 = 0 THEN {SQL_AS_OF} END AS completed_at
    FROM (SELECT *, translation_id % 2 = 0 AS e FROM v_jobs)""")
add("d4_sweep_running", lambda s, d: j.sweep_running(jobs(s, d), 1).select("translation_id", "status"),
    "SELECT translation_id, CASE WHEN status = 'running' AND server_session_id IS DISTINCT FROM 1 THEN 'interrupted' ELSE status END AS status FROM v_jobs")
OLD = f"status IN ('paused','interrupted','error','completed') AND created_at <= {SQL_AS_OF} - INTERVAL 30 DAY"
add("d5_delete_old_jobs", lambda s, d: j.delete_old(jobs(s, d), as_of(), 30).select("translation_id", "status"), f"SELECT translation_id, status FROM v_jobs WHERE NOT ({OLD})")
add("d5_deleted_count", lambda s, d: jobs(s, d).agg(F.count_if(j.is_old(as_of(), 30)).alias("deleted")), f"SELECT count(*) FILTER ({OLD}) AS deleted FROM v_jobs")
add("j8_cascade_chunks", lambda s, d: j.cascade(writes(s, d), j.delete_old(jobs(s, d), as_of(), 30)).groupBy("translation_id").agg(F.count("*").alias("chunks")),
    f"SELECT translation_id, count(*) AS chunks FROM v_chunk_writes WHERE translation_id IN (SELECT translation_id FROM v_jobs WHERE NOT ({OLD})) GROUP BY 1")
add("d6_set_config", lambda s, d: jobs(s, d).select("translation_id", F.when(F.col("translation_id") % 10 == 0, F.lit('{"model":"m2"}')).otherwise(F.lit("{}")).alias("config")),
    """SELECT translation_id, CASE WHEN translation_id % 10 = 0 THEN '{"model":"m2"}' ELSE '{}' END AS config FROM v_jobs""")


def checkpoint(s, d):
    w = writes(s, d)
    old = w.where("chunk_index <= 2").select("translation_id", "chunk_index", F.lit("o").alias("original_text"), F.lit("old").alias("translated_text"), F.lit(0).cast("long").alias("write_seq"), F.lit("completed").alias("status")).distinct()
    new = w.where("chunk_index >= 2").select("translation_id", "chunk_index", F.lit("o").alias("original_text"), F.when(F.col("chunk_index") % 2 == 0, "t").alias("translated_text"), F.lit(1).cast("long").alias("write_seq")).distinct()
    return j.save_checkpoint(jobs(s, d).select("translation_id", "file_type"), old, new)


add("d7_save_checkpoint", lambda s, d: checkpoint(s, d)[0].select("translation_id", "current_chunk_index", "completed_chunks").where("current_chunk_index IS NOT NULL"),
    "SELECT translation_id, max(chunk_index) AS current_chunk_index, count(DISTINCT chunk_index) FILTER (chunk_index < 2 OR chunk_index % 2 = 0) AS completed_chunks FROM v_chunk_writes WHERE translation_id IN (SELECT translation_id FROM v_jobs) GROUP BY 1")
add("d8_resume_index", lambda s, d: jobs(s, d).select("translation_id", j.resume_index(F.col("file_type"), (F.col("translation_id") % 9 - 1).cast("int")).alias("resume_index")),
    "SELECT translation_id, CAST(CASE WHEN file_type = 'epub' THEN greatest(0, translation_id % 9 - 1) ELSE translation_id % 9 END AS INT) AS resume_index FROM v_jobs")
add("d10_cache_upsert", lambda s, d: j.upsert(view(s, d, "v_results").select(F.concat("model", F.lit("@"), "target_language").alias("cache_key"), "ord", (F.length("translated_text") % 3).alias("behaviour")), ["cache_key"], ["ord"]),
    "SELECT model || '@' || target_language AS cache_key, max(ord) AS ord, CAST(arg_max(length(translated_text) % 3, ord) AS INT) AS behaviour FROM v_results GROUP BY 1")
add("d11_run_lifecycle", lambda s, d: view(s, d, "v_results").groupBy(F.col("source_text_id").alias("run_id")).agg(
        F.min("ord").alias("started"), F.max("ord").alias("ended"), F.when(F.max("error").isNotNull(), "failed").otherwise("completed").alias("status")),
    "SELECT source_text_id AS run_id, min(ord) AS started, max(ord) AS ended, CASE WHEN max(error) IS NOT NULL THEN 'failed' ELSE 'completed' END AS status FROM v_results GROUP BY 1")
add("d12_merge_stats", lambda s, d: view(s, d, "v_jobs").select("translation_id", F.map_concat(
        F.create_map(F.lit("total"), F.lit(10), F.lit("done"), F.lit(0)), F.create_map(F.lit("done_"), (F.col("translation_id") % 7).cast("int"))).alias("m")).select("translation_id", F.col("m")["total"].alias("total"), F.col("m")["done_"].alias("done")),
    "SELECT translation_id, 10 AS total, CAST(translation_id % 7 AS INT) AS done FROM v_jobs")
RES = f"status IN ('paused','interrupted','error') AND created_at > {SQL_AS_OF} - INTERVAL 365 DAY"
add("f14_resumable_jobs", lambda s, d: j.resumable(jobs(s, d), as_of(), 365).select("translation_id", "status"), f"SELECT translation_id, status FROM v_jobs WHERE {RES}")
add("f15_job_view", lambda s, d: jobs(s, d).select("translation_id", j.progress_percent(F.col("translation_id") % 8, F.col("translation_id") % 13).alias("percent"),
        j.base_name(F.when(F.col("translation_id") % 3 == 0, F.concat(F.lit("/in/"), "file_type", F.lit("/f"), "translation_id")), F.when(F.col("translation_id") % 2 == 0, F.lit("up.txt"))).alias("name")),
    "SELECT translation_id, CASE WHEN translation_id % 13 > 0 THEN CAST(trunc((translation_id % 8) * 100.0::DOUBLE / (translation_id % 13)) AS INT) ELSE 0 END AS percent, CASE WHEN translation_id % 3 = 0 THEN 'f' || translation_id WHEN translation_id % 2 = 0 THEN 'up.txt' ELSE 'Unknown' END AS name FROM v_jobs")
add("j9_orphan_uploads", lambda s, d: j.orphan_uploads(table(s, d, "pages").select(F.concat(F.when(F.col("page_id") % 9 == 0, "test_").otherwise("up_"), F.col("page_id").cast("string")).alias("item")),
        jobs(s, d).select(F.concat(F.lit("up_"), (F.col("translation_id") * 2).cast("string")).alias("item")), s.createDataFrame([("up_1",), ("up_7",)], "item string")),
    "SELECT 'up_' || page_id AS item FROM pages WHERE page_id % 9 <> 0 AND page_id NOT IN (1, 7) AND NOT EXISTS (SELECT 1 FROM v_jobs WHERE translation_id * 2 = page_id)")
add("o6_job_summaries", lambda s, d: j.summaries(jobs(s, d)).limit(20).select("translation_id", "status"), "SELECT translation_id, status FROM v_jobs ORDER BY created_at DESC, translation_id DESC LIMIT 20")


def text_chunks(s, d):
    return table(s, d, "conversations").select(
        F.col("conv_id").alias("translation_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("original_text"),
        F.when(F.col("turn") % 3 != 1, F.replace("text", F.lit("e"), F.lit("E"))).alias("translated_text"), F.when(F.col("turn") % 3 == 0, "completed").otherwise("failed").alias("status"))


add("k8_legacy_output", lambda s, d: j.legacy_output(text_chunks(s, d)),
    "SELECT conv_id AS translation_id, string_agg(CASE WHEN turn % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END, chr(10) ORDER BY turn) AS output FROM conversations GROUP BY 1")
add("j10_merge_partial", lambda s, d: j.merge_partial(table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("string").alias("unit_id"), (F.col("turn") % 2 == 0).alias("ok"), F.substring("text", 1, 20).alias("content"))),
    "SELECT conv_id AS doc, string_agg(CASE WHEN turn % 2 = 0 THEN '' ELSE '[TRANSLATION FAILED] ' END || substr(text, 1, 20), chr(10) ORDER BY CAST(turn AS VARCHAR)) AS merged FROM conversations GROUP BY 1")
add("a27_w7_precount", lambda s, d: j.precount(jobs(s, d).select((F.col("translation_id") % 50).alias("job"), F.col("translation_id").alias("file_id"), F.col("translation_id").alias("position")),
        writes(s, d).where("translation_id % 3 > 0").select(F.col("translation_id").alias("file_id"))),
    "SELECT j.translation_id % 50 AS job, j.translation_id AS file_id, j.translation_id AS position, coalesce(n, 0) AS chunks, CAST(coalesce(sum(n) OVER (PARTITION BY j.translation_id % 50 ORDER BY j.translation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM v_jobs j LEFT JOIN (SELECT translation_id, count(*) AS n FROM v_chunk_writes WHERE translation_id % 3 > 0 GROUP BY 1) c ON j.translation_id = c.translation_id")
add("k15_unique_paths", lambda s, d: view(s, d, "v_files").select("page_id", "filename", F.expr("row_number() OVER (PARTITION BY filename ORDER BY page_id)").alias("n")).select("page_id", j.sequential_id(F.col("filename"), F.col("n")).alias("output")),
    "SELECT page_id, CASE WHEN n = 1 THEN filename ELSE regexp_replace(filename, '\\.[^.]*$', '') || ' (' || (n - 1) || ')' || regexp_extract(filename, '(\\.[^.]*)$', 1) END AS output FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY page_id) AS n FROM v_files)")
