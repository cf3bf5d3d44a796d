"""Views that give the driver's tables the shapes the operators work on; one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_results": """
SELECT d.doc_id AS ord, CAST(d.doc_id % 5 AS INT) AS source_text_id, d.lang AS target_language,
       d.source AS model, d.text AS translated_text,
       CASE WHEN l.toxic = 1 THEN 'toxic' END AS error,
       CASE WHEN l.doc_id IS NOT NULL THEN CAST(1 + d.n_chars % 10 AS DOUBLE) END AS accuracy,
       CASE WHEN l.doc_id IS NOT NULL THEN CAST(1 + d.doc_id % 10 AS DOUBLE) END AS fluency,
       CASE WHEN l.doc_id IS NOT NULL THEN CAST(1 + (d.n_chars + d.doc_id) % 10 AS DOUBLE) END AS style,
       CASE WHEN l.doc_id IS NOT NULL THEN CAST(1 + l.quality * 5 + d.n_chars % 5 AS DOUBLE) END AS overall,
       d.n_chars AS translation_time_ms
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "v_jobs": """
SELECT o_orderkey AS translation_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'paused' ELSE 'error' END END AS status,
       CASE o_orderkey % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'srt' WHEN 2 THEN 'epub' ELSE 'docx' END AS file_type,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 3 END AS server_session_id,
       o_orderdate AS created_at
FROM {orders}""",
    "v_chunk_writes": """
SELECT l_orderkey AS translation_id, l_linenumber AS chunk_index, l_shipdate AS completed_at,
       l_partkey AS write_seq, l_suppkey AS write_seq2, l_quantity AS token_count,
       CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status
FROM {lineitem}""",
    "v_responses": """
SELECT conv_id, turn, role, text AS source,
       CASE turn % 4
         WHEN 0 THEN '<TRANSLATION>' || replace(text, 'e', 'E') || '</TRANSLATION>'
         WHEN 1 THEN '<think>plan</think><TRANSLATION>' || replace(text, 'e', 'E') || '</TRANSLATION>'
         WHEN 2 THEN 'plan</think> note <TRANSLATION>' || replace(text, 'e', 'E') || '</TRANSLATION> end'
         ELSE replace(text, 'e', 'E') END AS raw
FROM {conversations}""",
    "v_eval_json": """
SELECT doc_id,
       CASE doc_id % 5
         WHEN 0 THEN '{{"accuracy": 8, "fluency": 7, "style": 6, "overall": 7, "feedback": "ok"}}'
         WHEN 1 THEN '```json' || chr(10) || '{{"accuracy": "9", "fluency": 12, "style": 0, "overall": 5}}' || chr(10) || '```'
         WHEN 2 THEN 'Sure: {{"accuracy": "high", "fluency": 3}}'
         WHEN 3 THEN '{{"accuracy": 8'
         ELSE '{{}}' END AS reply
FROM {documents}""",
    "v_errors": """
SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'ContextOverflowError' WHEN 1 THEN 'LLMError' ELSE 'CheckpointError' END AS error_type,
       CASE WHEN value > 20 THEN 'critical' ELSE 'error' END AS severity,
       user_id % 2 = 0 AS recovered, user_id AS operation_id
FROM {events} WHERE event_type = 'error'""",
    "v_requests": "SELECT event_id, user_id AS client, ts FROM {events}",
    "v_cues": """
SELECT conv_id AS file_id, turn AS idx, CAST(turn + 1 AS VARCHAR(10)) AS number,
       turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms, text
FROM {conversations}""",
    "v_files": """
SELECT page_id, url AS path,
       CASE page_id % 5 WHEN 0 THEN 'book ' || CAST(page_id AS VARCHAR(10)) || '.epub' WHEN 1 THEN 'a<b.txt'
            WHEN 2 THEN 'sub.SRT' WHEN 3 THEN '../etc/x.docx' ELSE 'run.exe' END AS filename
FROM {pages}""",
    "v_prompt_evals": """
SELECT d.source AS prompt_id, d.doc_id AS text_id, d.doc_id % 4 = 0 AS is_test, l.toxic = 0 AS success,
       CAST(1 + d.n_chars % 10 AS DOUBLE) AS accuracy, CAST(1 + d.doc_id % 10 AS DOUBLE) AS fluency,
       CAST(1 + (d.n_chars + d.doc_id) % 10 AS DOUBLE) AS style, CAST(1 + l.quality * 9 AS DOUBLE) AS overall
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def oracle(body: str) -> str:
    """``body`` with the views it names put in front as common table expressions."""
    used = [v for v in VIEWS if v in body]
    made = ",\n".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES}).strip()})" for v in used)
    return f"WITH {made}\n{body.strip()}" if used else body.strip()
