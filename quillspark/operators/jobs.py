"""Job store on immutable tables: keyed upserts, patches, sweeps, deletes with cascade, resume.

A table is a DataFrame; every mutation returns the next one. Time is always a parameter, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESUMABLE = ("paused", "interrupted", "error")
DELETABLE = ("paused", "interrupted", "error", "completed")


def insert_ignore(jobs: DataFrame, new: DataFrame, key: str = "translation_id") -> DataFrame:
    """Rows of ``new`` whose key is not there yet are appended."""
    return jobs.unionByName(new.join(jobs.select(key), key, "left_anti").select(jobs.columns))


def upsert(writes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last write of each key; ``order`` is the total order of writes.

    One aggregate with partial maxima, so a key that is written often is reduced before the shuffle.
    """
    rest = [c for c in writes.columns if c not in key and c not in order]
    last = writes.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("w"))
    return last.select(*key, *[F.col(f"w.{c}").alias(c) for c in writes.columns if c not in key])


def patch_progress(jobs: DataFrame, patches: DataFrame, at: Column) -> DataFrame:
    """D3: fields of the progress struct that are given replace the old ones; a status sets its own time.

    ``patches``: translation_id, status, and the progress fields, null where unchanged; one row a job.
    """
    fields = [f for f in jobs.schema["progress"].dataType.names]
    p = patches.select("translation_id", F.col("status").alias("_s"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = jobs.join(p, "translation_id", "left")
    new = F.struct(*[F.coalesce(F.col(f"_{f}"), F.col(f"progress.{f}")).alias(f) for f in fields])
    return joined.select(
        "translation_id", F.coalesce("_s", "status").alias("status"), new.alias("progress"),
        F.when(F.col("_s") == "paused", at).otherwise(F.col("paused_at")).alias("paused_at"),
        F.when(F.col("_s") == "completed", at).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def sweep_running(jobs: DataFrame, session) -> DataFrame:
    """Running jobs of other sessions (and of none) become interrupted."""
    other = (F.col("status") == "running") & ~F.col("server_session_id").eqNullSafe(F.lit(session))
    return jobs.withColumn("status", F.when(other, "interrupted").otherwise(F.col("status")))


def is_old(as_of: Column, days: int) -> Column:
    return F.col("status").isin(*DELETABLE) & (F.col("created_at") <= as_of - F.expr(f"INTERVAL {days} DAYS"))


def delete_old(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Jobs that stay."""
    return jobs.where(~is_old(as_of, days))


def cascade(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chunks of jobs that are still there."""
    return chunks.join(jobs.select("translation_id"), "translation_id", "left_semi")


def resumable(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """F14."""
    return jobs.where(F.col("status").isin(*RESUMABLE) & (F.col("created_at") > as_of - F.expr(f"INTERVAL {days} DAYS")))


def progress_percent(done: Column, total: Column) -> Column:
    """truncated integer percent, 0 without a total."""
    return F.when(total > 0, (done * 100 / total).cast("int")).otherwise(0)


def base_name(*paths: Column) -> Column:
    """last part of the first path that is there, else ``Unknown``."""
    names = [F.nullif(F.element_at(F.split(F.coalesce(p, F.lit("")), r"[/\\]"), -1), F.lit("")) for p in paths]
    return F.coalesce(*names, F.lit("Unknown"))


def resume_index(file_type: Column, current: Column) -> Column:
    """Documents go on inside the current file, others after the current chunk."""
    return F.when(file_type == "epub", F.greatest(F.lit(0), current)).otherwise(current + 1)


def save_checkpoint(jobs: DataFrame, chunks: DataFrame, write: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert of chunks and the jobs' current index; a chunk is completed if it has a translation.

    ``write``: translation_id, chunk_index, original_text, translated_text, write_seq; ``jobs`` gets ``current_chunk_index``
    and ``completed_chunks`` of the chunk table that results.
    """
    status = F.when(F.coalesce("translated_text", F.lit("")) != "", "completed").otherwise("failed")
    rows = chunks.unionByName(write.withColumn("status", status))
    rows = upsert(rows, ["translation_id", "chunk_index"], ["write_seq"])
    state = rows.groupBy("translation_id").agg(
        F.max("chunk_index").alias("current_chunk_index"), F.count_if(F.col("status") == "completed").alias("completed_chunks"))
    kept = [c for c in jobs.columns if c not in ("current_chunk_index", "completed_chunks")]
    return jobs.select(kept).join(state, "translation_id", "left"), rows


def orphan_uploads(items: DataFrame, referenced: DataFrame, preserved: DataFrame) -> DataFrame:
    """``item`` rows that neither a job nor a kept path names; names that start with ``test_`` are left alone."""
    free = items.join(referenced, "item", "left_anti").join(preserved, "item", "left_anti")
    return free.where(~F.col("item").startswith("test_"))


def summaries(jobs: DataFrame) -> DataFrame:
    """Position of each job, newest first; corpus-wide order comes from a range sort, the number from a sorted frame."""
    return jobs.orderBy(F.desc("created_at"), F.desc("translation_id"))


def legacy_output(chunks: DataFrame) -> DataFrame:
    """K8: one text a job: translated chunks, the original where a chunk has none."""
    text = F.when((F.col("status") == "completed") & F.col("translated_text").isNotNull(), F.col("translated_text")).otherwise(F.col("original_text"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", text.alias("t"))))
    return chunks.groupBy("translation_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("output"))


def merge_partial(units: DataFrame, failed_prefix: str = "[TRANSLATION FAILED] ") -> DataFrame:
    """Units (``unit_id`` text, ``ok``, ``content``) joined in order of the id as text; failed ones win and are marked."""
    one = units.groupBy("doc", "unit_id").agg(F.max(F.struct((~F.col("ok")).alias("bad"), F.col("content").alias("c"))).alias("u"))
    text = F.concat(F.when(F.col("u.bad"), failed_prefix).otherwise(""), F.col("u.c"))
    parts = F.array_sort(F.collect_list(F.struct("unit_id", text.alias("t"))))
    return one.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("merged"))


def precount(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of every file (0 without any) and of the files before it."""
    n = chunks.groupBy("file_id").agg(F.count("*").alias("n"))
    rows = files.join(n, "file_id", "left").select("job", "file_id", "position", F.coalesce("n", F.lit(0)).alias("chunks"))
    order = Window.partitionBy("job").orderBy("position")
    return rows.withColumn("before", F.sum("chunks").over(order) - F.col("chunks"))


def sequential_id(name: Column, ordinal: Column) -> Column:
    """``name (n).ext`` from the second file of a name on."""
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return F.when(ordinal == 1, name).otherwise(F.concat(stem, F.lit(" ("), (ordinal - 1).cast("string"), F.lit(")"), ext))
