"""Pipeline metrics, error tables, progress and usage as aggregates and windows; merging is partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    """Half-even, 0 without a total."""
    return F.when(total > 0, F.bround(part * 100.0 / total, digits)).otherwise(0.0)


def pipeline_metrics(chunks: DataFrame, *keys: str) -> DataFrame:
    """``ok, fallback, attempt, size`` of chunks to counters, rates and sizes (an empty group's minimum is 0)."""
    out = chunks.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("ok") & (F.col("attempt") == 1)).alias("first_try"), F.count_if(F.col("ok") & (F.col("attempt") > 1)).alias("after_retry"),
        F.count_if("fallback").alias("fallbacks"), F.count_if(~F.col("ok")).alias("failed"), F.sum("size").cast("long").alias("size_sum"),
        F.coalesce(F.min("size"), F.lit(0)).alias("size_min"), F.coalesce(F.max("size"), F.lit(0)).alias("size_max"))
    total = F.col("total")
    return out.withColumns({
        "success_rate": percent(F.col("first_try") + F.col("after_retry"), total), "fallback_rate": percent(F.col("fallbacks"), total),
        "size_avg": F.when(total > 0, F.bround(F.col("size_sum") / total, 1)).otherwise(0.0)})


def merge_metrics(parts: DataFrame, *keys: str) -> DataFrame:
    """Counters add, extremes combine."""
    sums = ["total", "first_try", "after_retry", "fallbacks", "failed", "size_sum"]
    return parts.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums], F.min("size_min").alias("size_min"), F.max("size_max").alias("size_max"))


def retry_distribution(chunks: DataFrame) -> DataFrame:
    """A15."""
    return chunks.where("ok").groupBy("attempt").agg(F.count("*").alias("n"))


def merge_maps(rows: DataFrame, column: str) -> DataFrame:
    """Maps of counters added by key."""
    return rows.select(F.explode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").cast("long").alias("v"))


def error_summary(errors: DataFrame) -> DataFrame:
    """By type and severity, and the totals, in one scan."""
    counts = [F.count("*").alias("total"), F.count_if("recovered").alias("recovered"), F.count_if(F.col("severity") == "critical").alias("critical")]
    rows = errors.groupingSets([["error_type"], ["severity"], []], "error_type", "severity").agg(*counts)
    return rows.withColumn("recovery_rate", F.when(F.col("total") > 0, F.round(F.col("recovered") / F.col("total"), 6)).otherwise(0.0))


def success_rate(rows: DataFrame, *keys: str) -> DataFrame:
    """1 for an empty batch."""
    return rows.groupBy(*keys).agg(F.round(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(1.0)), 6).alias("success_rate"))


def usage_window(rows: DataFrame, key: str, order: str, used: str, last: int = 5) -> DataFrame:
    """Mean, maximum and minimum over the last rows of a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - last, 0)
    return rows.select(key, order, F.round(F.avg(used).over(w), 6).alias("avg_usage"), F.max(used).over(w).alias("max_usage"), F.min(used).over(w).alias("min_usage"))


def running_totals(rows: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Session totals after each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, *order, *[F.round(F.sum(c).over(w), 6).alias(f"total_{c}") for c in columns])


def smoothed_rate(samples: Column, initial: float = 0.01, after: int = 5, weight: float = 0.3) -> Column:
    """Seconds per token; from the ``after``-th sample on, a mixture of the old rate and the sample's."""
    start = F.struct(F.lit(0).alias("n"), F.lit(initial).alias("rate"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), F.when(a["n"] + 1 >= after, a["rate"] * (1 - weight) + x * weight).otherwise(a["rate"]).alias("rate"))
    return F.aggregate(samples, start, step, lambda a: a["rate"])


def progress_percent(done: Column, total: Column, phase: Column, phases: int = 2) -> Column:
    """Each phase is an equal part of 100."""
    share = F.when(total > 0, done / total).otherwise(0.0)
    return F.round((phase - 1 + share) * (100.0 / phases), 6)


def remaining_seconds(chunks: Column, tokens: Column, rate: Column, overhead: float = 3.0) -> Column:
    """W11."""
    return chunks * overhead + tokens * rate


def elapsed_seconds(start: Column, end: Column) -> Column:
    """E4."""
    return F.round(F.coalesce(end.cast("double") - start.cast("double"), F.lit(0.0)), 6)


def total_size(files: DataFrame) -> DataFrame:
    """A25."""
    out = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))
    return out.withColumn("total_mb", F.bround(F.col("total_bytes") / 1048576, 2))


def first_error(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first error of a group, else its values in order."""
    values = F.array_sort(F.collect_list(F.struct(order, "value")))
    return rows.groupBy(key).agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col(order))).alias("error"), F.array_join(F.transform(values, lambda x: x["value"]), "|").alias("joined"),
    ).select(key, "error", F.when(F.col("error").isNull(), F.col("joined")).alias("joined"))
