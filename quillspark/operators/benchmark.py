"""Benchmark store: jobs still to run, per-model and per-language statistics, rankings, reports, merging of runs.

Result facts have ``ord, source_text_id, target_language, model, translated_text, error, accuracy, fluency, style, overall,
translation_time_ms``; null scores mean that there was no evaluation. First-seen order is carried by ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORES = ("accuracy", "fluency", "style", "overall")
#: Lower bounds of the score bands.
BANDS = ((9.0, "excellent"), (7.0, "good"), (5.0, "acceptable"), (3.0, "poor"))


def success() -> Column:
    """F1."""
    return F.col("error").isNull() & (F.coalesce(F.col("translated_text"), F.lit("")) != "")


def scored() -> Column:
    return success() & F.col("overall").isNotNull()


def band(score: Column) -> Column:
    """F19."""
    out = F
    for low, name in BANDS:
        out = out.when(score >= low, name)
    return out.otherwise("failed")


def _means(ok: Column) -> list[Column]:
    return [F.coalesce(F.avg(F.when(ok, F.col(s))), F.lit(0.0)).alias(f"avg_{s}") for s in SCORES]


def model_stats(results: DataFrame, key: str = "model") -> DataFrame:
    """A1: totals and means over the successful, evaluated rows; 0 where there are none."""
    return results.groupBy(key).agg(F.count("*").alias("total"), F.count_if(scored()).alias("successful"), *_means(scored()))


def _best_and_worst(results: DataFrame, ok: Column, key: str, other: str) -> DataFrame:
    """Per ``key`` the ``other`` with the highest and lowest mean overall; ties go to the one seen first."""
    pairs = results.where(ok).groupBy(key, other).agg(F.avg("overall").alias("mean"), F.min("ord").alias("seen"))
    return pairs.groupBy(key).agg(
        F.max_by(other, F.struct("mean", -F.col("seen"))).alias(f"best_{other}"),
        F.min_by(other, F.struct("mean", "seen")).alias(f"worst_{other}"),
    )


def language_stats(results: DataFrame) -> DataFrame:
    """A2."""
    extremes = _best_and_worst(results, scored(), "target_language", "model")
    return model_stats(results, "target_language").join(extremes, "target_language", "left")


def model_extremes(results: DataFrame) -> DataFrame:
    """A3: over all rows with scores, successful or not."""
    return _best_and_worst(results, F.col("overall").isNotNull(), "model", "target_language")


def run_summary(results: DataFrame) -> DataFrame:
    """A4."""
    has = F.col("overall").isNotNull()
    return results.agg(
        F.count("*").alias("total"), F.count_if(has).alias("with_scores"), F.count_if(~has).alias("without_scores"),
        *[F.coalesce(f("overall"), F.lit(0.0)).alias(f"{n}_overall") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
    )


def run_progress(results: DataFrame, texts: int = 5) -> DataFrame:
    """A5: expected = texts x models x languages."""
    expected = (F.lit(texts) * F.count_distinct("model") * F.count_distinct("target_language")).cast("long")
    out = results.agg(expected.alias("total_expected"), F.count("*").alias("done"))
    percent = F.when(F.col("total_expected") > 0, F.col("done") * 100.0 / F.col("total_expected")).otherwise(0.0)
    return out.withColumn("progress_percent", F.round(percent, 6))


def histogram(results: DataFrame, key: str) -> DataFrame:
    """Evaluated rows in each band."""
    names = [n for _, n in BANDS] + ["failed"]
    rows = results.where(F.col("overall").isNotNull()).withColumn("band", band(F.col("overall")))
    return rows.groupBy(key).agg(*[F.count_if(F.col("band") == n).alias(n) for n in names])


def pair_means(results: DataFrame) -> DataFrame:
    """Means of (language, model), pairs without scores left out."""
    return results.where(F.col("overall").isNotNull()).groupBy("target_language", "model").agg(
        F.count("*").alias("n"), *[F.round(F.avg(s), 6).alias(f"avg_{s}") for s in SCORES])


def category_means(results: DataFrame, languages: DataFrame) -> DataFrame:
    """Unweighted mean of the languages' means of a category, in the order in which categories were first seen."""
    by_language = results.where(F.col("overall").isNotNull()).groupBy("target_language").agg(F.avg("overall").alias("mean"), F.min("ord").alias("seen"))
    named = by_language.join(F.broadcast(languages), by_language["target_language"] == languages["code"], "left")  # a fixed dimension
    return named.groupBy(F.coalesce("category", F.lit("Unknown")).alias("category")).agg(
        F.count("*").alias("languages"), F.round(F.avg("mean"), 6).alias("avg_overall"), F.min("seen").alias("first_seen"))


def mean_time(results: DataFrame) -> DataFrame:
    """Mean time over rows that took any, and distinct languages, per model."""
    t = F.col("translation_time_ms")
    return results.groupBy("model").agg(
        F.round(F.coalesce(F.avg(F.when(t > 0, t)), F.lit(0.0)), 6).alias("avg_time_ms"), F.count_distinct("target_language").alias("languages"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """One row of a run each (``seq, started_at, ended_at, evaluator, models, languages, n_results``) into one run."""
    union = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    return runs.agg(
        union("models").alias("models"), union("languages").alias("languages"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        F.min_by("evaluator", "seq").alias("evaluator"), F.sum("n_results").cast("long").alias("results"),
    ).withColumn("status", F.when(F.col("ended_at").isNotNull(), "completed").otherwise("running"))


def jobs_to_run(results: DataFrame, models: DataFrame, languages: DataFrame, texts: DataFrame) -> DataFrame:
    """Every (model, language, text) in this nesting order but those that already succeeded."""
    wanted = models.crossJoin(F.broadcast(languages)).crossJoin(F.broadcast(texts))  # three small dimensions
    done = results.where(success()).select("model", "target_language", "source_text_id")
    return wanted.join(done, ["model", "target_language", "source_text_id"], "left_anti")


def completed_keys(results: DataFrame) -> DataFrame:
    """Keys that have any result, failed ones too."""
    return results.select("source_text_id", "target_language", "model").distinct()


def with_language_info(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """Names of the dimension, a fallback for unknown codes."""
    joined = rows.join(F.broadcast(languages), rows["target_language"] == languages["code"], "left")  # a fixed dimension
    return joined.select(
        rows["*"], F.coalesce("name", "target_language").alias("language_name"), F.coalesce("category", F.lit("Unknown")).alias("category"),
        F.coalesce("is_rtl", F.lit(False)).alias("is_rtl"))


def with_source_excerpt(results: DataFrame, texts: DataFrame, chars: int = 500) -> DataFrame:
    """The source text's beginning."""
    t = texts.select(F.col("id").alias("source_text_id"), F.col("content").alias("_c"), "title")
    joined = results.join(t, "source_text_id", "left")
    return joined.withColumn("source_excerpt", F.substring(F.coalesce("_c", F.lit("")), 1, chars)).drop("_c")


def ranking(results: DataFrame, key: str) -> DataFrame:
    """O1: 1-based position by mean overall of the evaluated rows, ties by first appearance."""
    means = results.where(F.col("overall").isNotNull()).groupBy(key).agg(F.avg("overall").alias("mean"), F.min("ord").alias("seen"))
    order = Window.orderBy(F.desc("mean"), "seen")  # one row a model or language
    return means.select(key, F.round("mean", 6).alias("avg_overall"), F.row_number().over(order).alias("position"))


def top_examples(results: DataFrame, key: str = "target_language", k: int = 3) -> DataFrame:
    """O2."""
    order = Window.partitionBy(key).orderBy(F.desc("overall"), "ord")
    ranked = results.where(scored()).withColumn("position", F.row_number().over(order))
    return ranked.where(F.col("position") <= k).select(key, "position", "ord", "model", "overall")


def extreme_examples(results: DataFrame) -> DataFrame:
    """O3: the best and the worst single row of a model, the first of equals."""
    return results.where(scored()).groupBy("model").agg(
        F.max_by("ord", F.struct("overall", -F.col("ord"))).alias("best_ord"), F.max("overall").alias("best_overall"),
        F.min_by("ord", F.struct("overall", "ord")).alias("worst_ord"), F.min("overall").alias("worst_overall"))


def resumable_runs(runs: DataFrame, models: list[str], languages: list[str]) -> DataFrame:
    """Runs that are not done and have the same sets of models and languages."""
    same = lambda c, want: F.array_sort(F.array_distinct(c)) == F.array(*[F.lit(x) for x in sorted(set(want))])
    return runs.where((F.col("status") != "completed") & same("models", models) & same("languages", languages))


def grouping_report(results: DataFrame) -> DataFrame:
    """The home page's three tables in one scan: grouping sets (model), (language), ()."""
    rows = results.groupingSets([["model"], ["target_language"], []], "model", "target_language").agg(
        F.grouping_id().alias("level"), F.count("*").alias("total"), F.count_if(scored()).alias("successful"), *_means(scored()))
    return rows


def csv_rows(results: DataFrame) -> DataFrame:
    """K9: the export's columns as text, blank where there are no scores."""
    text = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.1f", F.col(c)))
    return results.select(
        "ord", F.col("source_text_id").cast("string").alias("source_text_id"), "target_language", "model", *[text(s).alias(s) for s in SCORES],
        F.col("translation_time_ms").cast("string").alias("translation_time_ms"), F.coalesce("error", F.lit("")).alias("error"),
        F.when(success(), "true").otherwise("false").alias("success"))


def group_categories(rows: DataFrame) -> DataFrame:
    """Categories by the place of their first row."""
    seen = rows.groupBy("category").agg(F.min("ord").alias("first_seen"), F.count("*").alias("n"))
    return seen.withColumn("position", F.row_number().over(Window.orderBy("first_seen")))  # one row a category
