"""Prompt optimisation: fitness, folds, ranking, selection and reports.

Evaluations: ``prompt_id, text_id, is_test, success, accuracy, fluency, style, overall``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WEIGHTS, specific_terms


def _weighted() -> Column:
    return sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))


def base_scores(evaluations: DataFrame) -> DataFrame:
    """Means over the successful evaluations, weighted; 0 without any."""
    ok = [F.coalesce(F.avg(F.when(F.col("success"), F.col(c))), F.lit(0.0)) for c in WEIGHTS]
    base = sum((m * w for m, w in zip(ok, WEIGHTS.values())), F.lit(0.0))
    return evaluations.groupBy("prompt_id").agg(F.round(base, 6).alias("base_score"), F.count_if("success").alias("successes"), F.count("*").alias("evaluations"))


def fitness(evaluations: DataFrame, prompts: DataFrame | None = None, variance_weight: float = 0.1, length_limit: int = 500, length_rate: float = 0.001,
            term_rate: float = 0.05, gap_weight: float = 0.5, quick: bool = False) -> DataFrame:
    """Base score less the penalties for variance, length, specific terms and the gap between train and test.

    ``prompts``: prompt_id, text. ``quick`` takes all evaluations as training and knows no gap.
    """
    train = F.lit(True) if quick else ~F.col("is_test")
    rows = evaluations.withColumn("w", F.when(F.col("success"), _weighted())).withColumn("train", train)
    means = rows.groupBy("prompt_id").agg(
        F.coalesce(F.avg(F.when(F.col("train"), F.col("w"))), F.lit(0.0)).alias("train_score"), F.coalesce(F.avg(F.when(~F.col("train"), F.col("w"))), F.lit(0.0)).alias("test_score"),
        F.coalesce(F.var_samp(F.when(F.col("train"), F.col("w"))), F.lit(0.0)).alias("variance"))
    if prompts is not None:
        p = prompts.select("prompt_id", F.length("text").alias("length"), specific_terms(F.col("text")).alias("terms"))
        means = means.join(p, "prompt_id", "left").fillna(0, ["length", "terms"])
    else:
        means = means.withColumn("length", F.lit(0)).withColumn("terms", F.lit(0))
    gap = F.lit(0.0) if quick else F.greatest(F.lit(0.0), F.col("train_score") - F.col("test_score")) * gap_weight
    penalty = F.col("variance") * variance_weight + F.greatest(F.lit(0), F.col("length") - length_limit) * length_rate + F.col("terms") * term_rate + gap
    return means.select("prompt_id", *[F.round(c, 6).alias(c) for c in ("train_score", "test_score", "variance")], F.round(gap, 6).alias("gap_penalty"),
                        F.round(F.col("train_score") - penalty, 6).alias("fitness"))


def rank(prompts: DataFrame, order: str = "ord") -> DataFrame:
    """1-based, ties in the order of input."""
    return prompts.withColumn("position", F.row_number().over(Window.orderBy(F.desc("fitness"), order)))  # a population of prompts


def elites(prompts: DataFrame, k: int) -> DataFrame:
    """The k fittest."""
    return prompts.orderBy(F.desc("fitness"), "ord").limit(k)


def tournament(prompts: DataFrame, slots: int, size: int, seed: int) -> DataFrame:
    """For each slot the fittest of ``size`` prompts drawn without replacement by a hash of seed, slot and prompt."""
    drawn = prompts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    order = Window.partitionBy("slot").orderBy(F.xxhash64(F.lit(seed), "slot", "prompt_id"), "prompt_id")
    some = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= size)
    return some.groupBy("slot").agg(F.max_by("prompt_id", F.struct("fitness", -F.col("ord"))).alias("prompt_id"))


def iteration_summary(prompts: DataFrame) -> DataFrame:
    """Over fitness above 0."""
    f = F.when(F.col("fitness") > 0, F.col("fitness"))
    return prompts.groupBy("iteration").agg(
        F.coalesce(F.max(f), F.lit(0.0)).alias("best"), F.round(F.coalesce(F.avg(f), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.min(f), F.lit(0.0)).alias("worst"), F.count("*").alias("prompts_evaluated"))


def folds(items: DataFrame, k: int, holdout: int | None = 0) -> DataFrame:
    """Items (``ord`` 0..n-1) without the held-out one; fold i tests the i-th of the rest and trains on the others.
    k is at most the number of items; below 2 it is that number."""
    order = Window.orderBy("ord")  # a handful of texts
    rest = (items.where(F.col("ord") != holdout) if holdout is not None else items).withColumn("place", F.row_number().over(order) - 1)
    n = rest.agg(F.count("*").alias("n"))
    many = F.when((F.lit(k) < 2) | (F.lit(k) > F.col("n")), F.col("n")).otherwise(F.lit(k))
    numbers = n.select(F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)).alias("fold")).where("fold >= 0")
    return numbers.crossJoin(F.broadcast(rest)).select("fold", "ord", F.when(F.col("place") == F.col("fold"), "test").otherwise("train").alias("part"))


def simple_split(items: DataFrame, ratio: float) -> DataFrame:
    """The last max(1, floor(n ratio)) test."""
    w = Window.orderBy("ord")  # a handful of texts
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    test = F.row_number().over(w) > n - F.greatest(F.lit(1), F.floor(n * ratio))
    return items.select("ord", F.when(test, "test").otherwise("train").alias("part"))


def fold_of(iteration: Column, k: int) -> Column:
    """O14."""
    return (iteration - 1) % k


def config_warnings(texts: Column, fold_count: Column, elite: Column, population: Column, weights: Column) -> Column:
    """Z16."""
    return F.filter(F.array(
        F.when(texts < 2, "At least two texts are needed"), F.when(fold_count > texts, "More folds than texts"),
        F.when(elite >= population, "Elite count must be below the population"), F.when(F.abs(weights - 1.0) > 0.01, "Weights must sum to 1"),
    ), lambda x: x.isNotNull())


def weakness_lines(rows: DataFrame, k: int = 3, chars: int = 150) -> DataFrame:
    """The first k templates tried, cut to an excerpt, in one text."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("prompt_id").orderBy("ord"))).where(F.col("n") <= k)
    parts = F.array_sort(F.collect_list(F.struct("ord", F.substring("text", 1, chars).alias("t"))))
    return first.groupBy("prompt_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("tried"))
