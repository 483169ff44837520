"""Leaderboards: overall and grouped means, ranks, progressions, wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions.exact import exact_mean

MAJORITY = 0.5   # fixed value: item mean from which an item counts as mostly correct
BREAKDOWNS = ("dimension", "difficulty", "axis")


def sem(value: Column) -> Column:
    """Standard error of the mean; 0 for a single value."""
    return F.when(F.count(value) > 1,
                  F.stddev_samp(value) / F.sqrt(F.count(value))).otherwise(F.lit(0.0))


def _run_variance() -> Column:
    """Sample variance of 0/1 runs from their counts: no need to read responses again."""
    hits, runs = F.col("hits"), F.col("runs")
    return F.try_divide(hits * (runs - hits), runs * (runs - 1))


def within_item_sd(items: DataFrame) -> DataFrame:
    """Mean within-item standard deviation over runs, for items with more than one run."""
    return items.groupBy("model").agg(
        F.coalesce(F.avg(F.when(F.col("runs") > 1, F.sqrt(_run_variance()))), F.lit(0.0))
        .alias("mean_within_item_sd"))


def mc_overall(table: DataFrame) -> DataFrame:
    """Per-model accuracy from ``scoring.item_table``.

    The item is the sampling unit of the mean, the record that of the parse-fail rate.
    """
    p, runs = F.col("p"), F.col("runs")
    counters = ("n_calls", "n_call_failed", "served_mismatch_artifact",
                "served_mismatch_genuine", "n_unparsed")
    return (table.groupBy("model").agg(
        F.count(p).alias("n"), exact_mean(p).alias("mean"),
        F.when(F.count(p) > 0, sem(p)).alias("sem"),
        F.count_if(p >= MAJORITY).alias("majority_correct"),
        F.coalesce(F.avg(F.when(runs > 1, F.sqrt(_run_variance()))), F.lit(0.0))
        .alias("mean_within_item_sd"),
        *[F.sum(c).alias(c) for c in counters], F.sum(runs).alias("n_scoreable"))
        .withColumn("parse_fail_rate", F.try_divide("n_unparsed", "n_scoreable")))


def mc_breakdown(items: DataFrame, bank: DataFrame, *columns: str) -> DataFrame:
    """Mean over items by model and by each of ``columns``, in one aggregation.

    ``bank`` holds the metadata per ``question_id``.
    """
    columns = columns or BREAKDOWNS
    items = items.join(bank.select("question_id", *columns), "question_id")
    sets = [["model"]] + [["model", c] for c in columns]
    grouped = items.groupingSets([[F.col(x) for x in s] for s in sets],
                                 "model", *columns)
    mask = F.grouping_id("model", *columns)
    full = (1 << len(columns)) - 1
    label, level = F.lit("overall"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        bit = full ^ (1 << (len(columns) - 1 - i))
        label = F.when(F.col("_mask") == bit, F.lit(c)).otherwise(label)
        level = F.when(F.col("_mask") == bit, F.col(c)).otherwise(level)
    return (grouped.agg(mask.cast("int").alias("_mask"), F.count("*").alias("n"),
                        exact_mean(F.col("p")).alias("mean"), sem(F.col("p")).alias("sem"))
            .select("model", label.alias("breakdown"), level.alias("level"),
                    "n", "mean", "sem"))


def with_cohort(df: DataFrame, cohort: DataFrame) -> DataFrame:
    """Attach label, tier and generation; an unknown generation stays null."""
    return df.join(cohort.select("model", "label", "tier", "generation", "ord"), "model")


def ranked(overall: DataFrame, *ties: str) -> DataFrame:
    """Rank by mean, best first; a missing mean counts as 0; ties in cohort order."""
    order = W.orderBy(F.coalesce("mean", F.lit(0.0)).desc(), *(ties or ("ord",)))
    return overall.withColumn("rank", F.row_number().over(order))


def progression(overall: DataFrame) -> DataFrame:
    """Order within a tier by (generation, label) with the step from the model before."""
    order = W.partitionBy("tier").orderBy(F.coalesce("generation", F.lit(0.0)), "label")
    return (overall.where(F.col("mean").isNotNull())
            .withColumn("position", F.row_number().over(order))
            .withColumn("previous", F.lag("model").over(order))
            .withColumn("step", F.col("mean") - F.lag("mean").over(order)))


def step_significance(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attach the family-wise verdict of each progression step."""
    both = pairs.select(F.col("a").alias("model"), F.col("b").alias("previous"),
                        "p_holm", "significant").unionByName(
        pairs.select(F.col("b").alias("model"), F.col("a").alias("previous"),
                     "p_holm", "significant"))
    return steps.join(both, ["model", "previous"], "left")


def score_by_size(overall: DataFrame, tiers: DataFrame) -> DataFrame:
    """Points of the score-versus-size curves: sized tiers with a known size."""
    sized = tiers.where("sized").select("tier")
    order = W.partitionBy("tier").orderBy("generation", "model")
    return (overall.join(sized, "tier", "left_semi")
            .where(F.col("mean").isNotNull() & (F.coalesce("generation", F.lit(0.0)) != 0))
            .withColumn("position", F.row_number().over(order)))


def axes_together(mc: DataFrame, open_: DataFrame) -> DataFrame:
    """Choice score against open score, for models that have both."""
    return (mc.where(F.col("mean").isNotNull()).select("model", F.col("mean").alias("mc_mean"))
            .join(open_.where(F.col("mean").isNotNull())
                  .select("model", F.col("mean").alias("open_mean")), "model"))


def wide(breakdown: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row per model, one column per level in the given order; missing cells null."""
    return (breakdown.where(F.col("breakdown") == column)
            .groupBy("model").pivot("level", order).agg(F.first("mean"))
            .select("model", *order))


def totals(overall: DataFrame) -> DataFrame:
    """Provenance totals and score spread over a report."""
    best = F.max(F.struct(F.coalesce("mean", F.lit(0.0)).alias("m"),
                          (-F.col("ord")).alias("o"), F.col("model").alias("model")))
    return overall.agg(
        F.count("*").alias("n_models"),
        F.sum("served_mismatch_genuine").alias("n_genuine"),
        F.sum("served_mismatch_artifact").alias("n_artifact"),
        F.sum("n_call_failed").alias("n_failed"),
        F.max("mean").alias("top"), F.min("mean").alias("bottom"),
        (F.max("mean") - F.min("mean")).alias("spread"), best["model"].alias("top_model"))


def significance_counts(pairs: DataFrame, p: str = "p_bootstrap", alpha: float = 0.05) -> DataFrame:
    """How many comparisons of each family have a small p-value, and how many survive the
    correction."""
    return pairs.groupBy("family").agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col(p) < alpha).alias("n_nominal"),
        F.count_if("significant").alias("n_significant"))


def significance_by_tier(pairs: DataFrame, cohort: DataFrame) -> DataFrame:
    """Surviving comparisons by the tiers of both sides."""
    a = cohort.select(F.col("model").alias("a"), F.col("tier").alias("tier_a"))
    b = cohort.select(F.col("model").alias("b"), F.col("tier").alias("tier_b"))
    return (pairs.join(a, "a").join(b, "b").groupBy("tier_a", "tier_b")
            .agg(F.count("*").alias("n_pairs"),
                 F.count_if("significant").alias("n_significant")))
