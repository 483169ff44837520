"""Inter-rater reliability from moments: two hash aggregations, no pair loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def krippendorff_alpha(ratings: DataFrame, by: list[str]) -> DataFrame:
    """Interval-metric alpha per ``by`` over rows (by, unit, value); one row per rating.

    For m ratings of a unit, the squared differences over its pairs sum to
    m*sum(v^2) - sum(v)^2, and likewise over all ratings, so both disagreements follow
    from sums.  Units with one rating do not count; alpha is null without two ratings or
    when all ratings are equal.
    """
    units = (ratings.where(F.col("value").isNotNull()).groupBy(*by, "unit").agg(
        F.count("*").alias("m"), F.sum("value").alias("s"),
        F.sum(F.col("value") * F.col("value")).alias("q"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
        .where("m >= 2"))
    m, s, q = F.col("m"), F.col("s"), F.col("q")
    whole = units.groupBy(*by).agg(
        F.count("*").alias("n_units"), F.sum("m").alias("n"), F.sum("s").alias("s"),
        F.sum("q").alias("q"), F.sum(2 * (m * q - s * s) / (m - 1)).alias("pairs"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    n = F.col("n")
    observed = F.col("pairs") / n
    expected = 2 * (n * q - s * s) / (n * (n - 1))
    return whole.select(*by, "n_units", F.when(
        F.col("lo") < F.col("hi"), 1 - F.try_divide(observed, expected)).alias("alpha"))


def judge_agreement(complete: DataFrame, dims: list[str]) -> DataFrame:
    """Alpha of the persona composites and of each dimension, one row per metric.

    ``complete`` comes from ``panel.complete_ratings`` with one row per (triple, persona).
    """
    metrics = ["composite", *dims]
    long = complete.select(
        F.struct("model", "question_id", "run_index").alias("unit"), "persona",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                           for m in metrics])))
    return krippendorff_alpha(long, ["metric"])


def judge_agreement_summary(complete: DataFrame, dims: list[str]) -> DataFrame:
    """Composite alpha, weakest dimension alpha, number of personas and units."""
    alphas = judge_agreement(complete, dims)
    wide = alphas.agg(
        F.max(F.when(F.col("metric") == "composite", F.bround("alpha", 4))).alias("alpha"),
        F.min(F.when(F.col("metric") != "composite", F.bround("alpha", 4)))
        .alias("min_dimension_alpha"))
    size = complete.agg(
        F.count_distinct(F.struct("model", "question_id", "run_index")).alias("n_units"),
        F.count_distinct("persona").alias("n_personas"))
    both = wide.unionByName(size, allowMissingColumns=True)  # two one-row results
    return (both.agg(*[F.max(name).alias(name) for name in both.columns])
            .where("n_personas >= 2"))


def fleiss_kappa(ratings: DataFrame, categories: int) -> DataFrame:
    """Kappa over rows (unit, category), category in [0, categories): one row.

    Ragged units and categories out of range stop the job rather than bend the result.
    Null for no units or fewer than two raters; 1.0 when only one category is used.
    """
    inside = F.col("category").between(0, categories - 1)
    checked = F.when(inside, F.col("category")).otherwise(
        F.raise_error(F.concat(F.lit("category out of range: "),
                               F.col("category").cast("string"))).cast("int"))
    tallies = [F.count_if(F.col("c") == j).cast("bigint").alias(f"c{j}")
               for j in range(categories)]
    per_unit = ratings.select("unit", checked.alias("c")).groupBy("unit").agg(*tallies)
    cols = [F.col(f"c{j}") for j in range(categories)]
    units = per_unit.select(*cols, sum(cols).alias("n"), sum(c * c for c in cols).alias("sq"))
    whole = units.agg(
        F.count("*").alias("units"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.sum("sq").alias("sq"), *[F.sum(c).alias(f"t{j}") for j, c in enumerate(cols)])
    n, N = F.col("lo"), F.col("units")
    ragged = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.lit(
        "fleiss_kappa: units differ in their number of raters")).cast("double"))
    observed = F.try_divide(F.col("sq") - N * n, N * n * (n - 1))
    chance = sum(F.pow(F.try_divide(F.col(f"t{j}"), N * n), F.lit(2)) for j in range(categories))
    single = F.greatest(*[F.col(f"t{j}") for j in range(categories)]) == N * n
    kappa = (F.when(ragged.isNotNull(), ragged)
              .when((N == 0) | (n < 2), F.lit(None).cast("double"))
              .when(single, F.lit(1.0))
              .otherwise(F.try_divide(observed - chance, 1 - chance)))
    return whole.select("units", n.alias("raters"), kappa.alias("kappa"))
