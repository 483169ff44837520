"""Model pairs: shared items, discordance tests, family-wise correction."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions.exact import FINE, UNIT, in_fine_units
from assaykit.operators.leaderboard import MAJORITY

EXACT_BELOW = 25   # fixed value: discordant pairs up to which the binomial test is used
ALPHA = 0.05       # fixed value: family-wise level

def shared_items(items: DataFrame, cohort: DataFrame, value: str = "p",
                 item: str = "question_id") -> DataFrame:
    """Every item both models of a pair answered, first model earlier in cohort order.

    ``items`` is unique on (model, item), so a join key holds at most one row per cohort
    model however hot the item is in the log, and no join row is shuffled: all consumers
    aggregate per pair directly above the join.
    """
    side = items.join(cohort.select("model", "ord"), "model").select(
        item, F.col("model"), F.col("ord"), F.col(value).alias("v"))
    a = side.select(F.col(item).alias("_item"), F.col("model").alias("a"),
                    F.col("ord").alias("ord_a"), F.col("v").alias("va"))
    b = side.select(F.col(item).alias("_item"), F.col("model").alias("b"),
                    F.col("ord").alias("ord_b"), F.col("v").alias("vb"))
    return (a.join(b, (a["_item"] == b["_item"]) & (a["ord_a"] < b["ord_b"]))
            .select("a", "b", "va", "vb", a["_item"].alias("item")))


def difference_histogram(shared: DataFrame) -> DataFrame:
    """Counts of per-item differences per pair, in fine integer units, with the items that
    only one side gets mostly right."""
    ra, rb = F.col("va") >= MAJORITY, F.col("vb") >= MAJORITY
    return (shared.groupBy("a", "b", (in_fine_units(F.col("va")) - in_fine_units(F.col("vb"))).alias("v"))
            .agg(F.count("*").alias("c"), F.count_if(ra & ~rb).alias("only_a"),
                 F.count_if(~ra & rb).alias("only_b")))


def discordance(histogram: DataFrame) -> DataFrame:
    """Shared items, mean difference and discordant counts per pair."""
    n = F.sum("c")
    total = F.sum(F.col("v").cast("decimal(19,0)") * F.col("c").cast("decimal(12,0)"))
    off = F.when(F.abs(total) <= n, F.lit(0.0)).otherwise(total.cast("double"))
    return histogram.groupBy("a", "b").agg(
        n.alias("n_items"), (off / F.lit(float(FINE)) / n / UNIT).alias("diff"),
        F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))


def mcnemar(df: DataFrame) -> DataFrame:
    """McNemar's test on ``only_a`` / ``only_b``: exact binomial for few discordant items,
    otherwise chi-square with continuity correction."""
    @F.pandas_udf("double")
    def chi2_tail(stat: pd.Series) -> pd.Series:
        return stat.map(lambda x: math.erfc(math.sqrt(x / 2)), na_action="ignore")

    b, c = F.col("only_a"), F.col("only_b")
    n, low = b + c, F.least(b, c)
    # running binomial term C(n,i), summed up to the smaller discordant count
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), low),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, i: F.struct((s["term"] * (n - i) / (i + 1)).alias("term"),
                              (s["total"] + s["term"]).alias("total")),
        lambda s: s["total"])
    exact = F.when(n < EXACT_BELOW, F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n)))
    stat = F.when(n >= EXACT_BELOW, F.pow(F.abs(b - c) - 1, F.lit(2)) / n)
    return (df.withColumn("mcnemar_stat", F.coalesce(stat, low.cast("double")))
              .withColumn("mcnemar_p", F.coalesce(exact, chi2_tail(stat))))


def mcnemar_edwards(df: DataFrame) -> DataFrame:
    """Edwards form with the correction clamped at zero: 0 discordant items give p = 1."""
    @F.pandas_udf("double")
    def chi2_tail(stat: pd.Series) -> pd.Series:
        return stat.map(lambda x: math.erfc(math.sqrt(x / 2)), na_action="ignore")

    b, c = F.col("only_a"), F.col("only_b")
    stat = F.coalesce(F.try_divide(F.pow(F.greatest(F.lit(0), F.abs(b - c) - 1), F.lit(2)),
                                   b + c), F.lit(0.0))
    return df.withColumn("edwards_stat", stat).withColumn("edwards_p", chi2_tail(stat))


def holm(df: DataFrame, family: list[str], p: str, *ties: str,
         alpha: float = ALPHA) -> DataFrame:
    """Step-down adjusted p-values per family and the family-wise verdict.

    A family holds one row per model pair of a run, so the window is bounded by the
    square of the cohort size and does not grow with the data.
    """
    by = [F.col(c) for c in family] if family else [F.lit(0)]
    order = W.partitionBy(*by).orderBy(p, *ties)
    step = (F.count("*").over(W.partitionBy(*by)) - F.row_number().over(order) + 1) * F.col(p)
    return (df.withColumn("_step", step)
              .withColumn("_adj", F.least(F.lit(1.0), F.max("_step").over(
                  order.rowsBetween(W.unboundedPreceding, 0))))
              .withColumn("p_holm", F.bround("_adj", 5))
              .withColumn("significant", F.col("_adj") < alpha)
              .drop("_step", "_adj"))


def resolution_ok(df: DataFrame, family: list[str], resamples: int,
                  alpha: float = ALPHA) -> DataFrame:
    """Whether the family is small enough for the smallest possible p to be significant."""
    by = [F.col(c) for c in family] if family else [F.lit(0)]
    m = F.count("*").over(W.partitionBy(*by))
    return df.withColumn("floor_ok", 2 * m / F.lit(resamples + 1) < alpha)


def by_effect(pairs: DataFrame) -> DataFrame:
    """Pair report order: largest absolute difference first."""
    return pairs.orderBy(F.abs("diff").desc(), "a", "b")
