"""Classical item analysis over the complete respondent matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.latest import last_values

CEILING, FLOOR, LOW_DISCRIMINATION = 0.95, 0.30, 0.10  # fixed values: report thresholds


def last_outcome(scored: DataFrame, item: str, seq: str) -> DataFrame:
    """One 0/1 outcome per (model, run, item): the last record by ``seq`` (BIGINT) wins."""
    outcomes = scored.select("model", "run_index", item, F.col("correct").cast("int").alias("x"), seq)
    return last_values(outcomes, ["model", "run_index", item], seq)


def item_analysis(outcomes: DataFrame, item: str = "question_id") -> DataFrame:
    """Difficulty and corrected item-total discrimination of the complete items.

    ``outcomes``: model, run_index, ``item``, x.  Only items that every respondent (model
    and run) answered count.  The correlation of x with the respondent's total over the
    other items comes from moments; it is null when either side is constant.  The number
    of respondents is bounded by cohort size times runs.  ``outcomes`` is read four times:
    pass a stored, checkpointed or persisted table.
    """
    n_resp = outcomes.select("model", "run_index").distinct().agg(F.count("*").alias("r"))
    per_item = outcomes.groupBy(item).agg(F.count("*").alias("answered"))
    complete = (per_item.join(n_resp, F.col("answered") == F.col("r"))
                .select(F.col(item), "r"))
    kept = outcomes.join(complete, item)
    totals = kept.groupBy("model", "run_index").agg(F.sum("x").alias("total"))
    x = F.col("x").cast("bigint")
    rest = F.col("rest")
    moments = (kept.join(totals, ["model", "run_index"])
               .withColumn("rest", F.col("total") - x)
               .groupBy(item).agg(
                   F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(rest).alias("sy"),
                   F.sum(x * rest).alias("sxy"),
                   F.sum((rest * rest).cast("decimal(38,0)")).alias("syy"),
                   F.min("x").alias("x0"), F.max("x").alias("x1"),
                   F.min("rest").alias("y0"), F.max("rest").alias("y1")))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = (n * F.col("sxy") - sx * sy).cast("double")
    var_x = (n * sx - sx * sx).cast("double")
    var_y = n.cast("double") * F.col("syy").cast("double") - sy.cast("double") * sy
    defined = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return moments.select(
        item, (sx / n).alias("difficulty_p"),
        F.when(defined, F.try_divide(cov, F.sqrt(var_x * var_y))).alias("discrimination"),
        n.alias("n_resp"))


def item_summary(analysis: DataFrame) -> DataFrame:
    p, d = F.col("difficulty_p"), F.col("discrimination")
    return analysis.agg(
        F.count("*").alias("n_items"), F.avg(p).alias("mean_difficulty_p"),
        F.avg(d).alias("mean_discrimination"),
        F.count(d).alias("n_items_with_discrimination"),
        F.count_if(p > CEILING).alias("n_ceiling"), F.count_if(p < FLOOR).alias("n_floor"),
        F.count_if(d < LOW_DISCRIMINATION).alias("n_low_discrimination"))


def hardest(analysis: DataFrame, item: str = "question_id", k: int = 10) -> DataFrame:
    """The ``k`` hardest items."""
    return analysis.orderBy("difficulty_p", item).limit(k)
