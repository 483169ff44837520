"""Judge panels: from verdict payloads to composites and their roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions.exact import exact_mean
from assaykit.functions.judging import (clamped, counts, strict_number, with_last_object,
                                        with_numbers)
from assaykit.operators.latest import last_values
from assaykit.operators.leaderboard import sem
from assaykit.session import computed_once

FULL = 100.0  # fixed value: the composite scale
TRIPLE = ("model", "question_id", "run_index")
HITS, TOTAL, VIOLATIONS = "must_include_hits", "must_include_total", "should_not_violations"


def is_primary() -> Column:
    """A verdict without a role predates cross-checking and is primary."""
    return F.coalesce(F.col("judge_role"), F.lit("primary")) == "primary"


def primary(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(is_primary())


def parse_verdicts(raw: DataFrame, dims: list[str], text: str = "text") -> DataFrame:
    """Adds ``scores`` (VARIANT, null when nothing usable was found) and ``parse_ok``."""
    ok = F.coalesce(F.col("call_ok"), F.lit(True)) if "call_ok" in raw.columns else F.lit(True)
    return (with_last_object(raw, F.when(ok, F.col(text)), "scores", dims)
            .withColumn("parse_ok", F.col("scores").isNotNull()))


def sanitise(verdicts: DataFrame, dims: list[str]) -> DataFrame:
    """Typed, clamped judge numbers next to the keys; the payload itself is dropped."""
    v = F.col("scores")
    counted = F.col("_hits").isNotNull() & (F.col("_total") != 0)
    # an empty payload is no judge
    judged = v.isNotNull() & (F.to_json(v) != "{}")
    read = with_numbers(verdicts, v, {**{d: d for d in dims}, "_hits": HITS, "_total": TOTAL,
                                      "violations": VIOLATIONS})
    return (read
            .withColumns({**{d: clamped(F.col(d)) for d in dims},
                          **{c: counts(F.col(c)) for c in ("_hits", "_total", "violations")}})
            .withColumn("hits", F.when(counted, F.least("_hits", "_total")))
            .withColumn("points", F.when(counted, F.col("_total")))
            .withColumn("judged", F.coalesce(judged, F.lit(False)))
            .drop("scores", "_hits", "_total"))


def last_per_judge(verdicts: DataFrame, seq: str) -> DataFrame:
    """One verdict per (triple, persona): the last by ``seq`` (BIGINT) wins. Numbers and flags
    only; text columns go."""
    return last_values(verdicts, [*TRIPLE, "persona"], seq)


def _mean_of(columns: list[Column]) -> Column:
    """Mean of the columns that are present."""
    known = F.array_compact(F.array(*columns))
    total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total, F.size(known))


def panel_scores(verdicts: DataFrame, dims: list[str]) -> DataFrame:
    """Panel aggregate per triple over sanitised verdicts.

    Missing ratings and counts stay missing; a panel without any verdict keeps its row.
    """
    agg = verdicts.groupBy(*TRIPLE).agg(
        *[F.avg(d).alias(d) for d in dims],
        F.try_divide(F.sum("hits"), F.sum("points")).alias("must_include_coverage"),
        F.avg("violations").alias("mean_should_not_violations"),
        F.count_if("judged").alias("n_judges"))
    five = _mean_of([F.col(d) for d in dims])
    pairs = [x for d in dims for x in (F.lit(d), F.col(d))]
    return agg.select(*TRIPLE, F.create_map(*pairs).alias("dim_means"),
                      five.alias("composite_5"), ((five - 1) / 4 * 100).alias("composite_100"),
                      "must_include_coverage", "mean_should_not_violations", "n_judges")


def open_items(scores: DataFrame) -> DataFrame:
    """Mean composite per (model, item): the only input of the open intervals."""
    return (scores.where(F.col("composite_100").isNotNull())
            .groupBy("model", "question_id")
            .agg(exact_mean(F.col("composite_100"), FULL).alias("p"), F.count("*").alias("runs")))


def open_overall(scores: DataFrame) -> DataFrame:
    """Per-model open result: item-level mean, record-level coverage and violations."""
    means = open_items(scores).groupBy("model").agg(
        F.count("*").alias("n"), exact_mean(F.col("p"), FULL).alias("mean"), sem(F.col("p")).alias("sem"))
    records = scores.groupBy("model").agg(
        F.count_if(F.col("composite_100").isNull()).alias("n_unscored_records"),
        F.avg("must_include_coverage").alias("mean_must_include_coverage"),
        F.avg("mean_should_not_violations").alias("mean_should_not_violations"))
    return (records.join(means, "model", "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))))


def open_by_dimension(scores: DataFrame) -> DataFrame:
    """Open means by dimension over item means, not over correlated run records."""
    items = (scores.where(F.col("composite_100").isNotNull())
             .groupBy("model", "dimension", "question_id")
             .agg(exact_mean(F.col("composite_100"), FULL).alias("p")))
    return items.groupBy("model", "dimension").agg(
        F.count("*").alias("n"), exact_mean(F.col("p"), FULL).alias("mean"), sem(F.col("p")).alias("sem"))


def judge_dimension_means(scores: DataFrame) -> DataFrame:
    """Two-level judge-dimension means per model, with the model's weakest dimension."""
    long = scores.select("model", "question_id",
                         F.explode("dim_means").alias("judge_dimension", "v"))
    items = (long.where(F.col("v").isNotNull())
             .groupBy("model", "judge_dimension", "question_id").agg(exact_mean(F.col("v")).alias("v")))
    means = items.groupBy("model", "judge_dimension").agg(
        F.bround(exact_mean(F.col("v")), 3).alias("mean"))
    per_model = W.partitionBy("model").orderBy("mean", "judge_dimension")
    return means.withColumn("weakest", F.row_number().over(per_model) == 1)


def complete_ratings(verdicts: DataFrame, dims: list[str], *extra: str) -> DataFrame:
    """Raw ratings of primary verdicts that rate *every* dimension with a number.

    Columns: triple, persona, one per dimension, and their mean ``composite``.
    """
    raw = primary(verdicts).select(
        *TRIPLE, "persona", *extra,
        *[strict_number(F.col("scores"), d).alias(d) for d in dims])
    full = raw.where(reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in dims]))
    return full.withColumn("composite", sum(F.col(d) for d in dims) / len(dims))


def last_complete(verdicts: DataFrame, dims: list[str], seq: str) -> DataFrame:
    """Complete ratings, one per (triple, persona): the last by ``seq`` (BIGINT) wins."""
    return last_values(complete_ratings(verdicts, dims, seq), [*TRIPLE, "persona"], seq)


def crosscheck_pairs(verdicts: DataFrame, dims: list[str], seq: str) -> DataFrame:
    """Primary and cross-check ratings of the same response by the same persona.

    Of repeated verdicts, the last by ``seq`` (BIGINT) that holds a rating counts.
    """
    keys = [*TRIPLE, "persona"]
    names = {f"_{d}": d for d in dims}
    typed = with_numbers(verdicts, F.col("scores"), names).select(
        *keys, seq,
        F.when(is_primary(), "primary").otherwise(F.col("judge_role")).alias("role"),
        computed_once(_mean_of([clamped(F.col(c)) for c in names])).alias("score"))

    def last(role: str) -> Column:
        rated = (F.col("role") == role) & F.col("score").isNotNull()
        return F.max_by("score", F.when(rated, F.col(seq))).alias(role)

    return (typed.groupBy(*keys).agg(last("primary"), last("crosscheck"))
            .where(F.col("primary").isNotNull() & F.col("crosscheck").isNotNull()))


def crosscheck_agreement(pairs: DataFrame) -> DataFrame:
    """Mean difference and correlation of the two judges, per model.

    The correlation is built from moments, so a constant side gives null.
    """
    x, y, n = F.col("primary"), F.col("crosscheck"), F.count("*")
    sums = pairs.groupBy("model").agg(
        n.alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        F.max(x).alias("x1"), F.min(x).alias("x0"), F.max(y).alias("y1"), F.min(y).alias("y0"))
    c = F.col
    spread = (c("x0") < c("x1")) & (c("y0") < c("y1"))
    root = F.sqrt(c("n") * c("sxx") - c("sx") * c("sx")) * F.sqrt(
        c("n") * c("syy") - c("sy") * c("sy"))
    return sums.select(
        "model", "n", ((c("sx") - c("sy")) / c("n")).alias("mean_diff"),
        F.when(spread, F.try_divide(c("n") * c("sxy") - c("sx") * c("sy"), root)).alias("corr"))
