"""Registered queries: a Spark callable each, with the SQL that checks it where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.exact import UNIT
from assaykit.plans.fixtures import check_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

SEED = 19470417      # fixed value: the published seed
DIGITS = 6


def query(name: str, check: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(fn(spark, sf_dir))
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn
    return register


def shaped(df: DataFrame) -> DataFrame:
    """Stable output types: integers as BIGINT, fractions as DOUBLE rounded for comparison."""
    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.round(c.cast("double"), DIGITS).alias(f.name)
        return c
    return df.select(*[column(f) for f in df.schema.fields])


FEW_ITEMS = 25   # the normal bounds are no guide for fewer items


def near_normal(df: DataFrame, mean: str = "mean", sem: str = "sem", n: str = "n") -> DataFrame:
    """``lo`` and ``hi``, which are drawn, replaced by whether they lie within half a standard
    error of the normal bounds (true for few items): a check of a drawn interval that SQL can
    state."""
    def near(column: str, z: float):
        off = F.abs(F.col(column) - (F.col(mean) + z * F.col(sem)))
        ok = off <= 0.5 * F.col(sem) + 1e-4   # results have 4 digits
        return F.when(F.col(n) < FEW_ITEMS, F.lit(True)).otherwise(ok).alias(f"{column}_near")

    kept = [c for c in df.columns if c not in ("lo", "hi")]
    return df.select(*kept, near("lo", -1.96), near("hi", 1.96))


NEAR = "true AS lo_near, true AS hi_near"


def using(*fixtures: str) -> str:
    """``WITH`` clause holding the named fixtures."""
    return "WITH " + ", ".join(f"{n} AS ({check_sql(n)})" for n in fixtures)


# Call classes, scoreable calls and item means, as the checks compute them.
SCORED = f""", med AS (
  SELECT model, list_sort(list(cost_micro))[count(*) // 2 + 1] AS med FROM responses
  WHERE call_ok AND model_served = model GROUP BY model),
cls AS (SELECT r.*, CASE WHEN NOT call_ok THEN 'failed' WHEN model_served = model THEN 'clean'
    WHEN med > 0 AND cost_micro / med > 0.5 THEN 'artifact' ELSE 'genuine' END AS call_class
  FROM responses r LEFT JOIN med USING (model)),
sc AS (SELECT * FROM cls WHERE call_class IN ('clean', 'artifact')),
pi AS (SELECT model, question_id, any_value(dimension) AS dimension,
    any_value(difficulty) AS difficulty, any_value(axis) AS axis, any_value(ord) AS ord,
    count(*) AS runs, sum(CAST(correct AS INT)) AS hits,
    sum(CAST(correct AS INT)) / count(*) AS p,
    CAST(round(sum(CAST(correct AS INT)) / count(*) * {UNIT}) AS BIGINT) AS pu
  FROM sc GROUP BY model, question_id)"""
MEAN = f"(sum(pu) / count(*) / {UNIT})"   # mean of p in exact units
