"""Cohort configuration: small dimensions, selection, records outside the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit import schemas


def cohort_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Cohort entries of a configuration file as a table; list order becomes ``ord``."""
    rows = [(e["id"], e.get("tier"), e.get("label"),
             float(e["generation"]) if e.get("generation") is not None else None,
             e.get("backend"), i) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, schemas.COHORT)


def requested_models(spark: SparkSession, requested: str) -> DataFrame:
    """A comma-separated selection as rows."""
    one = spark.range(1).select(F.lit(requested).alias("r"))
    return (one.select(F.explode(F.split("r", ",")).alias("model"))
            .select(F.trim("model").alias("model")).where("model <> ''").distinct())


def unknown_models(requested: DataFrame, cohort: DataFrame) -> DataFrame:
    return requested.join(cohort, "model", "left_anti")


def select_cohort(cohort: DataFrame, requested: str) -> DataFrame:
    """The requested part of the cohort; an unknown or empty selection raises.

    Runs one action on the selection, which is what the user typed.
    """
    if not requested:
        return cohort
    wanted = requested_models(cohort.sparkSession, requested)
    unknown = [r.model for r in unknown_models(wanted, cohort).collect()]
    if unknown or wanted.isEmpty():
        raise ValueError(f"unknown model id(s): {unknown or requested!r}")
    return cohort.join(wanted, "model", "left_semi")


def in_cohort(records: DataFrame, cohort: DataFrame) -> DataFrame:
    return records.join(cohort.select("model"), "model", "left_semi")


def outside_cohort(records: DataFrame, cohort: DataFrame) -> DataFrame:
    """Models that are not in the cohort, with their dropped record counts."""
    return (records.groupBy("model").agg(F.count("*").alias("n_dropped"))
            .join(cohort.select("model"), "model", "left_anti"))
