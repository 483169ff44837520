"""Which wrong choice types pull which models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import LETTERS


def trap_rates(scored: DataFrame, items: DataFrame) -> DataFrame:
    """Chosen and offered counts per model, dimension, difficulty and distractor type.

    Responses collapse to letter counts per (model, item) before the join, so the
    explosion over at most six choices works on the reduced table.
    """
    chosen = (scored.groupBy("model", "question_id", "parsed_letter")
              .agg(F.count("*").alias("times")))
    kinds = items.where(F.col("distractor_types").isNotNull()).select(
        "question_id", "dimension", "difficulty", "distractor_types")
    slots = chosen.join(kinds, "question_id").select(
        "model", "dimension", "difficulty", "times",
        (F.instr(F.lit(LETTERS), F.col("parsed_letter")) - 1).alias("picked"),
        F.posexplode("distractor_types").alias("slot", "distractor_type"))
    return (slots.where(F.col("distractor_type") != "correct")
            .groupBy("model", "dimension", "difficulty", "distractor_type")
            .agg(F.sum("times").alias("offered"),
                 F.coalesce(F.sum(F.when(F.col("slot") == F.col("picked"), F.col("times"))),
                            F.lit(0).cast("bigint")).alias("chosen"))
            .withColumn("pull_rate", F.col("chosen") / F.col("offered")))
