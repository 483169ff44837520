"""Spend, latency and response shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.ranking import kth_value


def usage(records: DataFrame, by: list[str]) -> DataFrame:
    """Cost, tokens, attempts, cache hits, live calls and median latency per ``by``.

    Cost is what each record reports; spend on attempts that were retried is not in it.
    """
    hit = F.coalesce("cache_hit", F.lit(False))
    sums = records.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("attempts").alias("attempts"),
        F.count_if(hit).alias("cache_hits"), F.count_if(~hit).alias("live_calls"))
    median = kth_value(records, by, "duration_ms", F.floor(F.col("n") / 2)).select(
        *by, F.col("kth").alias("median_duration_ms"))
    return sums.join(median, by, "left")


def stop_reasons(records: DataFrame) -> DataFrame:
    return records.groupBy("model", "stop_reason").agg(F.count("*").alias("n"))


def text_length(records: DataFrame) -> DataFrame:
    """Median response length per model.

    Lengths collapse to counts before the percentile, which then weighs them.
    """
    counts = (records.groupBy("model", F.length("text").alias("chars"))
              .agg(F.count("*").alias("c")))
    return counts.groupBy("model").agg(
        F.sum("c").alias("n"), F.percentile("chars", F.lit(0.5), F.col("c"))
        .alias("median_chars"))
