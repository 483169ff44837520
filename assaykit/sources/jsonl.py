"""JSONL edges: strict scan, tolerant scan, sink, text lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict scan: blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines for the damage-aware scan; an absent path is an empty log."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], "value string")


def write_jsonl(df: DataFrame, path: str) -> int:
    """Write UTF-8 JSONL with explicit nulls; returns the row count of the same pass."""
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("n"))
       .write.mode("overwrite").option("ignoreNullFields", "false").json(path))
    return seen.get["n"]
