"""Run outputs: versioned tables, run manifest, configuration provenance, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FROM_RUN = "run manifest"
FROM_LIVE = "live configuration"


def write_run(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the written partitions of a run table and leave all others alone."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*(partitions or ("run_id",))).parquet(path))


def replace_table(df: DataFrame, root: str) -> str:
    """Replace a table atomically: write a new version, then append its pointer.

    Readers follow the last pointer, so an interrupted write leaves the old version in
    force.  Returns the version path.
    """
    version = f"{root}/versions/{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark = df.sparkSession
    (spark.range(1).select(F.lit(version).alias("path"), F.current_timestamp().alias("at"))
     .coalesce(1).write.mode("append").parquet(f"{root}/pointer"))
    return version


def current_table(spark: SparkSession, root: str) -> DataFrame:
    """The version in force (reads one pointer row on the driver)."""
    last = (spark.read.parquet(f"{root}/pointer")
            .agg(F.max_by("path", "at").alias("path")).first())
    return spark.read.parquet(last.path)


def append_manifest(outputs: DataFrame, entry: DataFrame, path: str, out: str) -> None:
    """Write a phase's outputs and record its configuration only after they committed."""
    write_run(outputs, out, "run_id", "phase")
    entry.write.mode("append").parquet(path)


def latest_manifest(manifest: DataFrame) -> DataFrame:
    """The last entry per (run, phase): run_id, phase, written_at, settings."""
    return (manifest.groupBy("run_id", "phase")
            .agg(F.max_by(F.struct("written_at", "settings"), "written_at").alias("m"))
            .select("run_id", "phase", "m.*"))


def stamp_configuration(live: DataFrame, manifest: DataFrame) -> DataFrame:
    """What each run used: its own manifest where it has the setting, else live values.

    ``live``: phase, name, value.  ``manifest``: run_id, phase, written_at,
    settings MAP<STRING,STRING>.  Output one row per run, phase and setting.
    """
    last = latest_manifest(manifest)
    recorded = last.select("run_id", "phase", F.explode("settings").alias("name", "recorded"))
    wanted = last.select("run_id").distinct().withColumn(
        "phase", F.explode(F.array(F.lit("mc"), F.lit("open")))).join(live, "phase")
    return (wanted.join(recorded, ["run_id", "phase", "name"], "left")
            .select("run_id", "phase", "name",
                    F.coalesce("recorded", "value").alias("value"),
                    F.when(F.col("recorded").isNotNull(), FROM_RUN).otherwise(FROM_LIVE)
                    .alias("provenance")))


def publish(sections: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Write a table per section, then publish them all by one manifest row.

    Readers follow the manifest, so they see the sections of one evaluation or none of them.
    Returns the folder of this version.
    """
    version = f"{root}/versions/{uuid.uuid4().hex}"
    for name, df in sections.items():
        df.write.parquet(f"{version}/{name}")
    spark = next(iter(sections.values())).sparkSession
    (spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(version).alias("path"),
                           F.array(*[F.lit(n) for n in sections]).alias("sections"),
                           F.current_timestamp().alias("at"))
     .coalesce(1).write.mode("append").parquet(f"{root}/manifest"))
    return version


def published(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The sections that were published last for a run (reads one manifest row on the driver)."""
    last = (spark.read.parquet(f"{root}/manifest").where(F.col("run_id") == run_id)
            .orderBy(F.desc("at")).limit(1).collect())
    return {n: spark.read.parquet(f"{r.path}/{n}") for r in last for n in r.sections}
