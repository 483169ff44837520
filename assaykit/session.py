"""Session-level helpers: parallelism, lineage cuts, shared folders, fan-out joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parallelism(spark: SparkSession) -> int:
    """Partition count for CPU-bound stages whose input is small in bytes.

    AQE sizes partitions by bytes and would fold such a stage into one task, so the
    kernels repartition to an explicit number instead.
    """
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out to all cores, where its files give fewer splits than there are cores.

    For stages that cost much CPU per row; an input of many splits is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(scan: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A scan dealt out by the keys of the join that follows, about so many rows to a task.

    For tables whose rows expand into much work: neither the files' splits nor the bytes of a
    shuffle tell how much. The join takes the partitions as they are.
    """
    tasks = max(parallelism(scan.sparkSession), -(-scan.count() // rows))
    return scan.repartition(tasks, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``).

    Only where executors run in the driver's process (local mode) may it be left unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="assaykit-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/assaykit/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never replays the whole loop."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends and the size is known,
    so that a join with it is planned by what it really holds."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_once(c: Column) -> Column:
    """A costly expression as a one-element generator.

    Filters on a plain column are pushed below its projection and evaluate it again, once
    per filter; they cannot pass a generator.
    """
    return F.explode(F.array(c))


def fan_out(df: DataFrame, small: DataFrame, *spread_by: str | Column) -> DataFrame:
    """Pair every row of ``df`` with every row of the configuration table ``small``.

    Written as an equi-join on a salt rather than a cross join: when Spark measures
    ``small`` below the auto-broadcast threshold it becomes a broadcast hash join, and
    otherwise the salt spreads the product evenly over the shuffle partitions.
    """
    salts = parallelism(df.sparkSession)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                            F.lit(salts - 1).cast("bigint"))))
    return left.join(right, "_salt").drop("_salt")
