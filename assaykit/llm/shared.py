"""Spark-side helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.session import cut_lineage, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends, the size is known."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of this session hold about ``size`` bytes at most, where it keeps Spark's
    default: 64 MB a batch, several times over in every task, is much for small executors."""
    if spark.conf.get(ARROW_BYTES, ARROW_DEFAULT) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, str(size))


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_llm_row``: the place of a row by (file split, row in it).

    It is the same each time an unchanged table is read with unchanged settings of file splits
    within one session; two reads that split the files otherwise would not agree, so both
    reads of a caller must come from one DataFrame.
    """
    return docs.withColumn("_llm_row", F.monotonically_increasing_id())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node that links reach.

    Alternating large-star and small-star steps: each node hooks its neighbours to the least
    node it knows, which needs a logarithmic number of rounds. Every step is one grouped
    minimum and one join on the node; a node with very many neighbours is combined before the
    shuffle and its join side is split by adaptive execution. Self-links keep lone nodes.
    """
    state = cut_lineage(_pairs(edges))
    before = None
    while True:
        state = cut_lineage(_small_star(_large_star(state)))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    least = state.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
    return cut_lineage(nodes.join(least, "node", "left")
                       .select("node", F.coalesce("_least", "node").alias("component")))


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct links with the larger node first."""
    return (edges.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(
        "a", F.least("_m", "a").alias("_m"))
    return (both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("_m"))
    moved = pairs.join(least, "a")
    return (moved.select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .union(moved.select("a", F.col("_m").alias("b"))).where("a <> b").distinct())
