"""Open runs wave by wave: a quorum audit that is carried along, not repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.operators.audit import open_signals, panel_counts
from assaykit.operators.panel import TRIPLE
from assaykit.session import stored
from assaykit.streaming.intake import GRACE_WAVES, MAX_WAVES, wave_decision

STATE = f"{', '.join(f'{k} string' for k in TRIPLE)}, judges long, wave long"
SUMS = ("gf", "gt", "gc", "jf", "jt", "jc", "judged_triples", "short")
COUNTS = ", ".join(f"{c} long" for c in (*SUMS, "wave"))


class OpenWaves:
    """The audit of an open run after each wave of lines, up to the one that ends it.

    State is the number of readable primary verdicts of each triple. A wave's lines are read and
    parsed once; they change some triples, whose new numbers are written with the wave's number
    beside what the wave adds to the run's counts: lines, failures, damage, panels judged,
    panels below the quorum (fewer when one is filled). Both signals are running sums of
    these rows. A replayed wave replaces its own rows and reads only those of waves before it.

    ``take`` is a ``foreachBatch`` function, one micro-batch being one wave. Lines have ``log``
    (response or verdict) and ``value``. A wave without lines counts as a wave. Waves after the
    end are not read.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int, n_personas: int, needed: int,
                 grace: int = GRACE_WAVES, most: int = MAX_WAVES):
        self.spark, self.expected, self.n_personas, self.needed = spark, expected, n_personas, needed
        self.grace, self.most = grace, most
        self.state_path, self.counts_path = f"{path}/state", f"{path}/counts"
        for p, schema in ((self.state_path, STATE), (self.counts_path, COUNTS)):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("wave").parquet(p)

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _write(self, df: DataFrame, path: str, number: int) -> None:
        (df.withColumn("wave", F.lit(number).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("wave").parquet(path))

    def take(self, lines: DataFrame, number: int) -> None:
        ended = self.states().where((F.col("decision") != "continue") & (F.col("waves") <= number))
        if not ended.isEmpty():
            return
        read = stored(panel_counts(lines, "log"), "wave")
        triple = F.struct(*TRIPLE)
        now = (read.where("log = 'verdict' AND counts")
               .select(triple.alias("t"), F.col("judges").alias("added")))
        earlier = self._read(self.state_path, STATE).where(F.col("wave") < number)
        # numbers only grow, so the largest is the latest
        known = (earlier.select(triple.alias("t"), "judges").join(now.select("t"), "t", "left_semi")
                 .groupBy("t").agg(F.max("judges").alias("before")))
        changed = stored(now.join(known, "t", "left").withColumn(
            "judges", F.coalesce("before", F.lit(0)) + F.col("added")), "changed")
        self._write(changed.select("t.*", "judges"), self.state_path, number)

        def total(log: str, name: str):
            return F.coalesce(F.sum(F.when(F.col("log") == log, F.col(name))), F.lit(0))

        def below(name: str):
            return F.count_if(F.col(name) < self.needed)

        sums = read.agg(*[total(log, name).alias(short + name[0]) for log, short in
                          (("response", "g"), ("verdict", "j")) for name in ("failed", "total", "corrupt")])
        moved = changed.agg(F.count_if(F.col("before").isNull()).alias("judged_triples"),
                            (below("judges") - below("before")).alias("short"))
        both = sums.unionByName(moved, allowMissingColumns=True)   # two one-row results
        self._write(both.agg(*[F.max(c).alias(c) for c in SUMS]), self.counts_path, number)

    def states(self) -> DataFrame:
        """waves, have, both signals, ``below_quorum`` and the decision after each wave."""
        so_far = W.partitionBy(F.lit(0)).orderBy("wave").rowsBetween(W.unboundedPreceding, 0)
        sums = self._read(self.counts_path, COUNTS).select(
            (F.col("wave") + 1).alias("waves"), *[F.sum(c).over(so_far).alias(c) for c in SUMS])
        states = sums.select("waves", *open_signals(self.expected, self.n_personas)).select(
            "waves", F.col("gen_have").alias("have"), "strict_fail", "accept_fail", "below_quorum",
            wave_decision(F.col("strict_fail"), F.col("accept_fail"), F.col("waves"), self.grace,
                          self.most).alias("decision"))
        return states


def run_open_waves(lines: DataFrame, run: OpenWaves, checkpoint: str) -> None:
    """Take each micro-batch that is there as a wave (runs the stream)."""
    (lines.writeStream.foreachBatch(run.take).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
