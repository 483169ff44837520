"""Structured Streaming: scoring on arrival, idempotent intake, progress, waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.operators.audit import scan_log
from assaykit.operators.scoring import call_ok, score_responses
from assaykit.session import parallelism

# Waves before a tolerable rest is accepted, and the last wave.
GRACE_WAVES, MAX_WAVES = 3, 40


def response_stream(spark: SparkSession, path: str, schema, fmt: str = "json",
                    files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into Parquet and stop (runs the stream)."""
    (stream.writeStream.format("parquet").outputMode(mode)
     .option("path", out).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def score_stream(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Score responses as they land; stateless join with the static item bank.

    A batch of few files has few splits, and reading letters off texts costs CPU per row: rows are
    dealt to all cores first. Batches are planned by what is known beforehand, so ``items`` is best
    a table of known size: a small one goes to every task, and the texts stay where they are.
    """
    dealt = responses.repartition(parallelism(responses.sparkSession))
    return score_responses(dealt, items)


def once_per_key(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """One row per work key despite replays that arrive within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def progress(stream: DataFrame) -> DataFrame:
    """Running counters per model, for update mode."""
    ok = call_ok()
    return stream.groupBy("model").agg(
        F.count("*").alias("done"), F.count_if(ok & F.col("correct")).alias("hits"),
        F.count_if(ok & ~F.col("parse_ok")).alias("unparsed"),
        F.count_if(~ok).alias("failed"), F.sum("cost_micro").alias("cost_micro"))


def rate(stream: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """Completed calls per model and event-time window; late rows beyond ``delay`` drop."""
    return (stream.withWatermark(time, delay)
            .groupBy(F.window(time, width).alias("w"), "model")
            .agg(F.count("*").alias("done"))
            .select(F.col("w.start").alias("start"), "model", "done"))


def run_rate(stream: DataFrame, out: str, checkpoint: str, time: str, width: str,
             delay: str) -> None:
    """Completed calls per model and window, with the calls that came too late counted beside them.

    A row is late when its window ended ``delay`` or more before the largest event time of the
    earlier batches. Each batch writes what it adds and its own largest event time under its
    number, so a replayed batch replaces its rows; there is no state to evict, and no row
    leaves without being counted (runs the stream).
    """
    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = _batches(spark, f"{out}/latest", "latest timestamp").where(F.col("batch") < number)
        mark = seen.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("m")).first().m
        rows = batch.select("model", F.col(time).alias("at"), F.window(time, width).alias("w"))
        late = F.lit(False) if mark is None else F.col("w.end") <= F.lit(mark)
        added = rows.groupBy(F.col("w.start").alias("start"), "model").agg(
            F.count_if(~late).alias("done"), F.count_if(late).alias("late"))
        for df, name in ((added, "added"), (batch.agg(F.max(time).alias("latest")), "latest")):
            (df.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}"))

    (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What batches wrote so far; nothing before the first."""
    spark.createDataFrame([], f"{schema}, batch long").write.mode("ignore").partitionBy("batch").parquet(path)
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def rates(spark: SparkSession, out: str) -> DataFrame:
    """start, model, done and late over all batches of ``run_rate``."""
    return (_batches(spark, f"{out}/added", "start timestamp, model string, done long, late long")
            .groupBy("start", "model").agg(F.sum("done").alias("done"), F.sum("late").alias("late")))


def run_updates(table: DataFrame, out: str, checkpoint: str) -> None:
    """Update-mode rows to ``out``: each batch appends the rows that changed, tagged with the
    batch number; the last row of a key is its current state, open windows included."""
    def upsert(batch: DataFrame, number: int) -> None:
        (batch.withColumn("batch", F.lit(number).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(out))

    (table.writeStream.outputMode("update").foreachBatch(upsert)
     .option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def run_progress(stream: DataFrame, out: str, checkpoint: str) -> None:
    """The counters of ``progress`` after each batch."""
    run_updates(progress(stream), out, checkpoint)


def latest(written: DataFrame, *keys: str) -> DataFrame:
    """The last row that ``run_updates`` wrote for each key."""
    fields = [c for c in written.columns if c not in (*keys, "batch")]
    return (written.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r"))
            .select(*keys, "r.*"))


def current_progress(written: DataFrame) -> DataFrame:
    """Latest counters per model."""
    return latest(written, "model")


def wave_decision(strict, accept, wave, grace: int = GRACE_WAVES, most: int = MAX_WAVES):
    """clean, clean_quorum, give_up or continue; a column over audit numbers."""
    return (F.when(strict == 0, "clean")
             .when((wave >= grace) & (accept == 0), "clean_quorum")
             .when(wave >= most, "give_up").otherwise("continue"))


def run_waves(lines: DataFrame, counts: str, checkpoint: str) -> None:
    """Scan each micro-batch of choice-log lines (one wave, in any number of files) and record
    its counts.

    Only the new lines are read in a wave; earlier waves are already counted.  Writes are
    keyed by batch number, so a replayed batch replaces its own partition.
    """
    def wave(batch: DataFrame, number: int) -> None:
        (scan_log(batch.select("value")).withColumn("wave", F.lit(number).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("wave").parquet(counts))

    (lines.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def wave_states(counts: DataFrame, expected: int) -> DataFrame:
    """Audit signals and decision after each wave (one row per wave, at most a few dozen).

    Of a choice log nothing is tolerable, so both signals agree; ``waves.OpenWaves`` is the form
    for open logs.
    """
    so_far = W.partitionBy(F.lit(0)).orderBy("wave").rowsBetween(W.unboundedPreceding, 0)
    total, failed, corrupt = (F.sum(c).over(so_far) for c in ("total", "failed", "corrupt"))
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("wave"))
    strict = failed + corrupt + F.greatest(F.lit(0).cast("bigint"), F.lit(expected) - total)
    return (counts.select(n.alias("waves"), total.alias("have"), strict.alias("strict_fail"))
            .withColumn("accept_fail", F.col("strict_fail"))
            .withColumn("decision", wave_decision(F.col("strict_fail"), F.col("accept_fail"),
                                                  F.col("waves"))))


def finished(states: DataFrame) -> bool:
    """Whether the decision after the last wave ends the run."""
    last = states.agg(F.max_by("decision", "waves").alias("d")).first().d
    return last not in (None, "continue")
