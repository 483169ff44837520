"""From responses to the per-item table: keys, exclusions, item means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.answers import (answer_letter, exact_match, harness_letter,
                                       letter_matches_key)
from assaykit.functions.calls import any_served_ok, served_ok
from assaykit.functions.exact import exact_mean
from assaykit.functions.text import letter_at
from assaykit.operators.latest import last_rows
from assaykit.operators.ranking import kth_value
from assaykit.session import parallelism, stored

ARTIFACT_COST_RATIO = 0.5  # fixed value: share of the median cost that marks own pricing
BROADCAST_MODELS = 100_000  # medians that are sent to every task, about 40 bytes each


def call_ok() -> Column:
    """An absent flag predates the field and means success."""
    return F.coalesce(F.col("call_ok"), F.lit(True))


def completed(responses: DataFrame) -> DataFrame:
    """Responses whose call went through."""
    return responses.where(call_ok())


def score_responses(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Attach the key and choices of each item and score the response text.

    ``responses`` carries ``question_id, text, call_ok``; ``items`` is unique on
    ``question_id``.  A failed call is never scored as correct and counts as unparsed.
    """
    key = items.select("question_id", "choices", "answer_index")
    joined = responses.join(key, "question_id")
    letter = answer_letter(F.col("text"), F.size("choices"), F.col("choices"))
    return (joined.withColumn("parsed_letter", F.when(call_ok(), letter))
                  .withColumn("correct", letter_matches_key(F.col("parsed_letter"),
                                                            F.col("answer_index")))
                  .withColumn("parse_ok", F.col("parsed_letter").isNotNull())
                  .drop("choices"))


def clean_call_median(responses: DataFrame, cost: str = "cost_usd") -> DataFrame:
    """Upper median cost of the calls that the requested model served, per model."""
    clean = (completed(responses)
             .where(served_ok(F.col("model"), F.col("model_served")))
             .select("model", F.coalesce(F.col(cost), F.lit(0).cast("double")).alias(cost)))
    return (kth_value(clean, ["model"], cost, F.floor(F.col("n") / 2))
            .withColumnRenamed("kth", "median_cost"))


def classify_served(responses: DataFrame, cost: str = "cost_usd") -> DataFrame:
    """Adds ``call_class``: failed, clean, artifact (kept) or genuine (excluded).

    A call reported under another model is an artifact when the requested model is among
    all serving models or when it was billed like the requested model; otherwise it is a
    genuine silent fallback.  Without a positive clean median every mismatch is genuine.

    The medians are a written table with one row per model. Up to ``BROADCAST_MODELS`` of them go
    to every task and the log is not shuffled. Beyond that, only mismatched records meet
    their model's median, each model's records being dealt to many tasks.
    """
    medians = stored(clean_call_median(responses, cost)
                     .select(F.col("model").alias("_model"), "median_cost"), "medians")
    decided = (F.when(~call_ok(), "failed")
               .when(served_ok(F.col("model"), F.col("model_served")), "clean"))
    rows = responses.withColumn("_decided", decided)
    mismatch = F.col("_decided").isNull()
    if medians.count() <= BROADCAST_MODELS:
        priced = rows.join(F.broadcast(medians), mismatch & (F.col("model") == F.col("_model")), "left")
    else:
        salts = parallelism(responses.sparkSession)
        every = medians.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        plain = [f.name for f in responses.schema if isinstance(f.dataType, T.AtomicType)]
        dealt = rows.where(mismatch).withColumn(
            "_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
        met = dealt.join(every, (F.col("model") == F.col("_model")) & (F.col("_salt") == F.col("_to")),
                         "left").drop("_salt", "_to")
        priced = rows.where(~mismatch).unionByName(met, allowMissingColumns=True)
    served_all = F.col("served_all") if "served_all" in responses.columns else F.lit(None)
    price = F.coalesce(F.col(cost), F.lit(0).cast("double"))
    has_baseline = F.coalesce(F.col("median_cost") > 0, F.lit(False))
    own_price = F.coalesce(F.try_divide(price, F.col("median_cost")) > ARTIFACT_COST_RATIO,
                           F.lit(False))
    named = any_served_ok(F.col("model"), served_all.cast("string"))
    return (priced.withColumn("call_class", F.coalesce(
        "_decided", F.when(has_baseline & (named | own_price), "artifact").otherwise("genuine")))
            .drop("_decided", "_model", "median_cost"))


def scoreable(classified: DataFrame) -> DataFrame:
    """The calls every statistic is computed from."""
    return classified.where(F.col("call_class").isin("clean", "artifact"))


def per_item(scored: DataFrame, item: str = "question_id") -> DataFrame:
    """One row per (model, item): runs, correct runs, item mean.

    Repeated records of one cell all count.  Runs are kept as integers and divided once,
    so the result does not depend on partitioning; the partial aggregation also absorbs a
    model or item that dominates the log.  Item metadata is left out: text in the buffers
    would turn the hash aggregation into a sort, and only breakdowns need it (they join the
    item bank).
    """
    return (scored.groupBy("model", item)
            .agg(F.count("*").alias("runs"),
                 F.sum(F.col("correct").cast("bigint")).alias("hits"))
            .withColumn("p", F.col("hits") / F.col("runs")))


def _accounting() -> dict[str, Column]:
    """Counts of a log by call class; all add up."""
    kept = F.col("call_class").isin("clean", "artifact")

    def of(kind: str) -> Column:
        return F.count_if(F.col("call_class") == kind)

    return {"runs": F.count_if(kept), "hits": F.count_if(kept & F.col("correct")),
            "n_unparsed": F.count_if(kept & ~F.col("parse_ok")), "n_calls": F.count("*"),
            "n_call_failed": of("failed"), "served_mismatch_artifact": of("artifact"),
            "served_mismatch_genuine": of("genuine")}


def item_table(classified: DataFrame, item: str = "question_id") -> DataFrame:
    """``per_item`` plus call accounting, from one aggregation over the whole log.

    Keeps rows whose calls were all excluded (``runs`` 0, ``p`` null) so that per-model
    call counts are sums over this table and the log is not read a second time.
    """
    return (classified.groupBy("model", item)
            .agg(*[c.alias(n) for n, c in _accounting().items()])
            .withColumn("p", F.try_divide("hits", "runs")))


def cell_table(classified: DataFrame, seq: str, item: str = "question_id") -> DataFrame:
    """One row per (model, run, item): the accounting, and ``x``, the outcome (0/1) of the last
    scoreable record by ``seq`` (BIGINT). What every choice statistic needs of a log."""
    kept = F.col("call_class").isin("clean", "artifact")
    last = F.max_by(F.col("correct").cast("int"), F.when(kept, F.col(seq)))
    return classified.groupBy("model", "run_index", item).agg(
        *[c.alias(n) for n, c in _accounting().items()], last.alias("x"))


def cell_items(cells: DataFrame, item: str = "question_id") -> DataFrame:
    """The item table, from cells."""
    return (cells.groupBy("model", item).agg(*[F.sum(n).alias(n) for n in _accounting()])
            .withColumn("p", F.try_divide("hits", "runs")))


def item_meta(records: DataFrame, seq: str, item: str = "question_id") -> DataFrame:
    """Item metadata from a log that comes without its bank: the last record decides."""
    return last_rows(records, F.col(item), seq).select(item, "dimension", "difficulty", "axis")


def scored_items(table: DataFrame) -> DataFrame:
    """The items of ``item_table`` with at least one scoreable run."""
    return table.where(F.col("runs") > 0)


def quick_accuracy(scored: DataFrame) -> DataFrame:
    """Record-level accuracy over completed calls, as printed right after a run."""
    ok = call_ok()
    return scored.groupBy("model").agg(
        F.count_if(ok).alias("n"),
        F.count_if(~ok).alias("call_failures"),
        F.try_divide(F.count_if(ok & F.col("correct")), F.count_if(ok)).alias("accuracy"),
        F.try_divide(F.count_if(ok & ~F.col("parse_ok")), F.count_if(ok)).alias("parse_fail"))


def harness_mean(responses: DataFrame, by: list[str]) -> DataFrame:
    """Mean exact match of the harness letter with the key, over all responses of a group."""
    target = letter_at(F.col("answer_index"))
    return responses.groupBy(*by).agg(F.count("*").alias("n"), F.avg(exact_match(
        harness_letter(F.col("text")), target)).alias("exact_match"))


def quick_composite(open_scores: DataFrame) -> DataFrame:
    """Record-level mean composite of the scored panels."""
    return (open_scores.where(F.col("composite_100").isNotNull()).groupBy("model")
            .agg(F.count("*").alias("n"), exact_mean(F.col("composite_100"), 100.0).alias("composite")))
