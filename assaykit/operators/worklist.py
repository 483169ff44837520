"""Work lists: the grid, fan-outs, reuse of finished work, missing and repeated work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.calls import is_permanent, next_effort, served_ok
from assaykit.operators.bank import sample_keys
from assaykit.operators.panel import TRIPLE
from assaykit.session import fan_out


WORD = 64   # bits of a word of a run set


def work_grid(items: DataFrame, cohort: DataFrame, n_runs: int) -> DataFrame:
    """Every (model, item, run) of a run.

    The size of the result is the product by definition; the pairing itself is a salted
    equi-join.  An empty side stops the job instead of producing an empty run.
    """
    if n_runs < 1:
        raise ValueError("a run needs at least one repetition")
    grid = fan_out(require_rows(items, "items"),
                   require_rows(cohort.select("model"), "models"), "question_id")
    return grid.withColumn("run_index", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop before anything is written when ``df`` is empty (runs a one-row action)."""
    if df.isEmpty():
        raise ValueError(f"{what}: nothing to do, refusing to touch outputs")
    return df


def judge_jobs(responses: DataFrame, personas: DataFrame) -> DataFrame:
    """Responses that carry text, once per judge persona."""
    return fan_out(responses.where(F.col("text") != ""), personas, *TRIPLE)


def review_jobs(items: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Items, once per reviewer persona."""
    return fan_out(items, reviewers, "question_id")


def usable_cache(cache: DataFrame) -> DataFrame:
    """Cache entries that may be reused: successful and served by the requested model."""
    return cache.where(F.coalesce("ok", F.lit(False))
                       & served_ok(F.col("model_requested"), F.col("model_served")))


def reuse(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs with ``cache_hit`` and the cached text.

    A legacy entry without its requested model is checked against the job's model.
    """
    hit = cache.where(F.coalesce("ok", F.lit(False))).select(
        "key", F.col("text").alias("cached_text"), "model_requested", "model_served",
        F.lit(True).alias("_found"))
    requested = F.coalesce(F.when(F.col("model_requested") != "", F.col("model_requested")),
                           F.col("model"))
    good = F.coalesce(F.col("_found") & served_ok(requested, F.col("model_served")),
                      F.lit(False))
    return (jobs.join(hit, "key", "left").withColumn("cache_hit", good)
            .withColumn("cached_text", F.when(F.col("cache_hit"), F.col("cached_text")))
            .drop("_found", "model_requested", "model_served"))


def outstanding(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs that still have to be called."""
    return reuse(jobs, cache).where(~F.col("cache_hit")).drop("cache_hit", "cached_text")


def resolicit_list(reviews: DataFrame, effort: str) -> DataFrame:
    """Failed or unreadable first-pass reviews, to be asked again one effort step up."""
    first = reviews.where(~F.coalesce("resolicited", F.lit(False)))
    return (first.where(~F.coalesce("parse_ok", F.lit(False)))
            .select("question_id", "persona", next_effort(F.lit(effort)).alias("effort"),
                    F.lit(1).alias("run_index")))


def still_failing(reviews: DataFrame) -> DataFrame:
    """How many (item, persona) reviews no pass could read."""
    state = reviews.groupBy("question_id", "persona").agg(F.bool_or("parse_ok").alias("ok"))
    return state.agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("still_failing"))


def crosscheck_jobs(responses: DataFrame, personas: DataFrame, fraction: float,
                    seed: int) -> DataFrame:
    """An exact-size seeded sample of the judgeable triples, once per persona."""
    judgeable = responses.where(F.col("text") != "").select(*TRIPLE)
    return fan_out(sample_keys(judgeable, fraction, seed), personas, *TRIPLE)


def missing_work(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys without any record.  Unlike counting, repeats cannot hide gaps."""
    return expected.select(*keys).join(present.select(*keys).distinct(), keys, "left_anti")


def missing_runs(items: DataFrame, cohort: DataFrame, present: DataFrame, n_runs: int,
                 item: str = "question_id") -> DataFrame:
    """(item, model, run_index) of every expected call without any record.

    The calls of an item are bits, numbered model by model and run by run. Records set bits in one
    ``bit_or`` aggregation that combines before the shuffle, an item's set is complemented,
    and only the bits that are left become rows: neither the grid nor a model's runs are ever
    spelled out. Records outside the grid do not count; repeats cannot hide gaps. ``cohort`` is
    configuration; the set of an item holds models x runs bits.
    """
    if n_runs < 1:
        raise ValueError("a run needs at least one repetition")
    names = [r.model for r in cohort.select("model").distinct().orderBy("model").collect()]
    places = cohort.sparkSession.createDataFrame(list(enumerate(names)), "place long, model string")
    calls = len(names) * n_runs
    words = -(-calls // WORD)
    run = F.col("run_index")
    bit = F.col("place") * n_runs + run
    known = (present.where((run >= 0) & (run < n_runs)).join(places, "model")
             .select(item, bit.alias("_bit")))
    sets = (known.groupBy(item, F.floor(F.col("_bit") / WORD).cast("int").alias("_word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                          (F.col("_bit") % WORD).cast("int"))).alias("_bits"))
            .groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_set")))
    missing = F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)) if words else F.array().cast("array<int>"),
        lambda w: F.struct(w.alias("word"), F.bitwise_not(F.coalesce(
            F.try_element_at("_set", w), F.lit(0).cast("bigint"))).alias("bits")))
    left = (items.select(item).distinct().join(sets, item, "left")
            .select(item, F.explode(missing).alias("_m")).where("_m.bits <> 0")
            .select(item, F.explode(F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("_m.bits", i) == 1),
                lambda i: F.col("_m.word").cast("bigint") * WORD + i)).alias("_bit"))
            .where(F.col("_bit") < calls))
    return (left.select(item, F.floor(F.col("_bit") / n_runs).alias("place"),
                        (F.col("_bit") % n_runs).cast("int").alias("run_index"))
            .join(places, "place").select(item, "model", "run_index"))


def retry_list(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Failed calls with their error class; permanent ones are not worth a retry.

    ``markers`` (one column ``marker``) is a configuration table of permanent errors.
    """
    known = sorted(r.marker for r in markers.select("marker").distinct().collect() if r.marker)
    return (records.where(~F.coalesce("call_ok", F.lit(True)))
            .withColumn("permanent", is_permanent(F.col("error"), known)))
