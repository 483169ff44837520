"""The item bank: de-duplication, holdout, key balancing, coverage, quota plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.calls import draw_hash
from assaykit.functions.text import content_basis, content_id, stem
from assaykit.operators.latest import first_rows
from assaykit.operators.ranking import rank_by_hash, take_by_hash
from assaykit.session import cut_lineage

# Authoring surplus, difficulty shares, batch size, completeness share.
SURPLUS = 1.3
SHARES = (("basic", 0.30), ("intermediate", 0.40), ("advanced", 0.20))
MIN_EXPERT = 2
BATCH = 9
COVERAGE = 0.7


def with_ids(items: DataFrame) -> DataFrame:
    """Adds ``question_id`` and the normalised ``stem``."""
    basis = content_basis(F.col("format"), F.col("question"), F.col("choices"), F.col("prompt"))
    asked = F.coalesce(F.when(F.col("question") != "", F.col("question")), F.col("prompt"))
    return (items.withColumn("question_id", content_id(F.col("dimension"), F.col("difficulty"),
                                                       basis))
                 .withColumn("stem", stem(asked)))


def first_per_stem(items: DataFrame, seq: str) -> DataFrame:
    """Keep the first item of each stem by ``seq`` (BIGINT).  Enough when equal ids imply equal
    stems.

    Stems meet as digests with their smallest sequence number, combined before the shuffle, so
    one shared by much of the pool arrives as one row per map task; texts are not moved.
    """
    return first_rows(items, F.sha2("stem", 256), seq)


def deduplicate(items: DataFrame, *order: str) -> DataFrame:
    """Keep an item unless its id or its stem belongs to an item kept before it.

    This is the sequential rule with two keys.  Each round keeps the rows that come first
    under both of their keys and removes the rows that share a key with a kept one; the
    fixpoint equals the one-by-one result.  Rounds run on (order, id, stem digest) only,
    already reduced to one row per (id, stem), and end when nothing is undecided.  This
    operator runs one action per round and writes checkpoints.
    """
    light = (items.select(F.struct(*order).alias("at"), F.col("question_id").alias("id"),
                          F.sha2("stem", 256).alias("stem"))
             .groupBy("id", "stem").agg(F.min("at").alias("at")))
    left, kept = cut_lineage(light), None
    while True:
        by_id = left.groupBy("id").agg(F.min("at").alias("at"))
        by_stem = left.groupBy("stem").agg(F.min("at").alias("at"))
        # kept rows are the minimum of both groups: equal positions meet
        ids = by_id.join(by_stem, "at").select("at", "id", "stem")
        chosen = cut_lineage(ids)
        kept = chosen if kept is None else kept.unionByName(chosen)
        left = cut_lineage(left.join(chosen.select("id"), "id", "left_anti")
                               .join(chosen.select("stem"), "stem", "left_anti"))
        if left.isEmpty():
            break
    return (items.withColumn("_at", F.struct(*order))
            .join(kept.select(F.col("at").alias("_at")), "_at", "left_semi").drop("_at"))


def counts_by_cell(items: DataFrame) -> DataFrame:
    return (items.groupBy("format", "dimension", "difficulty")
            .agg(F.count("*").alias("n")))


def stratified_holdout(items: DataFrame, fraction: float, seed: int,
                       strata: tuple[str, ...] = ("dimension", "difficulty"),
                       key: str = "question_id") -> DataFrame:
    """Adds ``holdout``: exactly round-half-even(n * fraction) items of every stratum.

    Membership follows a seeded hash of the key, so it does not depend on file order or
    partitioning, and a stratum of any size is split over all tasks.
    """
    drawn = items.withColumn("_draw", draw_hash(seed, F.col(key)))
    quota = F.bround(F.col("group_size") * F.lit(fraction))
    return (take_by_hash(drawn, list(strata), "_draw", quota, key)
            .withColumnRenamed("taken", "holdout").drop("_draw"))


def sample_keys(keys: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Exact-size seeded sample of distinct keys: round-half-even(n * fraction) rows."""
    columns = keys.columns
    drawn = keys.distinct().withColumn("_draw", draw_hash(seed, *[F.col(c) for c in columns]))
    quota = F.bround(F.col("group_size") * F.lit(fraction))
    return (take_by_hash(drawn, [], "_draw", quota, *columns)
            .where("taken").drop("taken", "_draw"))


def balance_positions(items: DataFrame, seed: int) -> DataFrame:
    """Shuffle the wrong choices and redraw the key slot, uniformly and per item.

    Choices and their types move together and ``question_id`` stays.  Adds ``order``,
    ``answer_from`` and ``answer_to`` (the position map).  Types that do not match the
    choices in number stop the job; an absent list stays absent.
    """
    n, key = F.size("choices"), F.col("answer_index")
    kinds = F.col("distractor_types")
    checked = F.when(
        kinds.isNotNull() & (F.size(kinds) != n),
        F.raise_error(F.concat(F.lit("distractor_types length differs from choices: "),
                               F.col("question_id")))).otherwise(F.lit(None).cast("int"))
    tag = F.concat_ws("|", F.lit(str(seed)), F.col("question_id"))
    slots = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.md5(F.concat_ws("|", tag, i.cast("string"))).alias("draw"), i.alias("i")))
    others = F.transform(F.sort_array(F.filter(slots, lambda s: s["i"] != key)),
                         lambda s: s["i"])
    slot = F.pmod(F.conv(F.substring(F.md5(F.concat(tag, F.lit("|slot"))), 1, 8), 16, 10)
                  .cast("bigint"), n.cast("bigint")).cast("int")
    order = F.concat(F.slice("_others", 1, F.col("_slot")), F.array(key.cast("int")),
                     F.slice("_others", F.col("_slot") + 1, n))
    return (items.withColumn("_checked", checked)
            .withColumn("_others", others).withColumn("_slot", slot)
            .withColumn("order", F.when(F.col("_checked").isNull(), order))
            .withColumn("answer_from", key.cast("int"))
            .withColumn("answer_to", F.col("_slot"))
            .withColumn("choices", F.transform("order", lambda i: F.get("choices", i)))
            .withColumn("distractor_types", F.when(
                kinds.isNotNull(), F.transform("order", lambda i: F.get("distractor_types", i))))
            .withColumn("answer_index", F.col("_slot"))
            .drop("_checked", "_others", "_slot"))


def position_map(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rebuild the map of two versions of the same items from their choices."""
    old = before.select("question_id", F.col("choices").alias("_old"),
                        F.col("answer_index").alias("answer_from"))
    return after.join(old, "question_id").select(
        "question_id",
        F.transform("choices", lambda c: (F.array_position(F.col("_old"), c) - 1).cast("int"))
        .alias("order"),
        "answer_from", F.col("answer_index").alias("answer_to"))


def remap_letters(answers: DataFrame, positions: DataFrame, letter: str) -> DataFrame:
    """Adds ``letter_after``: an answer given before balancing, in the new positions."""
    from assaykit.functions.text import LETTERS, letter_at
    old_index = F.instr(F.lit(LETTERS), F.col(letter)) - 1
    return (answers.join(positions, "question_id")
            .withColumn("letter_after",
                        letter_at((F.array_position(F.col("order"), old_index) - 1).cast("int")))
            .drop("order", "answer_from", "answer_to"))


def key_positions(items: DataFrame) -> DataFrame:
    """Histogram of key positions; the largest share is what a position guesser scores."""
    from pyspark.sql import Window as W
    whole = W.partitionBy(F.lit(0))  # at most one row per answer letter
    return (items.groupBy("answer_index").agg(F.count("*").alias("n"))
            .withColumn("share", F.col("n") / F.sum("n").over(whole))
            .withColumn("guesser", F.max("share").over(whole)))


def quota_plan(targets: DataFrame) -> DataFrame:
    """Authoring batches per dimension and difficulty.

    ``targets``: dimension, target, subtopics.  Output one row per batch with its count
    and the subtopic list rotated by the batch number.
    """
    want = F.ceil(F.col("target") * F.lit(SURPLUS))
    parts = {name: F.bround(F.col("want") * F.lit(share)) for name, share in SHARES}
    rest = F.col("want") - sum(parts.values())
    quotas = F.array(*[
        F.struct(F.lit(name).alias("difficulty"), q.cast("int").alias("quota"))
        for name, q in [*parts.items(), ("expert", F.greatest(F.lit(MIN_EXPERT), rest))]])
    subs, k = F.col("subtopics"), F.col("batch") % F.size("subtopics")
    return (targets.withColumn("want", want)
            .select("dimension", "subtopics", F.inline(quotas))
            .where("quota > 0")
            .withColumn("batch", F.explode(F.sequence(
                F.lit(0), (F.ceil(F.col("quota") / BATCH) - 1).cast("int"))))
            .withColumn("count", F.least(F.lit(BATCH), F.col("quota") - F.col("batch") * BATCH))
            .withColumn("subtopics", F.concat(F.slice(subs, k + 1, F.size(subs)),
                                              F.slice(subs, F.lit(1), k))))


def cell_coverage(plan: DataFrame, items: DataFrame, cell: list[str]) -> DataFrame:
    """Whether each planned cell holds enough valid items to be skipped.

    ``plan``: cell columns and ``expected``; ``items``: validated rows with ``errors``.
    """
    good = (items.where(F.size("errors") == 0).groupBy(*cell).agg(F.count("*").alias("valid")))
    needed = F.greatest(F.lit(1), F.ceil(F.lit(COVERAGE) * F.col("expected")))
    return (plan.join(good, cell, "left")
            .withColumn("valid", F.coalesce("valid", F.lit(0).cast("bigint")))
            .withColumn("needed", needed)
            .withColumn("complete", F.col("valid") >= F.col("needed")))


def first_items(items: DataFrame, k: int, *order: str) -> DataFrame:
    """The first ``k`` items in source order (a run limit)."""
    return items.orderBy(*order).limit(k)
