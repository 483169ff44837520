"""Mixing sources to target weights (operator 8), in DataFrame operations only.

Each document has a fixed place on the hash line of its source, and a source takes the documents
up to a threshold: once around for what it has, twice around for what goes beyond. The threshold
is found by histograms: words are summed by source and hash bucket, the bucket in which a
source's budget runs out is found, and only that bucket is summed again by finer buckets, until
every boundary lies between two hash values. A filter on the hash then takes the documents;
nothing is sorted. Thresholds are nested: a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.shared import written

HEX_DIGITS = 15         # of the hash: 60 bits
DIGITS_A_STEP = 3       # buckets of one histogram: 16 ** 3
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5             # of all words, what the mix holds
MOST = 2.0              # times its size, what a source or document gives at most
FILLS = 3               # times that documents beyond the threshold may fill what is left
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def place(doc_id: Column) -> Column:
    """A document's place on the hash line: 60 bits of its id's digest."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")),
                              1, HEX_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """(source, source_size, target) of sources with their sizes.

    Sources in code-point order (null last) take the weights in turn. A target stops at ``most``
    times the size, and the excess goes to the others by weight until none is above: with the
    sources ordered by size over weight, those before the first that fits are at their limit.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    ranked = sizes.select("source", "source_size", w.alias("w")).withColumn(
        "limit", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("limit") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = (ranked.withColumn("capped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
             .withColumn("level", (F.sum("source_size").over(whole) * F.lit(share)
                                   - F.col("capped")) / (F.sum("w").over(whole) - F.col("w_before"))))
    # levels fall from the first source that fits onwards, so the greatest that fits is the first
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return level.withColumn("final", final).select(
        "source", "source_size",
        F.when(F.col("final").isNull(), F.col("limit"))
        .otherwise(F.least("limit", F.col("w") * F.col("final"))).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, upto): the documents with a hash up to it are what fits the source's budget.

    ``rows`` are (source, h, size), ``budgets`` (source, budget).
    """
    same = F.expr("r.source <=> b.source")
    open_ = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"),
                           F.lit(0).cast("long").alias("held"))
    done, left = [], HEX_DIGITS
    while left:
        step = DIGITS_A_STEP if left % DIGITS_A_STEP == 0 else left % DIGITS_A_STEP
        span, width = 16 ** left, 16 ** (left - step)
        inside = rows.alias("r").join(open_.alias("b"), same).where(
            (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(span)))
        sums = (inside.select("b.source", "h", "size",
                              F.expr(f"(h - low) div {width}").alias("bucket"))
                .groupBy("source", "bucket")
                .agg(F.sum("size").alias("words"), F.min("h").alias("first"),
                     F.max("h").alias("last")))
        run = Window.partitionBy("source").orderBy("bucket")
        # the first bucket that the budget does not hold, per source
        over = (sums.withColumn("before", F.sum("words").over(run) - F.col("words")).alias("r")
                .join(open_.alias("b"), same)
                .where(F.col("held") + F.col("before") + F.col("words") > F.col("budget"))
                .groupBy("b.source").agg(
                    F.min_by(F.struct("low", "bucket", "before", "first", "last"),
                             "bucket").alias("at")))
        level = written(open_.alias("b").join(over.alias("r"), same, "left").select(
            "b.source", "budget", "held", "at"), "boundary")
        one = F.col("at.first") == F.col("at.last")
        done.append(level.where(F.col("at").isNull() | one).select(
            "source", F.when(F.col("at").isNull(), F.lit(16 ** HEX_DIGITS))
            .otherwise(F.col("at.first") - 1).alias("upto")))
        open_ = level.where(~one).select(
            "source", "budget", (F.col("at.low") + F.col("at.bucket") * F.lit(width)).alias("low"),
            (F.col("held") + F.col("at.before")).alias("held"))
        left -= step
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def take(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST,
         fills: int = FILLS) -> DataFrame:
    """``rows`` (source, h, size, ...) with source_size, target and copies (0, 1 or 2).

    A source whose target exceeds its words gives every document once, and the rest of the target
    is a budget for second copies. A budget takes documents up to its threshold; documents beyond
    it that fit what is left fill the gap, up to ``fills`` times, again by thresholds.
    """
    same = F.expr("r.source <=> b.source")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sizes, weights, share, most).withColumn(
        "every", F.col("target") >= F.col("source_size")).withColumn(
        "budget", F.col("target") - F.when(F.col("every"), F.col("source_size")).otherwise(0)),
        "targets")
    state = rows.alias("r").join(goals.alias("b"), same).select(
        "r.*", "source_size", "target", "every", "budget", F.lit(False).alias("more"))
    budgets = goals.select("source", "budget")
    for _ in range(fills + 1):
        open_ = state.where(~F.col("more")).alias("r").join(
            budgets.withColumnRenamed("budget", "gap").alias("b"), same).where("size <= gap")
        found = thresholds(open_.select("r.source", "h", "size"), budgets)
        found = written(found.alias("r").join(budgets.alias("b"), same).select(
            "b.source", "upto", F.col("budget").alias("gap")), "found")
        state = state.alias("r").join(found.alias("b"), same, "left").select(
            *[f"r.{c}" for c in state.columns if c != "more"],
            (F.col("more") | ((F.col("size") <= F.col("gap")) & (F.col("h") <= F.col("upto"))))
            .alias("more"))
        budgets = written(state.groupBy("source").agg(
            F.first("budget").alias("_b"),
            F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).alias("_t"))
            .select("source", (F.col("_b") - F.col("_t")).alias("budget")), "gaps")
    # what no further document fits may hold a second copy of a small one
    again = F.col("more") & ~F.col("every")
    gaps = budgets.withColumnRenamed("budget", "gap")
    small = state.where(again).alias("r").join(gaps.alias("b"), same).where("size <= gap")
    found = thresholds(small.select("r.source", "h", "size"), budgets)
    found = written(found.alias("r").join(gaps.alias("b"), same).select("b.source", "upto", "gap"),
                    "found")
    twice = again & (F.col("size") <= F.col("gap")) & (F.col("h") <= F.col("upto"))
    return state.alias("r").join(found.alias("b"), same, "left").select(
        *[f"r.{c}" for c in rows.columns], "source_size", "target",
        (F.col("every").cast("int") + F.col("more").cast("int")
         + F.coalesce(twice, F.lit(False)).cast("int")).alias("copies"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs``.

    The size is the number of words (null: 0). A document without words is taken as often as its
    hash says and gives no words. Null sources are one source, the last. Rows that repeat an id
    have one place on the hash line and are taken together. An empty table gives no rows; other
    columns are ignored.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                               F.col("source").cast("string").alias("source"),
                               place(F.col("doc_id")).alias("h"),
                               word_count(F.col("text")).alias("size")), "sizes")
    return take(rows, **how).select("doc_id", "size", "source_size", "target",
                                    (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    rows = docs.select(
        F.struct(*docs.columns).alias("_llm_row"), place(F.col("doc_id")).alias("h"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    slim = written(rows.select("source", "h", "size"), "sizes")
    taken = written(take(slim, **how).where("copies > 0").groupBy("source", "h", "size")
                    .agg(F.max("copies").alias("copies")), "taken")
    return (rows.alias("r").join(taken.alias("b"), F.expr(
        "r.source <=> b.source AND r.h = b.h AND r.size = b.size"))
        .select("r._llm_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
        .select("_llm_row.*"))
