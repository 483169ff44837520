"""Exact ranks and order statistics that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.session import stored

HASH_DIGITS = 4     # leading hex digits of the draw hash: 65,536 buckets per group
STEPS = 4096        # value buckets per power of two, and parts of a range
FEW = 50_000        # so many rows or values of one group are sorted together at most


def rank_by_hash(df: DataFrame, groups: list[str], digest: str, *ties: str) -> DataFrame:
    """Adds ``rank`` (1-based, by ``digest`` then ``ties``) and ``group_size`` per group.

    A plain ``row_number`` over the group would sort each group in one task.  Here rows
    are counted per leading hash digits first; the running total of those counts (at most
    65,536 rows per group) gives every bucket its offset, and only rows of one bucket are
    sorted together.  Hashes spread evenly, so a group holding most of the table still
    spreads over all tasks.
    """
    keyed = (df.withColumn("_group", F.struct(*groups) if groups else F.struct(F.lit(0)))
               .withColumn("_bucket", F.substring(digest, 1, HASH_DIGITS)))
    counts = keyed.groupBy("_group", "_bucket").agg(F.count("*").alias("_c"))
    ordered = W.partitionBy("_group").orderBy("_bucket")
    offsets = counts.select(
        "_group", "_bucket",
        (F.sum("_c").over(ordered.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c"))
        .alias("_before"),
        F.sum("_c").over(W.partitionBy("_group")).alias("group_size"))
    within = W.partitionBy("_group", "_bucket").orderBy(digest, *ties)
    return (keyed.join(offsets, ["_group", "_bucket"])
                 .withColumn("rank", F.col("_before") + F.row_number().over(within))
                 .drop("_group", "_bucket", "_before"))


def _boundary(counts: DataFrame, start: Column, k: Column) -> DataFrame:
    """The bucket of each group that holds the row of 0-based rank ``_k``.

    ``counts`` are (_group, _bucket, _bc) and what ``start`` (rows before all buckets) and ``k``
    refer to; ``n`` is the group's count.
    """
    ordered = W.partitionBy("_group").orderBy("_bucket")
    return (counts.withColumn("n", F.sum("_bc").over(W.partitionBy("_group")))
            .withColumn("_end", start + F.sum("_bc").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("_start", F.col("_end") - F.col("_bc"))
            .withColumn("_k", k.cast("bigint"))
            .where((F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_end"))))


def _largest(rows: DataFrame) -> int:
    """Rows of the largest group."""
    return rows.groupBy("_group").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _group(groups: list[str], digest: str) -> Column:
    """The group as one column. Without groups it is 0 for every row, computed from the digest: a
    constant would be folded out of the join's keys and leave a nested loop."""
    return F.struct(*(groups or [F.pmod(F.xxhash64(digest), F.lit(1)).alias("all")])).alias("_group")


def hash_thresholds(df: DataFrame, groups: list[str], digest: str, quota: Column,
                    *ties: str) -> DataFrame:
    """The last row that each group's ``quota`` takes by ``digest``, then ``ties``.

    Columns: ``_group``; ``_last``, its struct of digest and ties; ``_need``, how many of the rows
    equal to it are taken, and ``_equal``, how many there are. Groups that take nothing have no
    row. Rows are counted per leading digits; only the digests of the one bucket per group in
    which the quota ends are looked at further, by more digits until they are few. Complete
    rows are neither shuffled nor sorted.
    """
    at = F.struct(F.col(digest).alias("_d"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    rows = df.select(_group(groups, digest), at.alias("_at"))
    digits = HASH_DIGITS
    bucket = F.substring("_at._d", 1, digits)
    counts = rows.groupBy("_group", bucket.alias("_bucket")).agg(F.count("*").alias("_bc"))
    sized = counts.withColumn("group_size", F.sum("_bc").over(W.partitionBy("_group")))
    last = F.least(quota.cast("bigint"), F.col("group_size")) - 1
    edge = stored(_boundary(sized, F.lit(0), last).select("_group", "_bucket", "_start", "_k"), "edge")
    # a written edge has a known size: small ones are broadcast around, large ones are not
    inside = stored(rows.withColumn("_bucket", bucket).join(edge, ["_group", "_bucket"]), "inside")
    longest = 64
    while digits < longest and _largest(inside) > FEW:
        digits += HASH_DIGITS
        inside = inside.withColumn("_bucket", F.substring("_at._d", 1, digits))
        counts = inside.groupBy("_group", "_bucket").agg(
            F.count("*").alias("_bc"), F.first("_start").alias("_s"), F.first("_k").alias("_rank"))
        edge = _boundary(counts, F.col("_s"), F.col("_rank")).select("_group", "_bucket", "_start", "_k")
        inside = stored(inside.drop("_start", "_k").join(edge, ["_group", "_bucket"]), "inside")
    equal = inside.groupBy("_group", "_at", "_start", "_k").agg(F.count("*").alias("_equal"))
    before = F.sum("_equal").over(W.partitionBy("_group").orderBy("_at")
                                  .rowsBetween(W.unboundedPreceding, 0)) - F.col("_equal")
    need = F.col("_k") + 1 - F.col("_start") - before
    return stored(equal.select("_group", F.col("_at").alias("_last"), "_equal", need.alias("_need"))
                  .where((F.col("_need") >= 1) & (F.col("_need") <= F.col("_equal"))), "thresholds")


def take_by_hash(df: DataFrame, groups: list[str], digest: str, quota: Column,
                 *ties: str) -> DataFrame:
    """Adds ``taken``: whether a row is among its group's first ``quota`` by hash.

    ``quota`` may refer to ``group_size``. Rows are compared with their group's threshold where
    they are read. Only where rows repeat a threshold in digest and ties, beyond the quota, are
    those repeats numbered.
    """
    limits = hash_thresholds(df, groups, digest, quota, *ties)
    at = F.struct(F.col(digest).alias("_d"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    rows = (df.withColumn("_group", _group(groups, digest)).withColumn("_at", at)
            .join(limits, "_group", "left"))
    helpers = ("_group", "_at", "_last", "_equal", "_need")
    if limits.where("_need < _equal").isEmpty():
        return rows.withColumn("taken", F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False))
                               ).drop(*helpers)
    repeats = F.coalesce((F.col("_at") == F.col("_last")) & (F.col("_need") < F.col("_equal")),
                         F.lit(False))
    number = F.row_number().over(W.partitionBy("_group").orderBy("_at"))
    clear = rows.where(~repeats).withColumn("taken", F.coalesce(F.col("_at") <= F.col("_last"),
                                                                F.lit(False)))
    return clear.unionByName(rows.where(repeats).withColumn("taken", number <= F.col("_need"))
                             ).drop(*helpers)


def _value_bucket(v: Column) -> Column:
    """Order-preserving bucket: sign and ``STEPS`` steps per power of two of the size."""
    size = F.floor(F.log2(F.abs(v)) * STEPS) + 2048 * STEPS
    return F.when(v == 0, F.lit(0).cast("bigint")).otherwise(
        F.signum(v).cast("bigint") * size)


def kth_value(df: DataFrame, groups: list[str], value: str, k: Column) -> DataFrame:
    """The ``k``-th smallest (0-based) non-null ``value`` per group, exactly.

    ``k`` may refer to ``n``, the group's count.  Equal values collapse to counts, the counts are
    summed over value ranges, and the one range per group that holds the wanted rank is cut
    into ``STEPS`` equal parts again until its distinct values are few; only those are sorted.
    Values that crowd together therefore do not meet in one task. Output: groups, ``kth``, ``n``.
    """
    tally = stored(df.where(F.col(value).isNotNull())
                   .select(F.struct(*groups).alias("_group"), F.col(value).alias("_v"))
                   .groupBy("_group", "_v").agg(F.count("*").alias("_c")), "tally")
    v = F.col("_v").cast("double")
    rest = tally.withColumn("_bucket", _value_bucket(v))
    counts = rest.groupBy("_group", "_bucket").agg(F.sum("_c").alias("_bc"))
    edge = _boundary(counts, F.lit(0), k).select("_group", "_bucket", "_start", "_k", "n")
    rest = rest.join(edge, ["_group", "_bucket"])
    last = None
    if _largest(tally) > FEW:
        rest = stored(rest, "range")
        last = 0
    while last is not None:
        values = _largest(rest)
        if values <= FEW or values == last:      # few, or equal as doubles
            break
        last = values
        ends = rest.groupBy("_group").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        part = F.least(F.lit(STEPS - 1), F.floor(
            F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")) * STEPS))
        cut = rest.join(ends, "_group").withColumn("_bucket", F.coalesce(part, F.lit(0)))
        counts = cut.groupBy("_group", "_bucket").agg(
            F.sum("_c").alias("_bc"), F.first("_start").alias("_s"), F.first("_k").alias("_rank"),
            F.first("n").alias("_n"))
        edge = _boundary(counts, F.col("_s"), F.col("_rank")).select(
            "_group", "_bucket", "_start", "_k", F.col("_n").alias("n"))
        rest = stored(cut.drop("_start", "_k", "n", "_lo", "_hi")
                      .join(edge, ["_group", "_bucket"]), "range")
    inner = W.partitionBy("_group").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return (rest.withColumn("_end", F.col("_start") + F.sum("_c").over(inner))
            .where(F.col("_k") < F.col("_end"))
            .groupBy("_group").agg(F.min("_v").alias("kth"), F.first("n").alias("n"))
            .select("_group.*", "kth", "n"))
