"""Percentile bootstrap of a mean over items, and of a paired difference.

Resampling n items with replacement depends on the multiset of values alone, so the work
starts from a histogram ``(group, value in integer units, count)``:

* the histogram is one aggregation, however many items there are;
* a group with many distinct values is halved by value hash until a chunk holds about
  ``CHUNK_VALUES``, with no limit to the halvings.  Every chunk follows its own path from the
  whole group, draws at each halving the same binomial as the other chunks below it (from a
  seed that names the group, the shard and the place) and then, given its own total, a
  multinomial over its own values.  Together that is exactly the multinomial over all
  values, and no task ever holds a whole large group;
* resamples are cut into shards, and each (group, chunk, shard) is one row of work for an
  Arrow kernel that returns the resampled sums;
* sums are pairs of integers (units and the rest), so adding chunks is exact.  Values are
  rounded to 2^-16 of a unit; a sum within one such step an item is a tie at zero, for any
  number of runs.

The result does not depend on partitioning.  ``hash_bootstrap`` draws one index per
resampled item from a hash instead; it costs resamples x items and exists so that the
whole statistic can be replayed in plain SQL.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions.calls import child_seed
from assaykit.functions.exact import FINE, UNIT, in_fine_units, in_units
from assaykit.session import cut_lineage, parallelism, stored

CHUNK_VALUES = 1024    # distinct values per chunk before a group is cut
SHARD_RESAMPLES = 500  # resamples per work row
KERNEL_CELLS = 2_000_000  # drawn counts held at once by the kernel (int64)
BUCKET_ROWS = 1_000_000   # items of a bucket of the hash-drawn form
BUCKET_DRAWS = 4_000_000  # draws that meet a bucket at once
BUCKET_BITS = 12          # it has at most so many buckets, as a power of two
PART_BITS = 5             # draws are sent to buckets by so many bits more
BLOCK_DRAWS = 1 << 15     # draws looked up at once


def value_histogram(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Histogram of non-null values in fine integer units."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*groups, in_fine_units(F.col(value)).alias("v"))
            .agg(F.count("*").alias("c")))


def _chunks(histogram: DataFrame, groups: list[str]) -> DataFrame:
    """One row per (group, chunk) with its values and the weights on the way to it.

    A group with k distinct values is halved ``depth`` = log2(k / ``CHUNK_VALUES``) times by the
    leading bits of the value hash.  ``weights`` are those of the whole group, of the half the
    chunk is in, and so on to the chunk's own.
    """
    keyed = histogram.select(F.struct(*groups).alias("g"), "v", "c",
                             F.xxhash64("v").alias("hash"))
    halvings = F.ceil(F.log2(F.col("k") / CHUNK_VALUES))
    sizes = keyed.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("k")).select(
        "g", "n", F.greatest(F.lit(0), halvings).cast("int").alias("depth"))
    at = F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(
        F.expr("shiftrightunsigned(hash, 64 - depth)"))
    chunks = keyed.join(sizes, "g").groupBy("g", "n", "depth", at.alias("at")).agg(
        F.sum("c").alias("w"), F.collect_list(F.struct("v", "c")).alias("cells"))
    places = (keyed.join(sizes, "g").groupBy("g", "depth", at.alias("at"))
              .agg(F.sum("c").alias("w"))
              .withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
              .withColumn("node", F.expr("shiftrightunsigned(at, depth - level)")))
    nodes = places.groupBy("g", "level", "node").agg(F.sum("w").alias("node_w"))
    ways = (places.join(nodes, ["g", "level", "node"]).groupBy("g", "at")
            .agg(F.sort_array(F.collect_list(F.struct("level", "node_w"))).alias("way")))
    return chunks.join(ways, ["g", "at"]).select(
        "g", "n", "at", F.col("way.node_w").alias("weights"), F.col("cells.v").alias("values"),
        F.col("cells.c").alias("counts"))


def chunk_totals(n: int, draws: int, seed: int, at: int, weights: np.ndarray) -> np.ndarray:
    """Draws that fall to the chunk ``at``, by the binomials on the way to it."""
    totals, depth = np.full(draws, n, dtype=np.int64), len(weights) - 1
    for level in range(1, depth + 1):
        node, whole, own = at >> (depth - level), int(weights[level - 1]), int(weights[level])
        left = whole - own if node % 2 else own
        drawn = np.random.default_rng([seed, level, node >> 1]).binomial(totals, left / whole)
        totals = totals - drawn if node % 2 else drawn
    return totals


def resampled_sums(histogram: DataFrame, groups: list[str], resamples: int, seed: int,
                   label: str) -> DataFrame:
    """Resampled sums: ``g``, ``n``, ``sums`` and ``rest`` (one array each per shard of resamples):
    whole units and the fine units beyond them."""
    cells_limit = KERNEL_CELLS

    @F.pandas_udf("array<array<bigint>>")
    def draw(n: pd.Series, size: pd.Series, group_seed: pd.Series, chunk_seed: pd.Series,
             at: pd.Series, weights: pd.Series, values: pd.Series,
             counts: pd.Series) -> pd.Series:
        out = []
        for n_i, b, gs, cs, a, w, v, c in zip(n, size, group_seed, chunk_seed, at,
                                              weights, values, counts):
            totals = chunk_totals(int(n_i), int(b), int(gs), int(a), w)
            rng = np.random.default_rng(int(cs))
            # frequent values first: the rest is then drawn from small remainders; the
            # fixed order also makes the draw independent of how the cells arrived
            order = np.lexsort((v, -c))
            v, c = v[order], c[order]
            step = max(1, cells_limit // len(v))
            share = c / c.sum()
            units = (v + FINE // 2) // FINE
            parts = np.stack([units, v - units * FINE], axis=1)
            sums = np.concatenate([rng.multinomial(totals[lo:lo + step], share) @ parts
                                   for lo in range(0, b, step)])
            out.append([sums[:, 0].tolist(), sums[:, 1].tolist()])
        return pd.Series(out)

    shards = -(-resamples // SHARD_RESAMPLES)
    text = F.to_json(F.col("g"))
    work = (_chunks(histogram, groups)
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
            .withColumn("size", F.least(F.lit(SHARD_RESAMPLES),
                                        resamples - F.col("shard") * SHARD_RESAMPLES))
            .withColumn("group_seed", child_seed(seed, F.lit(label), text,
                                                 F.col("shard").cast("string")))
            .withColumn("chunk_seed", child_seed(seed, F.lit(label), text,
                                                 F.col("shard").cast("string"),
                                                 F.col("at").cast("string"))))
    spread = work.repartition(parallelism(histogram.sparkSession), "g", "shard", "at")
    drawn = spread.select("g", "n", "shard", draw(
        "n", "size", "group_seed", "chunk_seed", "at", "weights", "values", "counts")
        .alias("part"))
    def added(name: str) -> Column:
        return F.reduce(
            F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(0))),
            F.try_element_at(name, F.lit(1)),
            lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))

    return (drawn.groupBy("g", "n", "shard").agg(
                F.collect_list(F.col("part")[0]).alias("sums"),
                F.collect_list(F.col("part")[1]).alias("rest"))
                 .select("g", "n", added("sums").alias("sums"), added("rest").alias("rest")))


def _bounds(sums: Column, n: Column, ci: float) -> Column:
    tail = (1 - ci) / 2
    return F.percentile(sums / n / UNIT, F.array(F.lit(tail), F.lit(1 - tail)))


def _quantile(ordered: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    x0 = F.get(ordered, low)
    x1 = F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return x0 + (at - low) * (x1 - x0)


def _percentiles(sums: DataFrame, ci: float) -> DataFrame:
    """All resampled sums of a group in order (``s``, one per resample) and the bounds.

    A sum of n items within n fine units, what their rounding can make of zero, is zero.
    """
    tail = (1 - ci) / 2

    def whole(units, rest):
        x = units.cast("double") + rest / F.lit(float(FINE))
        return F.when(F.abs(x) <= F.col("n") / F.lit(float(FINE)), F.lit(0.0)).otherwise(x)

    scale = F.col("n").cast("double") * UNIT
    return (sums.withColumn("sums", F.zip_with("sums", "rest", whole)).groupBy("g", "n")
            .agg(F.sort_array(F.flatten(F.collect_list("sums"))).alias("s"))
            .withColumn("lo", _quantile(F.col("s"), tail) / scale)
            .withColumn("hi", _quantile(F.col("s"), 1 - tail) / scale))


def mean_ci(df: DataFrame, groups: list[str], value: str, resamples: int, seed: int,
            label: str = "mean", ci: float = 0.95) -> DataFrame:
    """Bootstrap interval of the mean of ``value`` over items, per group.

    The histogram is checkpointed (one job), so the kernel stages neither replan nor
    replay what led to it.
    """
    histogram = cut_lineage(value_histogram(df, groups, value))
    sums = resampled_sums(histogram, groups, resamples, seed, label)
    return _percentiles(sums, ci).select("g.*", "n", "lo", "hi")


def two_sided_p(below: Column, above: Column, resamples: int) -> Column:
    """Add-one smoothed two-sided p-value: never 0, at most 1."""
    return F.least(F.lit(1.0), 2 * (F.least(below, above) + 1) / F.lit(resamples + 1))


def paired_ci(histogram: DataFrame, groups: list[str], resamples: int, seed: int,
              label: str = "pair", ci: float = 0.95) -> DataFrame:
    """Bootstrap interval and p-value of the mean paired difference, per pair.

    ``histogram`` is the output of ``pairwise.difference_histogram``, best checkpointed:
    it is read more than once.
    """
    sums = resampled_sums(histogram, groups, resamples, seed, label)
    below = F.size(F.filter("s", lambda x: x <= 0))
    above = F.size(F.filter("s", lambda x: x >= 0))
    return _percentiles(sums, ci).select("g.*", "n", "lo", "hi",
                                         two_sided_p(below, above, resamples).alias("p"))


def _hash_sums(resamples: int, width: int):
    """Kernel of ``hash_bootstrap``: sums of one bucket's items over one shard of resamples, an
    array per group."""
    def sums(key: tuple, items: pa.Table, side: pa.Table) -> pa.Table:
        shard = key[1].as_py()
        count = min(width, resamples - shard * width)
        code, d1, d2, v = (items.column(c).to_numpy() for c in ("code", "d1", "d2", "v"))
        order = np.lexsort((v, d2, d1, code))
        code, v = code[order], v[order].astype(float)
        b, x, j = (side.column(c).combine_chunks().flatten().to_numpy() for c in ("b", "x", "j"))
        drawn = np.argsort(j, kind="stable")   # a group's draws come first
        u, b_d, j_d = x[drawn] / 4294967296.0, b[drawn].astype(np.int64), j[drawn]
        places = side.filter(pc.is_valid(side.column("code")))
        codes, out = [], []
        for g, before, n in zip(*(places.column(c).to_pylist() for c in ("code", "before", "n"))):
            lo, hi = np.searchsorted(code, [g, g + 1])
            own = np.concatenate([[0.0], v[lo:hi], [0.0]])   # other buckets' items count nothing here
            last, total = int(np.searchsorted(j_d, n)), np.zeros(count)
            for first in range(0, last, BLOCK_DRAWS):
                some = slice(first, min(last, first + BLOCK_DRAWS))
                i = (u[some] * n).astype(np.int64)
                i -= before - 1
                # sums of a bucket stay below 2**53, so doubles hold them exactly
                total += np.bincount(b_d[some], np.take(own, i, mode="clip"), count)
            codes.append(g)
            out.append(total.astype(np.int64))
        return pa.table([pa.array(codes, pa.int64()), pa.array([shard] * len(codes), pa.int32()),
                         pa.array([s.tolist() for s in out], pa.list_(pa.int64()))],
                        ["code", "shard", "sums"])

    return sums


def _hash_draws(seed: int, resamples: int, width: int, bits: int):
    """Draws of ranges of j for all resamples, in arrays by part of [0, 1) and shard."""
    def draws(batches):
        for batch in batches:
            for first, last in zip(*(c.to_pylist() for c in batch.columns)):
                js = [b"%d" % j for j in range(first, last)]
                for shard, low in enumerate(range(0, resamples, width)):
                    own = range(low, min(resamples, low + width))
                    digests = b"".join([hashlib.md5(head + j).digest()[:4]
                                        for head in [b"%d|%d|" % (seed, b) for b in own] for j in js])
                    x = np.frombuffer(digests, ">u4").astype(np.int64)
                    part = x >> (32 - bits)
                    order = np.argsort(part, kind="stable")
                    parts, starts = np.unique(part[order], return_index=True)
                    offsets = pa.array(np.append(starts, len(x)), pa.int32())
                    b, j = np.divmod(order, len(js))

                    def lists(a, kind):
                        return pa.ListArray.from_arrays(offsets, pa.array(a, kind))

                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts, pa.int32()), pa.array([shard] * len(parts), pa.int32()),
                         lists(b, pa.int32()), lists(x[order], pa.int64()), lists(j + first, pa.int64())],
                        ["part", "shard", "b", "x", "j"])

    return draws


def hash_bootstrap(df: DataFrame, groups: list[str], value: str, key: str, resamples: int,
                   seed: int) -> DataFrame:
    """Resampled sums with hash-drawn indexes: groups, ``n``, ``resample``, ``s``.

    Item ``i`` of a group is the i-th in the order of its key's digest.  Draw ``j`` of
    resample ``b`` picks index ``floor(u * n)`` with ``u`` from md5("seed|b|j"), so that
    groups share their draws.  Items of all groups meet in buckets of the digest, whose counts
    tell the first index of every group in a bucket; to each bucket come the draws that can hit
    its indexes, up to the largest group there.  Resamples are cut into shards, so that about
    ``BUCKET_DRAWS`` draws meet a bucket in a task; items are shuffled once a shard, one row each, and
    no task holds a group, but a bucket of about ``BUCKET_ROWS``.  ``df`` is read twice.
    """
    spark = df.sparkSession
    digest = F.md5(F.col(key).cast("string"))

    def bits(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")

    values = df.where(F.col(value).isNotNull()).select(
        *groups, in_units(F.col(value)).alias("v"), bits(1).alias("d1"), bits(16).alias("d2"))
    fine = F.shiftright("d1", 60 - BUCKET_BITS)
    counts = stored(values.groupBy(*groups, fine.alias("k")).agg(F.count("*").alias("c")), "counts")
    sizes = stored(counts.groupBy(*groups).agg(F.sum("c").alias("n"))
                   .withColumn("code", F.monotonically_increasing_id()), "sizes")
    rows, longest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)),
                              F.coalesce(F.max("n"), F.lit(0))).first()
    m = min(BUCKET_BITS, math.ceil(math.log2(max(parallelism(spark) / 4, rows / BUCKET_ROWS, 1))))
    shards = min(resamples, max(1, -(-(longest * resamples >> m) // BUCKET_DRAWS)))
    width = -(-resamples // shards)
    shards = -(-resamples // width)
    tasks = max(parallelism(spark), shards << m)

    def coded(rows: DataFrame, *columns: str | Column) -> DataFrame:
        g = sizes.select(*[F.col(c).alias(f"_{c}") for c in groups], "n", "code")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in groups]
        return rows.join(g, same).select(*columns)

    before = W.partitionBy("code").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    places = stored(
        coded(counts, "code", "n", F.shiftright("k", BUCKET_BITS - m).cast("int").alias("k"), "c")
        .groupBy("code", "n", "k").agg(F.sum("c").alias("c"))
        .withColumn("before", F.sum("c").over(before) - F.col("c")), "places")
    # a bucket needs the draws of those parts of [0, 1) in which its items lie
    bits_of_part = m + PART_BITS

    def part(index: Column) -> Column:
        return F.floor(index.cast("double") / F.col("n") * (1 << bits_of_part)).cast("int")

    needed = stored(places.select("k", "n", F.explode(F.sequence(
        F.greatest(F.lit(0), part(F.col("before")) - 1),
        F.least(F.lit((1 << bits_of_part) - 1), part(F.col("before") + F.col("c")) + 1))).alias("part"))
        .select("k", "part").distinct(), "needed")
    blocks = max(parallelism(spark), longest * resamples // BUCKET_DRAWS)
    size = max(1, -(-longest // blocks))
    ranges = spark.range(0, longest, size, blocks).select(
        F.col("id").alias("first"), F.least(F.col("id") + size, F.lit(longest)).alias("last"))
    draws = ranges.mapInArrow(_hash_draws(seed, resamples, width, bits_of_part),
                              "part int, shard int, b array<int>, x array<bigint>, j array<bigint>")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    sent = draws.join(F.broadcast(needed), "part").select("k", "shard", "b", "x", "j")
    side = sent.unionByName(places.select("k", every_shard, "code", "n", "before"), allowMissingColumns=True)
    items = coded(values, "code", F.shiftright("d1", 60 - m).cast("int").alias("k"), "d1", "d2", "v").select(
        "*", every_shard)

    def met(rows: DataFrame):
        return rows.repartition(tasks, "k", "shard").groupBy("k", "shard")

    sums = met(items).cogroup(met(side)).applyInArrow(
        _hash_sums(resamples, width), "code long, shard int, sums array<bigint>")
    added = (sums.select("code", "shard", F.posexplode("sums").alias("at", "s"))
             .withColumn("resample", F.col("shard") * width + F.col("at"))
             .groupBy("code", "resample").agg(F.sum("s").alias("s")))
    return added.join(sizes, "code").select(*groups, "n", "resample", "s")


def hash_mean_ci(df: DataFrame, groups: list[str], value: str, key: str, resamples: int,
                 seed: int, ci: float = 0.95) -> DataFrame:
    drawn = hash_bootstrap(df, groups, value, key, resamples, seed)
    return (drawn.groupBy(*groups, "n").agg(_bounds(F.col("s"), F.col("n"), ci).alias("_b"))
            .select(*groups, "n", F.col("_b")[0].alias("lo"), F.col("_b")[1].alias("hi")))


def hash_paired(df: DataFrame, groups: list[str], value: str, key: str, resamples: int,
                seed: int, ci: float = 0.95) -> DataFrame:
    drawn = hash_bootstrap(df, groups, value, key, resamples, seed)
    return (drawn.groupBy(*groups, "n")
            .agg(_bounds(F.col("s"), F.col("n"), ci).alias("_b"),
                 F.count_if(F.col("s") <= 0).alias("_le"),
                 F.count_if(F.col("s") >= 0).alias("_ge"))
            .select(*groups, "n", F.col("_b")[0].alias("lo"), F.col("_b")[1].alias("hi"),
                    two_sided_p(F.col("_le"), F.col("_ge"), resamples).alias("p")))


# ---- Poisson weights: continuous values, as many as items -------------------------------

POISSON_CELLS = 1 << 21      # weights held at once by the kernel
POISSON_BYTES = 1 << 26      # partial sums a task holds before it hands them on
MERGED = 64                  # partial sums of a shard are added in so many parts first
# Poisson(1) by inversion: the weight is the number of these that a 53-bit draw reaches
POISSON_STEPS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * (1 << 53))
                 for k in range(18)]
STEP64, MIX64 = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)   # splitmix64


def poisson_weights(keys: np.ndarray, first: int, count: int) -> np.ndarray:
    """Weights of resamples ``first`` on, one row per 60-bit key: functions of key and number."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + (
            np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(STEP64))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX64[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX64[1])
        x ^= x >> np.uint64(31)
    return np.searchsorted(np.array(POISSON_STEPS, np.uint64), (x >> np.uint64(11)).ravel(),
                           "right").reshape(x.shape)


def poisson_sums(df: DataFrame, groups: list[str], value: str, key: str, resamples: int,
                 seed: int) -> DataFrame:
    """``_g``, ``shard``, ``sums`` (units) and ``weights``: Poisson(1)-weighted sums per resample.

    One pass: a row's weight in a resample follows from its key and the resample's number, so the
    result depends neither on partitioning nor on a retry, and an item weighs the same in every
    group. Tasks add up whole arrays and hand on one per group and shard; these are added in
    two steps. No histogram is made, so values may all be different. Sums are exact integers (to
    4e10 items of size 1).  More than ``SHARD_RESAMPLES`` resamples are dealt out: a task holds the
    arrays of one shard, and the rows of a key meet the shard in the same task, which draws their
    weights once.
    """
    spark = df.sparkSession
    keyed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.where(F.col(value).isNotNull()).select(
        F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}).alias("_g"),
        in_units(F.col(value)).alias("v"),
        F.conv(F.substring(keyed, 1, 15), 16, 10).cast("bigint").alias("k"))
    width = min(SHARD_RESAMPLES, resamples)
    shards = -(-resamples // SHARD_RESAMPLES)
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    if shards > 1:
        parts_of_keys = -(-parallelism(spark) // shards)
        rows = rows.repartitionById(shards * parts_of_keys, (
            F.col("shard") * parts_of_keys + F.pmod("k", F.lit(parts_of_keys))).cast("int"))

    def add(batches):
        held: dict[tuple[str, int], np.ndarray] = {}

        def out():
            columns = list(zip(*[(g, s, p[0], p[1]) for (g, s), p in held.items()]))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()),
                 pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int64()))],
                ["_g", "shard", "sums", "weights"])

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            of, v = names.indices.to_numpy(), batch.column(1).to_numpy().astype(float)
            keys, names = batch.column(2).to_numpy(), names.dictionary.to_pylist()
            shard = batch.column(3).to_numpy()
            step = max(1, POISSON_CELLS // width)
            for s in np.unique(shard).tolist():
                first, mine = s * width, np.flatnonzero(shard == s)
                for lo in range(0, len(mine), step):
                    some = mine[lo:lo + step]
                    unique, at = np.unique(keys[some], return_inverse=True)
                    w = poisson_weights(unique, first, min(width, resamples - first)).astype(float)
                    for code in np.unique(of[some]).tolist():
                        own = of[some] == code
                        rows_w = w[at[own]]
                        # sums of a block stay below 2**53, so doubles hold them exactly
                        part = np.stack([v[some][own] @ rows_w, rows_w.sum(axis=0)]).astype(np.int64)
                        cell = names[code], s
                        held[cell] = held[cell] + part if cell in held else part
                    if len(held) * width * 16 > POISSON_BYTES:
                        yield out()
                        held.clear()
        if held:
            yield out()

    def added(name: str) -> Column:
        return F.reduce(F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(0))),
                        F.try_element_at(name, F.lit(1)),
                        lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))

    def merge(parts: DataFrame, *by: str) -> DataFrame:
        lists = parts.groupBy(*by).agg(F.collect_list("sums").alias("s"), F.collect_list("weights").alias("w"))
        return lists.select(*by, added("s").alias("sums"), added("w").alias("weights"))

    parts = rows.mapInArrow(add, "_g string, shard int, sums array<bigint>, weights array<bigint>")
    some = merge(parts.withColumn("part", F.spark_partition_id() % MERGED), "_g", "shard", "part")
    return merge(some, "_g", "shard")


def poisson_ci(df: DataFrame, groups: list[str], value: str, key: str, resamples: int, seed: int,
               ci: float = 0.95) -> DataFrame:
    """Poisson-bootstrap interval of the mean of ``value`` (between -1 and 1) over items, with the
    two-sided p-value of a mean of zero: groups, n, lo, hi, p, ``method``.

    The number of items in a resample is random, unlike in ``mean_ci``; the difference fades as
    1/n. Meant for values of which there are as many as items.
    """
    sums = poisson_sums(df, groups, value, key, resamples, seed)
    means = F.zip_with("sums", "weights", lambda s, w: F.try_divide(s.cast("double"), w.cast("double")) / UNIT)
    drawn = sums.groupBy("_g").agg(
        F.sort_array(F.flatten(F.collect_list(F.filter(means, lambda m: m.isNotNull())))).alias("s"),
        F.sum(F.size(F.filter("sums", lambda x: x <= 0))).alias("_le"),
        F.sum(F.size(F.filter("sums", lambda x: x >= 0))).alias("_ge"))
    names = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    sizes = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n")).withColumn("_g", names)
    tail = (1 - ci) / 2
    return sizes.join(drawn, "_g").select(
        *groups, "n", _quantile(F.col("s"), tail).alias("lo"), _quantile(F.col("s"), 1 - tail).alias("hi"),
        two_sided_p(F.col("_le"), F.col("_ge"), resamples).alias("p"), F.lit("poisson").alias("method"))
