"""N-gram Jaccard join (operator 7): documents whose shingle sets overlap enough, as components.

Hash values of shingles fall into groups (ranges of the hash), and a document is the point of
its group counts. ``sum(min(x, y))`` over the coordinates of two points bounds their overlap from
above, and for a box of points ``sum(min(q, high))`` does; a bulk-loaded R-tree over the points
prunes with both, and surviving pairs are verified on the whole sets.

Count vectors of texts of one language and length lie close together in every coordinate, so a
single tree over the corpus would visit most of its leaves. The trees are therefore built within
blocks that no qualifying pair escapes: two sets that differ by at most k shingles, dealt into
m > k groups, agree entirely in m - k groups at least. Each set gives the contents of all but its
m - k - 1 emptiest groups as block keys; the fullest of the groups in which two sets agree is
among the keys of both, and chance agreement in nearly empty groups is avoided. k follows from
the sizes (bands of sizes in the ratio of the threshold). Within a block:

1. every member is compared with the block's first member, streaming over sorted keys, and
   verified links are merged into components;
2. only blocks whose members are still in different components are searched further: by R-tree,
   in tasks of bounded size (large blocks are split, and pairs of parts are searched), each pair
   in its first common block alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.shared import components, with_rows, written
from assaykit.llm.words import U64, column, kept, mix, shingles, word_slices, tidy
from assaykit.session import parallelism

GROUPS = 128            # coordinates of a point
LEAF = 16               # points of an R-tree leaf
PART = 256              # members of a large block in one part
BITMAP = 1 << 18        # 64-bit words of the filter that spares texts no pair asks for
HOT_SHARE = 1 / 1024    # a block key with this share of a sample is dealt over SALTS tasks
SALTS = 16


# sizes and blocks

def required(x: int, y: int, num: int, den: int) -> int:
    """Least overlap of sets of x and y shingles with den * overlap >= num * union."""
    return -(-num * (x + y) // (num + den))


@lru_cache(maxsize=65536)
def band(n: int, num: int, den: int) -> tuple[int, int, int]:
    """(number, least size, largest size) of the band of sizes that holds n."""
    k, lo = 0, 1
    while True:
        hi = lo * den // num
        if n <= hi:
            return k, lo, hi
        k, lo = k + 1, hi + 1


@lru_cache(maxsize=4096)
def band_keys(hi: int, num: int, den: int) -> int:
    """Keys of a set: one more than the most by which a pair whose smaller is in the band differs."""
    return (hi + hi * den // num) * (den - num) // (den + num) + 1


@lru_cache(maxsize=4096)
def bounds(groups: int) -> np.ndarray:
    """First hash value of each group, as equal ranges of the 64 bits."""
    return np.array([(g << 64) // groups for g in range(groups)], np.uint64)


def group_keys(u: np.ndarray, mixed: np.ndarray, k: int, wanted: int) -> np.ndarray:
    """Keys for the contents of the ``wanted`` fullest groups of a sorted set; 0 for the others."""
    groups = wanted + max(2, wanted // 5)
    at = np.append(np.searchsorted(u, bounds(groups)), u.size)
    with np.errstate(over="ignore"):
        sums = np.append(U64(0), np.cumsum(mixed, dtype=np.uint64))
        place = mix(np.arange(groups, dtype=np.uint64) + U64(k << 32))
        keys = mix(sums[at[1:]] - sums[at[:-1]] + place) | U64(1)
    keys[np.argsort(-np.diff(at), kind="stable")[wanted:]] = 0
    return keys.view(np.int64)


def point(u: np.ndarray) -> np.ndarray:
    """Group counts of a sorted set."""
    return np.diff(np.append(np.searchsorted(u, bounds(GROUPS)), u.size))


def block_keys(u: np.ndarray, mixed: np.ndarray, num: int, den: int):
    """Keys of a set in its own band of sizes and, where a pair may reach there, in the one below."""
    n = int(u.size)
    k, least, most = band(n, num, den)
    wanted = band_keys(most, num, den)
    home = group_keys(u, mixed, k, wanted) if wanted > 1 else None
    low = None
    if k and n * num <= (least - 1) * den:
        below = band_keys(least - 1, num, den)
        low = group_keys(u, mixed, k - 1, below) if below > 1 else None
    return home, low


def _mixed(u: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(u + U64(0x632BE59BD9B4E019))


SHAPE = ("doc_id long, n_shingles long, set_a long, set_b long, "
         "home array<long>, low array<long>")


@tidy
def _shapes(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int):
    kept("jaccard")
    for batch in batches:
        sizes, first, second, home, low = [], [], [], [], []
        for lo, hi, hashes, at in word_slices(column(batch, "text")):
            for i in range(hi - lo):
                u = np.unique(shingles(hashes[at[i]:at[i + 1]], width))
                n = int(u.size)
                sizes.append(n)
                if not n:
                    first.append(0), second.append(0), home.append(None), low.append(None)
                    continue
                mixed = _mixed(u)
                first.append(int(mixed.sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(u ^ U64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
                                  .view(np.int64)))
                own, below = block_keys(u, mixed, num, den)
                home.append(own), low.append(below)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
             pa.array(second, pa.int64()), pa.array(home, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_a", "set_b", "home", "low"])


# ids as a bitmap of fixed size (2 MiB)

@tidy
def _spots(batches: Iterator[pa.RecordBatch]):
    """Bits of the ids of a partition, as (word, bits)."""
    bits = np.zeros(BITMAP, np.uint64)
    for batch in batches:
        spot = mix(column(batch, "doc_id").to_numpy().view(np.uint64)) >> U64(64 - 24)
        np.bitwise_or.at(bits, (spot >> U64(6)).astype(np.int64), U64(1) << (spot & U64(63)))
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))],
                                     ["word", "bits"])


def bitmap_of(ids: DataFrame) -> np.ndarray:
    rows = (ids.select("doc_id").mapInArrow(_spots, "word long, bits long").groupBy("word")
            .agg(F.bit_or("bits").alias("bits")).toPandas())
    bitmap = np.zeros(BITMAP, np.uint64)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def _hits(batch: pa.RecordBatch, bitmap: np.ndarray) -> np.ndarray:
    """Which rows may be among the ids of the bitmap; the others certainly are not."""
    spot = mix(column(batch, "doc_id").to_numpy().view(np.uint64)) >> U64(64 - 24)
    return (bitmap[(spot >> U64(6)).astype(np.int64)] >> (spot & U64(63)) & U64(1)).astype(bool)


# blocks

BLOCK = "key long, doc_id long, home boolean, nth int, pivot long"
PARTS = ("doc_id", "home", "nth")


def _rows_of(batch: pa.RecordBatch, pivots) -> pa.RecordBatch:
    key = pc.coalesce(column(batch, "hot"), column(batch, "run"))
    return pa.RecordBatch.from_arrays(
        [key, *[column(batch, c) for c in PARTS], pa.array(pivots, pa.int64())],
        ["key", *PARTS, "pivot"])


@tidy
def _members(batches: Iterator[pa.RecordBatch]):
    """Rows of blocks with two members at least, with the block's first member.

    The rows come sorted by run (the block's key, or a share of a hot block), members of the
    block's own band first; only the current run's first row is kept between batches.
    """
    key, first, pending = None, None, None
    for batch in batches:
        keys = column(batch, "run").to_numpy()
        docs = column(batch, "doc_id").to_numpy()
        own = column(batch, "home").to_numpy(zero_copy_only=False)
        n = keys.size
        if not n:
            continue
        new = np.append(True, keys[1:] != keys[:-1])
        if key is not None and keys[0] == key:
            new[0] = False
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1                        # -1: goes on from the last batch
        pivots = np.where(run >= 0, docs[starts[run]] if starts.size else 0, first or 0)
        usable = np.where(run >= 0, own[starts[run]] if starts.size else False, first is not None)
        rest = ~new & usable & (docs != pivots)
        lead = np.zeros(n, bool)
        if starts.size:
            got = np.bincount(run[rest & (run >= 0)], minlength=starts.size) > 0
            lead[starts[got]] = True
        take = rest | lead
        parts = []
        if pending is not None and (rest & (run < 0)).any():
            parts.append(pending)
            pending = None
        if take.any():
            parts.append(_rows_of(batch.filter(pa.array(take)), pivots[take]))
        if starts.size:
            s = int(starts[-1])
            key = keys[s]
            first = int(docs[s]) if own[s] else None
            pending = None
            if own[s] and not lead[s]:
                pending = _rows_of(batch.slice(s, 1), [first])
        yield from parts


KEY_ROW = "doc_id long, home boolean, nth int, run long"


@tidy
def _key_rows(batches: Iterator[pa.RecordBatch]):
    """One row per block key; ``nth`` is the key's place among the keys of its document."""
    for batch in batches:
        ids = column(batch, "doc_id").to_numpy()
        for name in ("home", "low"):
            lists = column(batch, name)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            keys = pc.list_flatten(lists).to_numpy()
            nth = np.arange(keys.size) - np.repeat(np.cumsum(counts) - counts, counts)
            some = keys != 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, counts)[some]),
                 pa.array(np.full(int(some.sum()), name == "home")),
                 pa.array(nth[some].astype(np.int32)), pa.array(keys[some])],
                ["doc_id", "home", "nth", "run"])


def block_rows(shapes: DataFrame, others: DataFrame) -> DataFrame:
    """(key, doc_id, home, nth, pivot): members of all blocks with two members or more.

    ``others`` are the rows of ``shapes`` for which another document stands. Rows that a bitmap
    of their ids clears give their keys where they are read; only possible ones are joined.
    """
    same = ["doc_id", "n_shingles", "set_a", "set_b"]
    bitmap = bitmap_of(others)

    def part(marked: bool):
        def kept(batches):
            for batch in batches:
                rows = batch.filter(pa.array(_hits(batch, bitmap) == marked))
                if rows.num_rows:
                    yield rows
        return kept

    sure, maybe = part(False), part(True)
    rows = (shapes.select("doc_id", "home", "low")
            .mapInArrow(lambda b: _key_rows(sure(b)), KEY_ROW)
            .unionByName(shapes.mapInArrow(maybe, SHAPE).join(others, same, "left_anti")
                         .select("doc_id", "home", "low").mapInArrow(_key_rows, KEY_ROW)))
    # a bounded sample only decides which keys are dealt over several tasks; at most 1/HOT_SHARE
    some = shapes.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(64)) == 0).select(
        *same, "home").join(others, same, "left_anti")
    keys = some.select(F.explode("home").alias("key")).where("key <> 0")
    total = keys.count()
    hot = [r.key for r in keys.groupBy("key").count()
           .where(F.col("count") > max(50, total * HOT_SHARE)).select("key").collect()]
    is_hot = F.col("run").isin(hot) if hot else F.lit(False)
    rows = rows.select(
        F.when(is_hot, F.xxhash64("run", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))))
        .otherwise(F.col("run")).alias("run"), F.when(is_hot, F.col("run")).alias("hot"),
        *PARTS)
    found = written(
        rows.repartition(parallelism(shapes.sparkSession), "run")
        .sortWithinPartitions("run", F.desc("home"), "doc_id").mapInArrow(_members, BLOCK), "blocks")
    if hot:
        # the runs of a hot key meet through their first members
        heads = found.where(F.col("key").isin(hot)).groupBy("key", "pivot").agg(
            F.first("nth").alias("nth"))
        least = heads.groupBy("key").agg(F.min("pivot").alias("least"))
        more = (heads.join(least, "key").where("pivot <> least")
                .select("key", F.col("pivot").alias("doc_id"), F.lit(True).alias("home"), "nth",
                        F.col("least").alias("pivot")))
        found = found.unionByName(more)
    return found


# verification

@tidy
def _sets(batches: Iterator[pa.RecordBatch], width: int, bitmap: np.ndarray):
    kept("jaccard")
    for batch in batches:
        rows = batch.filter(pa.array(_hits(batch, bitmap)))
        if not rows.num_rows:
            continue
        sets = []
        for lo, hi, hashes, at in word_slices(column(rows, "text")):
            for i in range(hi - lo):
                sets.append(np.unique(shingles(hashes[at[i]:at[i + 1]], width)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [column(rows, "doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "items"])


def whole_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, items): the sorted shingle sets of the documents in ``ids``, read from the texts.

    A bitmap spares most other documents; the caller's join on doc_id removes the rest.
    """
    bitmap = bitmap_of(ids)
    return docs.mapInArrow(lambda b: _sets(b, width, bitmap), "doc_id long, items array<long>")


def verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough."""
    pairs = written(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = written(whole_sets(docs, ids, width), "sets")
    both = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a"))
    common = F.size(F.array_intersect("x", "y"))
    return written(both.where(den * common >= num * (F.size("x") + F.size("y") - common))
                   .select("a", "b"), "links")


# the tree

def tree_pairs(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray,
               num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right) whose counts allow the required overlap.

    ``right`` is bulk-loaded into leaves by recursive halving on the widest coordinate; a leaf is
    left out for a query when its box's summed minima stay below what its sizes require.
    """
    order, stack, leaves = right, [right], []
    while stack:
        part = stack.pop()
        if part.size <= LEAF:
            leaves.append(part)
            continue
        spread = np.ptp(points[part], axis=0)
        values = points[part, int(spread.argmax())]
        half = np.argpartition(values, part.size // 2)
        stack += [part[half[:part.size // 2]], part[half[part.size // 2:]]]
    high = np.array([points[p].max(axis=0) for p in leaves])
    least = np.array([sizes[p].min() for p in leaves])
    out_i, out_j = [], []
    for i in left:
        q, n = points[i], int(sizes[i])
        bound = np.minimum(high, q).sum(axis=1)
        need = -(-num * (least + n) // (num + den))
        hits = np.flatnonzero(bound >= need)
        if not hits.size:
            continue
        cand = np.concatenate([leaves[h] for h in hits])
        exact = np.minimum(points[cand], q).sum(axis=1)
        ok = cand[exact >= -(-num * (sizes[cand] + n) // (num + den))]
        out_i.append(np.full(ok.size, i))
        out_j.append(ok)
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Rows at which another block, or another two parts of one, begin."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in ("key", "i", "j"):
        values = column(batch, name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, cut where a group ends; a group is two parts at most."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        last = int(_starts(batch)[-1])
        if last:
            yield batch.slice(0, last)
        left = batch.slice(last)
    if left is not None:
        yield left


def _fresh(keys: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs share no key of an earlier block: rows carry as many keys as blocks before."""
    flat, at = keys.flatten().to_numpy(), keys.offsets.to_numpy()
    at, lengths = (at[:-1] - at[0]).astype(np.int64), np.diff(at)
    fresh = np.ones(i.size, bool)
    for m in np.unique(lengths[i]):
        rows = np.flatnonzero(lengths[i] == m)
        for some in np.array_split(rows, 1 + rows.size * int(m) // (1 << 20)):
            x = flat[at[i[some]][:, None] + np.arange(m)]
            y = flat[at[j[some]][:, None] + np.arange(m)]
            fresh[some] = ~((x == y) & (x != 0)).any(axis=1)
    return fresh


@tidy
def _search(batches: Iterator[pa.RecordBatch], num: int, den: int):
    """Pairs of blocks, or of two parts of a large one, that survive the bounds.

    The rows come sorted by group. Groups that fit in one leaf are compared for a whole batch at
    a time; larger ones get a tree.
    """
    for batch in _whole_groups(batches):
        n = batch.num_rows
        starts = _starts(batch)
        counts = np.diff(starts, append=n)
        group = np.repeat(np.arange(starts.size), counts)
        ids, comp = column(batch, "doc_id").to_numpy(), column(batch, "component").to_numpy()
        sizes, part = column(batch, "n_shingles").to_numpy(), column(batch, "part").to_numpy()
        home = column(batch, "home").to_numpy(zero_copy_only=False)
        one = column(batch, "i").to_numpy() == column(batch, "j").to_numpy()
        points = np.stack([np.frombuffer(p, "<i4") for p in column(batch, "point").to_pylist()])

        def usable(i, j):
            return ((ids[i] != ids[j]) & (comp[i] != comp[j]) & (home[i] | home[j])
                    & (one[i] | (part[i] != part[j])))

        found = []
        small = (counts <= LEAF)[group]
        for d in range(1, min(LEAF, n)):
            i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
            i = i[usable(i, i + d)]
            need = -(-num * (sizes[i] + sizes[i + d]) // (num + den))
            i = i[np.minimum(points[i], points[i + d]).sum(axis=1) >= need]
            found.append((i, i + d))
        for g in np.flatnonzero(counts > LEAF):
            rows = np.arange(starts[g], starts[g] + counts[g])
            left = right = rows
            if not one[rows[0]]:
                least = part[rows].min()
                left, right = rows[part[rows] == least], rows[part[rows] != least]
                if not right.size:
                    continue
            i, j = tree_pairs(points, sizes, left, right, num, den)
            ok = usable(i, j) & ((i < j) | ~one[i])
            found.append((i[ok], j[ok]))
        if not found:
            continue
        i, j = (np.concatenate(side) for side in zip(*found))
        fresh = _fresh(column(batch, "keys"), i, j)
        a, b = ids[i[fresh]], ids[j[fresh]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                         ["a", "b"])


FACTS = "doc_id long, n_shingles long, point binary, _home array<long>, _low array<long>"


@tidy
def _facts(batches: Iterator[pa.RecordBatch], num: int, den: int):
    """What the search needs of a set: size, point and block keys."""
    for batch in batches:
        sizes, points, home, low = [], [], [], []
        for items in column(batch, "items"):
            u = items.values.to_numpy().view(np.uint64)
            sizes.append(u.size)
            points.append(point(u).astype("<i4").tobytes())
            own, below = block_keys(u, _mixed(u), num, den) if u.size else (None, None)
            home.append(own), low.append(below)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()),
             pa.array(home, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "point", "_home", "_low"])


def open_blocks(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of blocks of three and more that are not yet in one component, dealt into parts."""
    labelled = written(blocks.select("key", "doc_id", "home", "nth")
                       .dropDuplicates(["key", "doc_id"])
                       .join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                       .withColumn("component", F.coalesce("component", "doc_id")), "labelled")
    keys = (labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"),
                                        F.max("component").alias("hi"))
            .where("n > 2 AND lo <> hi").select("key", "n"))
    keys = written(keys, "open")
    rows = labelled.join(keys, "key")
    parts = F.ceil(F.col("n") / F.lit(PART)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("*", other)
    return rows.select("key", "doc_id", "home", "nth", "component", "part",
                       F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80,
                       den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of ``docs`` (doc_id, text).

    Two documents link when den * (common shingles) >= num * (all shingles of the two). The
    component is the least doc_id that links reach. ``class_id`` is the least doc_id with the very
    same set. All links between different sets are found: blocks miss none, bounds are upper
    bounds, and every pair that is left is verified on whole sets.

    Fewer words than ``width`` make one shingle; null, empty or word-free texts have no shingles
    and link with nothing. Rows that share a doc_id share the links of their texts. A row with a
    null id takes the component of its equals, or null. An empty table gives no rows; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shapes = written(docs.mapInArrow(lambda b: _shapes(b, width, num, den), SHAPE), "shapes")
    same = ["n_shingles", "set_a", "set_b"]
    classes = written(shapes.where("n_shingles > 0").groupBy(*same)
                      .agg(F.min("doc_id").alias("class_id")), "classes")
    # one document stands for each set; the keys of the others are left out where they are read
    others = written(shapes.select("doc_id", *same).join(classes, same)
                     .where("doc_id <> class_id").drop("class_id").distinct(), "others")
    known = docs.where("doc_id is not null")

    blocks = block_rows(shapes.where("doc_id is not null and n_shingles > 0"), others)
    stars = blocks.where("doc_id <> pivot").select(F.col("pivot").alias("a"),
                                                   F.col("doc_id").alias("b"))
    links = verified(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
                     known, width, num, den)
    comps = components(links)

    rows = open_blocks(blocks, comps)
    wanted = written(rows.select("doc_id").distinct(), "wanted")
    if not wanted.isEmpty():
        facts = written(whole_sets(known, wanted, width)
                        .mapInArrow(lambda b: _facts(b, num, den), FACTS), "facts")
        full = rows.join(facts, "doc_id").select(
            "key", "i", "j", "doc_id", "component", "home", "nth", "part", "n_shingles", "point",
            F.slice(F.when(F.col("home"), F.col("_home")).otherwise(F.col("_low")), F.lit(1),
                    F.col("nth")).alias("keys"))       # only the blocks before this one
        near = (full.repartition(parallelism(docs.sparkSession), "key", "i", "j")
                .sortWithinPartitions("key", "i", "j")
                .mapInArrow(lambda b: _search(b, num, den), "a long, b long"))
        more = verified(near, known, width, num, den)
        if not more.isEmpty():
            comps = components(links.union(more))

    labels = classes.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        *same, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    labels = written(labels, "labels")
    return (shapes.select("doc_id", *same).join(labels, same, "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component_id"))
                    .otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(F.col("n_shingles") > 0, F.col("class_id"))
                    .otherwise(F.col("doc_id")).alias("class_id")))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without those that links tie to an earlier row.

    Rows are compared, not ids: of rows that share an id, or have none, each text stands for
    itself, so a text that nothing links stays. The first row read of each component stays.
    ``docs`` must give the same rows in the same order whenever it is read, as a table does.
    """
    rows = with_rows(docs)
    found = jaccard_components(rows.select(F.col("_llm_row").alias("doc_id"), "text"), **how)
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_llm_row")), "near")
    return rows.join(gone, "_llm_row", "left_anti").select(*docs.columns)
