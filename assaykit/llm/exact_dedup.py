"""Exact deduplication through content-defined chunk recipes (operator 1).

Each text is cut where a rolling hash of its bytes says so, so a text's cuts follow from its
content. A chunk's identifier is its SHA-256 digest. Identifiers are verified: over all chunks
of all texts, each digest must come with one BLAKE2b check value and length alone; if any comes
with two, the check values join the identifiers. Texts are equal when their ordered identifier
lists are equal. The bytes are read once, where they lie; only identifier lists are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.shared import with_rows, written
from assaykit.llm.words import SLICE_BYTES, U64, VALUES, buffers, column, kept, mix, slices, tidy

MIN_CHUNK, AVERAGE_BITS, MAX_CHUNK = 512, 11, 16384
WINDOW = 32
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where the hash of the last ``WINDOW`` bytes has ``AVERAGE_BITS`` zero bits."""
    if data.size < WINDOW:
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    with np.errstate(over="ignore"):
        step = 1
        while step < WINDOW:
            h = h[step:] + (h[:-step] << U64(step))
            step *= 2
    return np.flatnonzero(h >> U64(64 - AVERAGE_BITS) == 0) + WINDOW


def chunk_ends(places: np.ndarray, lo: int, hi: int) -> list[int]:
    """Ends of the chunks of the text in bytes lo..hi: cuts at least MIN_CHUNK apart, and
    a forced cut after MAX_CHUNK bytes. A cut's window lies within the text."""
    ends, at = [], lo
    own = places[np.searchsorted(places, lo + WINDOW):np.searchsorted(places, hi)].tolist()
    k = 0
    while hi - at > MIN_CHUNK:
        while k < len(own) and own[k] - at < MIN_CHUNK:
            k += 1
        end = min(own[k] if k < len(own) else hi, at + MAX_CHUNK, hi)
        ends.append(end)
        at = end
    if at < hi or not ends:
        ends.append(hi)
    return ends


def _texts(batches: Iterator[pa.RecordBatch]):
    """(batch, row, bytes, ends of chunks) of every text."""
    kept("chunks")
    for batch in batches:
        data, offsets = buffers(column(batch, "text"))
        for lo, hi in slices(offsets, SLICE_BYTES):
            base = int(offsets[lo])
            part = data[base:offsets[hi]]
            places = cuts(part)
            raw = part.tobytes()
            for row in range(lo, hi):
                a, b = int(offsets[row]) - base, int(offsets[row + 1]) - base
                yield batch, row, raw, a, chunk_ends(places, a, b)


def _digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def _check(raw: bytes) -> int:
    """A second, independent digest, with the length."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, person=b"%d" % len(raw)).digest(),
                          "little", signed=True)


@tidy
def _recipes(batches, digest: Callable[[bytes], bytes]):
    """(row columns, SHA-256 of the text, digests and check values of its chunks) of every row."""
    at_batch, rows = None, []

    def out():
        shas, recipes, checks = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [column(at_batch, "doc_id"), column(at_batch, "row_id"), pa.array(shas),
             pa.array(recipes, pa.binary()), pa.array(checks, pa.list_(pa.int64()))],
            ["doc_id", "row_id", "text_sha256", "recipe", "checks"])

    for batch, _, raw, at, ends in _texts(batches):
        if batch is not at_batch:
            if rows:
                yield out()
            at_batch, rows = batch, []
        sha, parts, checks = hashlib.sha256(raw[at:ends[-1]]).hexdigest(), [], []
        for end in ends:
            chunk = raw[at:end]
            parts.append(digest(chunk))
            checks.append(_check(chunk))
            at = end
        rows.append((sha, b"".join(parts), checks))
    if rows:
        yield out()


def clashes(recipes: DataFrame, width: int) -> DataFrame:
    """Digests that stand for several contents."""
    chunks = recipes.select("recipe", F.posexplode("checks").alias("at", "check"))
    return (chunks.select(F.expr(f"substring(recipe, at * {width} + 1, {width})").alias("digest"),
                          "check")
            .groupBy("digest").agg(F.min("check").alias("least"), F.max("check").alias("most"))
            .where("least <> most"))


def recipe_table(docs: DataFrame, digest: Callable[[bytes], bytes] = _digest) -> DataFrame:
    """One row per document: doc_id, row_id, text_sha256, recipe (verified identifiers)."""
    rows = with_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"),
                                  F.col("_llm_row").alias("row_id"), "text")
    recipes = written(rows.mapInArrow(
        lambda b: _recipes(b, digest), "doc_id long, row_id long, text_sha256 string, "
        "recipe binary, checks array<long>"), "recipes")
    if clashes(recipes, len(digest(b""))).isEmpty():
        return recipes.drop("checks")
    checks = F.array_join(F.col("checks").cast("array<string>"), ",").cast("binary")
    return recipes.withColumn("recipe", F.concat("recipe", checks)).drop("checks")


def exact_groups(docs: DataFrame, digest: Callable[[bytes], bytes] = _digest) -> DataFrame:
    """doc_id, row_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are compared unchanged; null counts as empty, so null and empty texts are one group.
    The row with the largest doc_id of a group stays (one with a null id only where all are null);
    of rows that repeat that id, the first stays. ``docs`` must give the same rows in the same
    order whenever it is read, as a table does. An empty table gives no rows; other columns are
    ignored. Groups combine before the shuffle, and the join back splits a hot group's rows
    (adaptive skew join), as only groups of two and more are joined.
    """
    recipes = recipe_table(docs, digest)
    order = F.expr("cast(coalesce(doc_id, -9223372036854775808) as decimal(38,0))"
                   " * 10000000000000000000BD - row_id")
    groups = written(
        recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"),
                                      F.count("*").alias("group_size"),
                                      F.max_by("row_id", order).alias("keep_row"))
        .where("group_size > 1"), "groups")
    single = F.col("group_size").isNull()
    return (recipes.join(groups, "recipe", "left")
            .select("doc_id", "row_id",
                    F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (single | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
                    "text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = written(exact_groups(docs).where("NOT kept").select(F.col("row_id").alias("_llm_row")),
                   "dropped")
    return with_rows(docs).join(gone, "_llm_row", "left_anti").drop("_llm_row")
