"""Quartile bucket digests of documents (operator 2).

Every byte triplet of a text is hashed into one of 256 buckets. The digest holds, for each
bucket, the quartile of its count among all buckets (two bits), the length on a logarithmic
scale, and how the quartiles lie to each other. Two digests differ by the steps between their
codes, counted more for opposite ends; the sum is bounded and turned into a likeness of 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.shared import written
from assaykit.llm.words import U64, column, mix
from assaykit.session import parallelism

BUCKETS = 256
BOUND = 480            # differences of this size and more count as no likeness at all
STEPS = np.array([0, 1, 2, 6])
_TABLES = [(mix(np.arange(256, dtype=np.uint64) + U64(1000 * k)) >> U64(56)).astype(np.uint8)
           for k in (1, 2, 3)]
_PLACES = np.array([1, 4, 16, 64])


def digest(text: bytes) -> np.ndarray:
    """Codes of a text: 256 quartile codes, the length code, two quartile ratios."""
    b = np.frombuffer(text, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    if b.size >= 3:
        h = _TABLES[0][b[:-2]] ^ _TABLES[1][b[1:-1]] ^ _TABLES[2][b[2:]]
        counts = np.bincount(h, minlength=BUCKETS)
    q1, q2, q3 = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
    out = np.empty(BUCKETS + 3, np.int64)
    out[:BUCKETS] = (counts > q1).astype(np.int64) + (counts > q2) + (counts > q3)
    out[BUCKETS] = min(255, int(np.log1p(b.size) / np.log(1.1)))
    out[BUCKETS + 1] = 15 * q1 // q3 if q3 else 0
    out[BUCKETS + 2] = 15 * q2 // q3 if q3 else 0
    return out


def encode(codes: np.ndarray) -> str:
    """134 hex digits: length, two ratios, then the buckets, four to a byte."""
    body = (codes[:BUCKETS].reshape(-1, 4) @ _PLACES).astype(np.uint8).tobytes()
    return "%02x%x%x" % tuple(codes[BUCKETS:]) + body.hex()


def decode(fingerprint: str) -> np.ndarray:
    """The codes of ``encode``."""
    body = np.frombuffer(bytes.fromhex(fingerprint[4:]), np.uint8)
    head = [int(fingerprint[:2], 16), int(fingerprint[2], 16), int(fingerprint[3], 16)]
    return np.append((body[:, None] // _PLACES % 4).ravel(), head).astype(np.int64)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """1 for equal digests, 0 from a difference of ``BOUND``."""
    d = np.abs(x - y)
    total = int(STEPS[d[:BUCKETS]].sum()) + 2 * int(d[BUCKETS]) + int(d[BUCKETS + 1:].sum())
    return 1.0 - min(total, BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _row(doc_id, text: str, own: np.ndarray, following: str, nxt: np.ndarray) -> tuple:
    raw = edited(text, following).encode()
    other = digest(raw)
    return (doc_id, len(text), hashlib.sha256(raw).hexdigest(), encode(own), encode(other),
            likeness(own, other), likeness(own, nxt))


def _types():
    return [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
            pa.float64()]


def _chain(batches: Iterator[pa.RecordBatch]):
    """Rows in order, each finished by the one after it; the last of a partition stays open."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    last, head = None, None

    def out(rows, heads, tails):
        cols = list(zip(*rows)) if rows else [[] for _ in NAMES]
        arrays = [pa.array(c, t) for c, t in zip(cols, _types())]
        return pa.RecordBatch.from_arrays(
            arrays + [pa.array([part] * len(rows), pa.int32()), pa.array(heads, pa.string()),
                      pa.array(tails, pa.string())], [*NAMES, "part", "head", "tail"])

    for batch in batches:
        ids, texts = column(batch, "doc_id").to_pylist(), column(batch, "text")
        for lo in range(0, len(ids), 256):
            rows, heads = [], []
            for doc_id, text in zip(ids[lo:lo + 256], texts.slice(lo, 256).to_pylist()):
                text = text or ""
                own = digest(text.encode())
                if last is None:
                    head = text
                else:
                    rows.append(_row(*last, text, own))
                    heads.append(head)
                    head = None
                last = doc_id, text, own
            yield out(rows, heads, [None] * len(rows))
    if last is not None:
        doc_id, text, _ = last
        yield out([(doc_id, *[None] * 6)], [head], [text])


def _finish(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = []
        for doc_id, text, nxt in zip(*(column(batch, c).to_pylist()
                                       for c in ("doc_id", "tail", "following"))):
            rows.append(_row(doc_id, text, digest(text.encode()), nxt, digest(nxt.encode())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[] for _ in NAMES], _types())],
            NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with the columns of ``COLUMNS``.

    The next document is the one that follows in descending doc_id (null ids last, equal ids by a
    hash of the text); the first follows the last. Texts move once, into ranges of doc_id; where
    two ranges meet, one text of each range is joined. Null counts as empty; empty texts have the
    digest of no triplets. A table of one row is followed by itself. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chained = written(
        rows.repartitionByRange(parallelism(spark), F.desc_nulls_last("doc_id"))
        .sortWithinPartitions(*order)
        .mapInArrow(_chain, COLUMNS + ", part int, head string, tail string"), "chained")
    done = chained.where("tail is null").select(*NAMES)
    # one row per range: a window over them all is bounded by the number of partitions
    ends = chained.where("tail is not null").select("doc_id", "part", "tail")
    heads = chained.where("head is not null").select(F.col("part").alias("other"),
                                                     F.col("head").alias("following"))
    ring = Window.orderBy("part")
    ends = ends.withColumn("other", F.lead("part").over(ring)).withColumn(
        "other", F.coalesce("other", F.first("part").over(ring)))
    open_rows = ends.join(heads, "other").select("doc_id", "tail", "following")
    return done.unionByName(open_rows.mapInArrow(_finish, COLUMNS))
