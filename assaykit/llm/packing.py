"""Packing documents into token sequences (operator 10).

Cost-balanced packing: a piece of n tokens costs n + n*n/scale (linear work plus attention).
Pieces are taken in descending length, each into the lowest-cost sequence of its group that has
room for it. A piece that no sequence can hold is cut: it fills the roomiest sequence (the cheapest
of several), and what is left of it takes its turn by its new length.

Descending order and lowest cost hold within a group of about ``GROUP_TOKENS`` tokens, read by one
task; groups are packed apart, so that nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.tokens import default_path, encoder, text_slices
from assaykit.llm.words import column, tidy

LENGTH = 4096
END_ID = 2
GROUP_TOKENS = 1 << 22

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def attention_cost(n, scale: float = 2048.0):
    """Estimated work of one piece: attention never crosses pieces."""
    return n + n * n / scale


def capacities(total: int, length: int) -> list[int]:
    """Full sequences, then the rest as powers of two, which need no padding."""
    rest = total % length
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return [length] * (total // length) + powers


def balanced(lengths: list[int], length: int = LENGTH,
             scale: float = 2048.0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these token counts.

    Every sequence ends up exactly full: the capacities add up to the tokens.
    """
    rooms = capacities(sum(lengths), length)
    used = [0] * len(rooms)
    out = []
    pieces = []                     # longest first; ties by document and place
    for d, n in enumerate(lengths):
        pieces += [(-length, d, s) for s in range(0, n - length + 1, length)]
        if n % length:
            pieces.append((-(n % length), d, n - n % length))
    heapq.heapify(pieces)
    # Lengths never grow, so a sequence that can hold the piece at hand goes on to be asked until
    # it is too full; then it waits under its room until pieces are short enough.
    ready: list[tuple[float, int]] = []              # room for the piece at hand, cheapest first
    waiting: dict[int, list[tuple[float, int]]] = {}
    roomiest: list[int] = []                         # rooms with waiting sequences, largest first

    def place(s, cost, n):
        room = rooms[s] - used[s]
        if room >= n:
            heapq.heappush(ready, (cost, s))
        elif room:
            if not waiting.get(room):
                waiting[room] = []
                heapq.heappush(roomiest, -room)
            heapq.heappush(waiting[room], (cost, s))

    for s in range(len(rooms)):
        place(s, 0.0, length)
    while pieces:
        n, d, start = heapq.heappop(pieces)
        n = -n
        while roomiest and -roomiest[0] >= n:
            for cost, s in waiting.pop(-heapq.heappop(roomiest)):
                heapq.heappush(ready, (cost, s))
        if ready:
            part, (cost, s) = n, heapq.heappop(ready)
        else:
            part = -roomiest[0]
            cost, s = heapq.heappop(waiting[part])
            if not waiting[part]:
                heapq.heappop(roomiest)
            heapq.heappush(pieces, (part - n, d, start + part))
        out.append((d, start, part, s, used[s]))
        used[s] += part
        place(s, cost + attention_cost(part, scale), n)
    return out


@tidy
def _pack(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int,
          group_tokens: int) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    task = TaskContext.get()
    sequence = (task.partitionId() if task else 0) << 40
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    ids: list = []
    codes: list[bytes] = []
    tokens = 0

    def flush():
        nonlocal sequence, ids, codes, tokens
        counts = [len(c) // 4 for c in codes]
        placed = balanced(counts, length)
        cols: list[list] = [[] for _ in names]
        for d, start, n, s, offset in placed:
            crc = zlib.crc32(memoryview(codes[d])[4 * start:4 * (start + n)])
            for c, v in zip(cols, (ids[d], start, n, crc, counts[d], sequence + s, offset)):
                c.append(v)
        sequence += max((p[3] for p in placed), default=-1) + 1
        ids, codes, tokens = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    for batch in batches:
        own = column(batch, "doc_id").to_pylist()
        texts = column(batch, "text")
        step = 256
        for lo in range(0, len(own), step):
            for at, run in text_slices([t or "" for t in texts.slice(lo, step).to_pylist()]):
                for k, code in enumerate(enc.encode(run)):
                    ids.append(own[lo + at + k])
                    codes.append(code + end)
                    tokens += len(code) // 4 + 1
                if tokens >= group_tokens:
                    yield flush()
    if codes:
        yield flush()


def pack(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH,
         end_id: int = END_ID, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text), as rows of ``SCHEMA``.

    Documents are tokenized and packed where they are read, in groups of about
    ``group_tokens`` tokens: no shuffle, and memory holds one group's ids plus one document.
    A group fills its sequences exactly; its last tokens go to sequences whose lengths are
    powers of two. ``sequence_id`` holds the partition in its high bits, so a task that runs
    again gives the same ids.

    A null or empty text is its end id alone. Null and repeated ids are kept as they are, each
    row being a document of its own. An empty table gives no rows. Other columns are ignored.
    """
    path = tokenizer_path or default_path()

    def run(batches):
        return _pack(batches, path, length, end_id, group_tokens)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, SCHEMA))
