"""Words of whole texts as arrays: helpers that run inside Arrow tasks.

A word is a maximal run of bytes other than space and the controls 0x09-0x0D, with A-Z
lower-cased. Words and shingles are known by 64-bit hashes; two different words share a hash
with probability about 2**-64 per pair, and every count here is a count of hashes.
Texts are handled in slices of about ``SLICE_BYTES`` (at least one whole text each), so memory
follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
_ROLL = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _byte_values() -> np.ndarray:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += U64(32)
    with np.errstate(over="ignore"):
        values = mix(lower * U64(0xD6E8FEB86659FD93) + U64(0x2545F4914F6CDD1D)) | U64(1)
    values[SPACE] = 0
    return values


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
VALUES = _byte_values()
_powers = np.ones(1, np.uint64)


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in a worker between tasks. Workers are used again by other
    operators, so whoever asks takes the place: the others' caches go."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def tidy(task):
    """An Arrow task that gives freed memory back to the machine when it ends: workers wait for
    their next task with what the allocators keep, and an executor has several of them."""
    @wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):      # another C library
                pass
    return run


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the rolling base, kept for the next call."""
    global _powers
    if _powers.size < n:
        size = max(n, 1024, 2 * _powers.size if _powers.size < 1 << 16 else n)
        steps = np.full(size, _ROLL, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes, as (first, past the last)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def runs(inside: np.ndarray, values: np.ndarray, offsets: np.ndarray):
    """Runs of ``inside`` that do not cross ``offsets``: (hashes, text index, starts, ends).

    ``values`` are 64-bit values of the positions, zero outside of runs.
    """
    n = inside.size
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts_here = offsets[:-1][offsets[:-1] < n]
    first[starts_here] = inside[starts_here]
    inner = offsets[1:-1]
    ends_here = inner[inner > 0] - 1
    last[ends_here] = inside[ends_here]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not starts.size:
        return np.zeros(0, np.uint64), none, none, none
    lead = int(starts[0])
    spans = np.diff(starts, append=n)
    within = np.arange(n - lead) - np.repeat(starts - lead, spans)
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat(values[lead:] * powers(int(spans.max()))[within], starts - lead)
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * U64(0x9FB21C651E98DF25))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every word, in reading order."""
    return runs(~SPACE[data], VALUES[data], offsets)[:2]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of texts, one after the other, and their offsets."""
    lower = [t.lower() for t in texts]
    offsets = np.append(0, np.cumsum([len(t) for t in lower], dtype=np.int64))
    return np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def letter_runs(points: np.ndarray, offsets: np.ndarray):
    """Runs of letters: (hashes, text index, starts, ends)."""
    inside = letters()[points]
    with np.errstate(over="ignore"):
        values = (points.astype(np.uint64) + U64(1)) * U64(0xD6E8FEB86659FD93)
        values ^= values >> U64(29)
    values[~inside] = 0
    return runs(inside, values, offsets)


class Lookup:
    """Places of 64-bit keys: an open-addressed table, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, keys.size) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left = np.arange(keys.size)
        self.probes = 0
        while left.size:
            at = self._slot(keys[left], self.probes)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)
                    + probe) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(keys.size, -1, np.int64)
        left = np.arange(keys.size)
        for probe in range(self.probes):
            if not left.size:
                break
            at = self.slots[self._slot(keys[left], probe)]
            hit = at >= 0
            left, at = left[hit], at[hit]
            same = self.keys[at] == keys[left]
            out[left[same]] = at[same]
            left = left[~same]
        return out


def word_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, word hashes, bounds of each text's words) for each slice."""
    data, offsets = buffers(texts)
    for lo, hi in slices(offsets):
        own = offsets[lo:hi + 1] - offsets[lo]
        hashes, text = words(data[offsets[lo]:offsets[hi]], own)
        yield lo, hi, hashes, np.searchsorted(text, np.arange(hi - lo + 1))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; a shorter text is one run."""
    if not hashes.size:
        return hashes
    with np.errstate(over="ignore"):
        if hashes.size < width:
            width = hashes.size
        out = np.full(hashes.size - width + 1, U64(width))
        for k in range(width):
            out = mix(out * U64(0xA0761D6478BD642F) + hashes[k:hashes.size - width + 1 + k])
    return out


def crc32(column):
    """``crc32`` of a column's text form."""
    from pyspark.sql import functions as F
    return F.crc32(column.cast("string").cast("binary"))
