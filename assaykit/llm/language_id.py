"""Language identification by words, then character n-grams (operator 6).

A known word scores its log frequency in each language. An unseen word falls back to its
characters: at every letter the longest known n-gram that ends there (four letters down to one,
a word's beginning counting as a letter) scores its log frequency, shared among its letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.shared import with_rows, written
from assaykit.llm.tokens import text_slices
from assaykit.llm.words import (U64, Lookup, code_points, column,
                                crc32, kept, letter_runs, letters, mix, tidy)

LONGEST = 4
SAMPLE_ROWS = 20000     # at most about so many rows are fitted on,
SAMPLE_CHARS = 1 << 27  # with so many characters
MIN_COUNT = 3           # a word or n-gram is known from so many occurrences in the sample
UNKNOWN = "und"
STEP = 512


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int):
    """Hash of the n-gram that ends at each letter of the words, or -> ok False where too short."""
    spans = ends - starts
    place = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
    at = np.repeat(starts, spans) + place
    h = np.full(at.size, U64(n))
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            before = place - k
            c = np.where(before < 0, 0, points[np.maximum(at - k, 0)]).astype(np.uint64)
            h = mix(h * U64(0xA0761D6478BD642F) + c + U64(1))
    return h, place + 2 >= n


@tidy
def _count(batches: Iterator[pa.RecordBatch]):
    kept("language")
    for batch in batches:
        langs, texts = column(batch, "lang").to_pylist(), column(batch, "text")
        totals: dict[tuple[str, int], list] = {}
        for lo in range(0, len(langs), STEP):
            for at, run in text_slices([t or "" for t in texts.slice(lo, STEP).to_pylist()]):
                points, offsets = code_points(run)
                hashes, text, starts, ends = letter_runs(points, offsets)
                names = np.array(langs[lo + at:lo + at + len(run)], object)[text]
                for name in set(names):
                    own = names == name
                    totals.setdefault((name, 0), []).append(hashes[own])
                    for n in range(1, LONGEST + 1):
                        h, ok = grams(points, starts[own], ends[own], n)
                        totals.setdefault((name, n), []).append(h[ok])
            for (name, n), parts in totals.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * keys.size, pa.string()), pa.array([n] * keys.size, pa.int32()),
                     pa.array(keys.view(np.int64)), pa.array(counts)],
                    ["lang", "n", "hash", "count"])
            totals = {}


@dataclass
class Model:
    """Log frequencies by language: row 0 words, rows 1.. n-grams of that length."""
    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    floors: list[np.ndarray]

    def tables(self) -> list[Lookup]:
        if not hasattr(self, "_tables"):
            self._tables = [Lookup(k) for k in self.keys]
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}


def bounded(rows: DataFrame, limit: int, *key: Column | str,
            limit_chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most about ``limit`` rows with about ``limit_chars`` characters of ``text``, by hash."""
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share = min(1.0, limit / max(n, 1), limit_chars / max(chars, 1))
    if share == 1.0:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 20))
                      < int((1 << 20) * share))


def fit(docs: DataFrame, learnable: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows where ``learnable`` holds and text and lang are present."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = bounded(rows.select("doc_id", "lang", "text"), sample_rows, "doc_id")
    counts = written(rows.select("lang", "text")
                     .mapInArrow(_count, "lang string, n int, hash long, count long")
                     .groupBy("lang", "n", "hash").agg(F.sum("count").alias("count")), "ngrams")
    totals = counts.groupBy("lang", "n").agg(F.sum("count").alias("total")).toPandas()
    langs = sorted(totals["lang"].unique())
    per = counts.groupBy("n", "hash").agg(
        F.sum("count").alias("all"),
        *[F.sum(F.when(F.col("lang") == lang, F.col("count")).otherwise(0)).alias(f"c{k}")
          for k, lang in enumerate(langs)])
    known = per.where(F.col("all") >= MIN_COUNT).toPandas() if langs else pd.DataFrame(
        {"n": [], "hash": []})
    total = {(r.lang, r.n): r.total for r in totals.itertuples()}
    keys, logs, floors = [], [], []
    for n in range(LONGEST + 1):
        part = known[known["n"] == n].sort_values("hash")
        k = part["hash"].to_numpy(np.int64).view(np.uint64)
        c = np.stack([part[f"c{i}"].to_numpy(float) for i in range(len(langs))], axis=1) if langs \
            else np.zeros((0, 0))
        all_n = np.array([total.get((lang, n), 0) for lang in langs], float)
        keys.append(k)
        logs.append(np.log((c + 0.1) / (all_n + 0.1 * (len(k) + 1))).astype(np.float32))
        floors.append(np.log(0.1 / (all_n + 0.1 * (len(k) + 1))).astype(np.float32))
    return Model(langs, keys, logs, floors)


def score_words(model: Model, points, hashes, starts, ends) -> np.ndarray:
    """Per-language log score of every word."""
    tables, width = model.tables(), len(model.langs)
    out = np.zeros((hashes.size, width), np.float32)
    at = tables[0].find(hashes)
    out[at >= 0] = model.logs[0][at[at >= 0]]
    unseen = np.flatnonzero(at < 0)
    if not unseen.size:
        return out
    s, e = starts[unseen], ends[unseen]
    spans = e - s
    firsts = np.cumsum(spans) - spans
    scores = np.repeat(model.floors[1][None, :], int(spans.sum()), axis=0)
    open_ = np.ones(len(scores), bool)
    for n in range(LONGEST, 0, -1):
        h, ok = grams(points, s, e, n)
        rest = np.flatnonzero(open_ & ok)
        found = tables[n].find(h[rest])
        hit = rest[found >= 0]
        scores[hit] = model.logs[n][found[found >= 0]] / n
        open_[hit] = False
    out[unseen] = np.add.reduceat(scores, firsts, axis=0)
    return out


@tidy
def _predict(batches: Iterator[pa.RecordBatch], model: Model):
    kept("language")
    names = np.array([*model.langs, UNKNOWN], object)
    is_letter = letters()
    for batch in batches:
        texts = column(batch, "text")
        preds, scores = [], []
        for lo in range(0, len(texts), STEP):
            for _, run in text_slices([t or "" for t in texts.slice(lo, STEP).to_pylist()]):
                points, offsets = code_points(run)
                hashes, text, starts, ends = letter_runs(points, offsets)
                n = len(run)
                sums = np.zeros((n, len(model.langs)))
                words = np.bincount(text, minlength=n)
                if hashes.size and model.langs:
                    per = score_words(model, points, hashes, starts, ends)
                    for k in range(len(model.langs)):
                        sums[:, k] = np.bincount(text, per[:, k], minlength=n)
                    # evidence of a text's words is not independent: it grows as their root
                    z = sums / np.sqrt(np.maximum(words, 1))[:, None]
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = np.where(words > 0, sums.argmax(axis=1), len(model.langs))
                    score = np.where(words > 0, p.max(axis=1), 0.0)
                else:
                    best, score = np.full(n, len(model.langs)), np.zeros(n)
                preds += names[best].tolist()
                scores += score.tolist()
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [column(batch, c) for c in rest] + [pa.array(preds, pa.string()),
                                                pa.array(scores, pa.float64())],
            [*rest, "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``, judged by its whole text alone.

    A null text or one without a letter is ``und`` with score 0; so is everything when nothing
    could be learned. The score is the share of the predicted language among all, with the
    evidence of n words weighted as their square root. Rows are judged one by one: repeated and
    null ids are kept, an empty table gives no rows, other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _predict(b, model), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a predicted language and a score of ``least`` or more.

    Only texts go to the model; the rows that go come back as row ids. ``docs`` must give the
    same rows in the same order whenever it is read, as a table does.
    """
    judged = with_rows(docs).select("_llm_row", "text").mapInArrow(
        lambda b: _predict(b, model), "_llm_row long, lang_pred string, score double")
    gone = written(judged.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least))
                   .select("_llm_row"), "unidentified")
    return with_rows(docs).join(gone, "_llm_row", "left_anti").drop("_llm_row")


def held_out() -> Column:
    """Whether a row is held out of the fit; one with a null id is not."""
    return F.coalesce(F.pmod(crc32(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
