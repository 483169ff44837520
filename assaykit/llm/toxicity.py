"""Toxicity by class-conditional Kneser-Ney models of letters (operator 4).

Two interpolated Kneser-Ney models of order ``ORDER``, one of toxic and one of ordinary text, over
the stream of a text's letters with one mark between words. At the highest order each class has
its own counts, discounted absolutely; what the discount frees goes to the lower orders, which
both classes share: there a gram counts by the number of different letters that come before it
in either class (continuation counts), down to single letters and the uniform distribution. So
an expression that a class has rarely seen is smoothed towards what is common to both, and one
that neither has seen says only what its context says.

A text's evidence is the difference of its two log-likelihoods divided by its length; a logistic
curve, fitted on labelled rows that the counts have not seen, turns it into a score. Orders above
the word (pairs of words) and whole words were tried and left out: the mixture of languages in
the classes drowned them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.shared import written
from assaykit.llm.tokens import text_slices
from assaykit.llm.words import U64, Lookup, code_points, column, crc32, letter_runs, mix

SAMPLE_ROWS = 12000     # at most so many labelled rows are fitted on
ORDER = 4               # letters of an n-gram
DISCOUNT = 0.75
PRIOR_LENGTH = 300      # letters by which a text's length is raised: short texts say little
THRESHOLD = 0.7
STEP = 512


def stream(run: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of texts with a zero before each word, and the text of each position."""
    points, offsets = code_points(run)
    _, text, starts, ends = letter_runs(points, offsets)
    spans = ends - starts
    total = int(spans.sum())
    within = np.arange(total) - np.repeat(np.cumsum(spans) - spans, spans)
    out = np.zeros(total + spans.size, np.uint64)
    out[np.arange(total) + np.repeat(np.arange(spans.size) + 1, spans)] = \
        points[np.repeat(starts, spans) + within]
    return out, np.repeat(text, spans + 1)


def gram_hash(v: np.ndarray, last: int, length: int, n: int) -> np.ndarray:
    """Hashes of the ``length`` letters up to place ``last`` of ``n`` grams, one place apart."""
    h = np.full(n, U64(length))
    with np.errstate(over="ignore"):
        for k in range(last - length + 1, last + 1):
            h = mix(h * U64(0xA0761D6478BD642F) + v[k:n + k])
    return h


def ngrams(run: list[str], order: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts, and their text.

    One row per hash: the gram and its context (all but its last letter); with ``lower`` also
    those of its last ``order - 1``, ``order - 2``, ... letters, and last the single letter.
    """
    x, text = stream(run)
    n = max(0, x.size - order + 1)
    ok = text[order - 1:] == text[:n]
    v = mix(x + U64(77))
    rows = [gram_hash(v, order - 1 - away, length - away, n)
            for length in range(order, 1 if lower else order - 1, -1) for away in (0, 1)]
    rows += [gram_hash(v, order - 1, 1, n)] if lower else []
    return np.stack(rows)[:, ok], text[order - 1:][ok]


def gram_columns(order: int) -> list[str]:
    """Names of the rows of ``ngrams`` with lower orders: g4, c4, g3, c3, g2, c2, g1."""
    return [f"{kind}{k}" for k in range(order, 1, -1) for kind in "gc"] + ["g1"]


def _runs(texts: pa.Array):
    for lo in range(0, len(texts), STEP):
        for at, run in text_slices([t or "" for t in texts.slice(lo, STEP).to_pylist()]):
            yield lo + at, run


def _count(batches: Iterator[pa.RecordBatch], order: int):
    """(toxic, the columns of ``gram_columns``, count) of a batch of labelled rows."""
    names = gram_columns(order)
    for batch in batches:
        toxic = column(batch, "toxic").to_numpy()
        parts: dict[int, list] = {0: [], 1: []}
        for at, run in _runs(column(batch, "text")):
            h, text = ngrams(run, order, lower=True)
            for c in (0, 1):
                parts[c].append(h[:, toxic[at + text] == c])
        for c, found in parts.items():
            if not found:
                continue
            h = np.concatenate(found, axis=1)
            keys, first, counts = np.unique(h[0], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(keys.size, c, np.int32)),
                 *[pa.array(row[first].view(np.int64)) for row in h], pa.array(counts)],
                ["toxic", *names, "count"])


@dataclass
class Model:
    """Log-likelihood differences (toxic less ordinary), and the logistic curve."""
    keys: np.ndarray
    llr: np.ndarray
    context_keys: np.ndarray
    context_llr: np.ndarray
    slope: float = 0.0
    bias: float = -3.0
    order: int = ORDER

    def tables(self):
        if not hasattr(self, "_tables"):
            self._tables = Lookup(self.keys), Lookup(self.context_keys)
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def evidence(self, run: list[str]) -> np.ndarray:
        """Length-normalised log-likelihood difference of each text."""
        (h, context), text = ngrams(run, self.order)
        table, contexts = self.tables()
        at = table.find(h)
        hit = at >= 0
        llr = np.zeros(h.size)
        llr[hit] = self.llr[at[hit]]
        rest = np.flatnonzero(~hit)
        at = contexts.find(context[rest])
        llr[rest[at >= 0]] = self.context_llr[at[at >= 0]]
        n = np.bincount(text, minlength=len(run))
        return np.bincount(text, llr, minlength=len(run)) / (n + PRIOR_LENGTH)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -30, 30)))


def shared_probabilities(grams: pd.DataFrame, order: int, d: float) -> np.ndarray:
    """Kneser-Ney probability of the last letter of each gram after its last ``order - 2`` letters,
    from the distinct grams of both classes.

    A shorter gram counts by the different letters before it, that is by the distinct grams one
    letter longer that end in it.
    """
    longer = grams
    levels = []
    for k in range(order - 1, 0, -1):
        rest = gram_columns(k)
        level = longer.groupby(f"g{k}", sort=False).agg(
            **{c: (c, "first") for c in rest if c != f"g{k}"}, n=(f"g{k}", "size")).reset_index()
        levels.append(level)
        longer = level
    single = levels.pop()
    seen, total = len(single), max(int(single["n"].sum()), 1)
    # a letter that was never seen has the share of one among those that were
    single["p"] = (single["n"] - d) / total + d * seen / total / (seen + 1)
    below = single
    for k, level in zip(range(2, order), reversed(levels)):
        context = level.groupby(f"c{k}")["n"]
        t, kinds = context.transform("sum"), context.transform("size")
        backoff = level[f"g{k - 1}"].map(below.set_index(f"g{k - 1}")["p"])
        level["p"] = (level["n"] - d) / t + d * kinds / t * backoff
        below = level
    return grams[f"g{order - 1}"].map(below.set_index(f"g{order - 1}")["p"]).to_numpy(float)


def probabilities(counts: pd.DataFrame, order: int, d: float) -> pd.DataFrame:
    """Per distinct gram: its columns, ``shared``, and of each class the probability of its last
    letter (p0, p1) and the share that its context leaves to the lower orders (l0, l1)."""
    names = gram_columns(order)
    wide = counts.pivot_table(index=names[0], columns="toxic", values="count", aggfunc="sum",
                              fill_value=0)
    out = counts.drop_duplicates(names[0]).set_index(names[0])[names[1:]].loc[wide.index].reset_index()
    out["shared"] = shared_probabilities(out, order, d)
    for c in (0, 1):
        x = pd.Series(wide[c].to_numpy(float) if c in wide else np.zeros(len(wide)))
        by = out[names[1]]
        total, kinds = x.groupby(by).transform("sum"), (x > 0).groupby(by).transform("sum")
        some = np.maximum(total, 1)
        out[f"l{c}"] = np.where(total > 0, d * kinds / some, 1.0)
        out[f"p{c}"] = np.maximum(x - d, 0) / some + out[f"l{c}"] * out["shared"]
    return out


def build(counts: pd.DataFrame, order: int = ORDER, d: float = DISCOUNT) -> Model:
    """A model of gram counts (toxic, the columns of ``gram_columns``, count)."""
    if not len(counts):
        none = np.zeros(0)
        return Model(none.astype(np.uint64), none, none.astype(np.uint64), none, order=order)
    p = probabilities(counts, order, d)
    contexts = p.drop_duplicates(f"c{order}").sort_values(f"c{order}")

    def keys(frame, name):
        return frame[name].to_numpy(np.int64).view(np.uint64)

    return Model(keys(p, f"g{order}"), np.log(p["p1"] / p["p0"]).to_numpy(),
                 keys(contexts, f"c{order}"), np.log(contexts["l1"] / contexts["l0"]).to_numpy(),
                 order=order)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias of a one-feature logistic curve, by Newton steps."""
    scale = max(float(x.std()), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, learnable: Column,
                  limit: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, fold, text) of at most ``limit`` labelled rows, chosen by hash.

    Labels that contradict each other are left out. Fold 0 makes the counts, fold 1 the curve.
    """
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
             .where("toxic = _most").where(learnable)
             .select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"),
                     (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)) >= 7)
                     .cast("int").alias("fold")))
    n = marks.count()
    if n > limit:
        u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
        # the smallest hashes: of the few rows that the share lets through, exactly the first
        marks = marks.where(u < int((1 << 30) * 1.1 * limit / n)).orderBy(u, "doc_id").limit(limit)
    # broadcast is safe: the limit above bounds this side, about 24 bytes a row
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(marks), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, learnable: Column,
        limit: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows where ``learnable`` (of doc_id) holds."""
    rows = written(training_rows(docs, labels, learnable, limit), "labelled")
    names = gram_columns(ORDER)
    # the other columns follow from the gram
    counts = (rows.where("fold = 0").select("toxic", "text")
              .mapInArrow(lambda b: _count(b, ORDER),
                          f"toxic int, {', '.join(f'{c} long' for c in names)}, count long")
              .groupBy("toxic", names[0]).agg(F.sum("count").alias("count"),
                                              *[F.min(c).alias(c) for c in names[1:]]))
    model = build(counts.toPandas())
    tune = rows.where("fold = 1").select("toxic", "text").mapInArrow(
        lambda b: _evidence(b, model, "toxic"), "toxic int, evidence double").toPandas()
    if tune["toxic"].nunique() == 2:
        model.slope, model.bias = logistic(tune["evidence"].to_numpy(),
                                           tune["toxic"].to_numpy(float))
    return model


def _evidence(batches, model: Model, keep: str):
    for batch in batches:
        found = [model.evidence(run) for _, run in _runs(column(batch, "text"))]
        yield pa.RecordBatch.from_arrays(
            [column(batch, keep), pa.array(np.concatenate(found) if found else np.zeros(0))],
            [keep, "evidence"])


def _scores(batches, model: Model):
    for batch in _evidence(batches, model, "doc_id"):
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(model.score(column(batch, "evidence").to_numpy()))],
            ["doc_id", "score"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``, judged by its whole text alone.

    Null and empty texts and texts without letters score as a text without evidence. Rows are
    judged one by one: repeated and null ids are kept, an empty table gives no rows, other
    columns are ignored. Without labels of both kinds every text gets the same low score.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(lambda b: _scores(b, model), "doc_id long, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def held_out() -> Column:
    return F.coalesce(F.pmod(crc32(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
