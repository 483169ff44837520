"""Language-model scoring by a weighted backoff automaton (operator 9).

Every word and every word pair of the training texts is counted. A pair seen ``MIN_PAIR`` times
or more has an arc with its discounted log-probability, at every size of the corpus; every word
is a state, with a failure arc to the root that charges its backoff weight. A text's score is the
sum over its words of root arc and failure arc, corrected at each pair with an arc by what the
arc differs from that way. So words and pairs are looked up one by one: the ``CACHE`` most
frequent of either are held in the tasks, and all others come from joins with the whole tables
of counts. The cache decides where a value is found and not what it is: no count is approximated
or left out, and what is gathered grows with the corpus.

A pair is known by a 64-bit hash of its two words. A bitmap of fixed size spares the join pairs
that surely have no arc; the more pairs have one, the fewer it spares.

At the root, words seen once to ``KATZ`` times have Good-Turing probabilities, unseen words
share what the words seen once make up, and the rest is in proportion to the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.shared import written
from assaykit.llm.words import U64, Lookup, column, crc32, mix, word_slices

CACHE = 1 << 20         # words, and pairs, that every task holds
MIN_PAIR = 2            # training count from which a pair has an arc
TURN = 21               # bits by which the first word's hash is turned in a pair's hash
BITS = 27               # of a pair's hash that place it in the bitmap
DISCOUNT = 0.6
KATZ = 5
END = np.int64(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])   # the token after the last word
FLUSH = 1 << 18


def with_end(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts, each followed by the end token, and their new bounds."""
    out = np.insert(hashes.view(np.int64), at[1:], END)
    return out, at + np.arange(at.size)


def _count(batches: Iterator[pa.RecordBatch]):
    """(word, training count, count) of runs of texts."""
    parts: list = []
    size = 0

    def rows():
        words = np.concatenate([p[0] for p in parts])
        train = np.concatenate([p[1] for p in parts])
        keys, of = np.unique(words, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.bincount(of, train).astype(np.int64)),
             pa.array(np.bincount(of).astype(np.int64))], ["word", "c", "seen"])

    for batch in batches:
        train = column(batch, "train").to_numpy(zero_copy_only=False)
        for lo, hi, hashes, at in word_slices(column(batch, "text")):
            words, bounds = with_end(hashes, at)
            parts.append((words, np.repeat(train[lo:hi], np.diff(bounds)).astype(float)))
            size += words.size
            if size > 16 * FLUSH:
                yield rows()
                parts, size = [], 0
    if parts:
        yield rows()


def pair_codes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs within texts, and the places of their first words."""
    inner = np.ones(max(0, words.size - 1), bool)
    inner[bounds[1:-1] - 1] = False
    at = np.flatnonzero(inner)
    w = words.view(np.uint64)
    return ((w[at] << U64(TURN)) | (w[at] >> U64(64 - TURN))) ^ w[at + 1], at


def pair_code(u: Column, w: Column) -> Column:
    """The hash of ``pair_codes`` in Spark."""
    turned = F.shiftleft(u, TURN).bitwiseOR(F.shiftrightunsigned(u, 64 - TURN))
    return turned.bitwiseXOR(w)


def _pairs(batches: Iterator[pa.RecordBatch]):
    """(first word, second word, count) of pairs of training texts."""
    parts: list = []
    size = 0

    def rows():
        code, u = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        code, first, counts = np.unique(code, return_index=True, return_counts=True)
        u = u[first]
        w = code ^ ((u << U64(TURN)) | (u >> U64(64 - TURN)))
        return pa.RecordBatch.from_arrays(
            [pa.array(u.view(np.int64)), pa.array(w.view(np.int64)), pa.array(counts)],
            ["u", "w", "count"])

    for batch in batches:
        for lo, hi, hashes, at in word_slices(column(batch, "text")):
            words, bounds = with_end(hashes, at)
            code, first = pair_codes(words, bounds)
            parts.append((code, words.view(np.uint64)[first]))
            size += code.size
            if size > 16 * FLUSH:
                yield rows()
                parts, size = [], 0
    if parts:
        yield rows()


@dataclass
class Automaton:
    """The machine in one piece, state by state: the definition that ``score`` is checked by."""
    frequent: np.ndarray         # hashes of the words, sorted: state ids
    root: np.ndarray             # their log10 probabilities at the root
    arcs: dict[int, float]       # code of a kept pair -> log10 probability
    backoff: list[float]         # log10 backoff weight of each state

    def walk(self, ids: list[int]) -> float:
        """Accumulated log10 probability of a text, without the root arcs of words without id."""
        n, state, total = self.frequent.size, -1, 0.0
        for w in ids:
            p = self.arcs.get(state * n + w) if state >= 0 and w >= 0 else None
            if p is None:
                total += (self.backoff[state] if state >= 0 else 0.0)
                total += (float(self.root[w]) if w >= 0 else 0.0)
            else:
                total += p
            state = w
        return total


@dataclass
class Cache:
    """What tasks hold of the tables of words and arcs, and where arcs may be."""
    words: np.ndarray       # hashes of the most frequent words
    weight: np.ndarray      # their root arc and failure arc
    base: np.ndarray        # log10 (c + 1) of them
    arcs: np.ndarray        # hashes of the most frequent pairs
    gain: np.ndarray        # what their arcs differ from failure and root arc
    bitmap: np.ndarray      # of all other pairs with arcs

    def tables(self):
        if not hasattr(self, "_tables"):
            self._tables = Lookup(self.words), Lookup(self.arcs)
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def may_be(self, codes: np.ndarray) -> np.ndarray:
        word, bit = codes >> U64(64 - BITS + 6), (codes >> U64(64 - BITS)) & U64(63)
        return (self.bitmap[word.astype(np.int64)] >> bit) & U64(1) > 0


def _counted(keys: np.ndarray, of: np.ndarray, texts: int):
    """Per text, the distinct keys and their counts; ``of`` is in order."""
    bounds = np.searchsorted(of, np.arange(texts + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        found, counts = np.unique(keys[a:b], return_counts=True)
        yield found.view(np.int64), counts.astype(np.int32)


def _traverse(batches: Iterator[pa.RecordBatch], m: Cache):
    """Per text: tokens, sums over what is held; and its other words and pairs with counts."""
    for batch in batches:
        table, arcs = m.tables()
        for lo, hi, hashes, at in word_slices(column(batch, "text")):
            words, bounds = with_end(hashes, at)
            n = hi - lo
            of = np.repeat(np.arange(n), np.diff(bounds))
            place = table.find(words.view(np.uint64))
            hit = place >= 0
            codes, first = pair_codes(words, bounds)
            arc = arcs.find(codes)
            on = arc >= 0
            score = (np.bincount(of[hit], m.weight[place[hit]], minlength=n)
                     + np.bincount(of[first[on]], m.gain[arc[on]], minlength=n))
            asked = np.flatnonzero(~on)
            asked = asked[m.may_be(codes[asked])]
            others = [(*w, *p) for w, p in zip(
                _counted(words[~hit], of[~hit], n), _counted(codes[asked], of[first[asked]], n))]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").slice(lo, n), column(batch, "row_id").slice(lo, n),
                 pa.array(np.diff(bounds).astype(np.int64)),
                 pa.array(np.bincount(of[hit], minlength=n).astype(np.int64)),
                 pa.array(np.bincount(of[hit], m.base[place[hit]], minlength=n).astype(float)),
                 pa.array(score.astype(float)),
                 *[pa.array([o[k] for o in others], pa.list_(pa.int32() if k % 2 else pa.int64()))
                   for k in range(4)]],
                ["doc_id", "row_id", "n_tokens", "n_known", "base", "score", "rare", "times",
                 "codes", "code_times"])


def word_counts(docs: DataFrame, learnable: Column) -> DataFrame:
    """(word, c, seen): occurrences of every word in the training texts and in all texts."""
    rows = docs.select(learnable.alias("train"), "text")
    return written(rows.mapInArrow(_count, "word long, c long, seen long")
                   .groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")),
                   "counts")


@dataclass
class Root:
    """The root's distribution, from the counts of counts."""
    n: int
    v: int
    star: list[float]      # Good-Turing counts of words seen 1..KATZ times
    rest: float            # what multiplies the higher counts
    unseen: float

    def log10(self, c: Column) -> Column:
        out = F.when(c == 0, float(np.log10(self.unseen)))
        for k, s in enumerate(self.star, 1):
            out = out.when(c == k, float(np.log10(s / max(1, self.n))))
        return out.otherwise(F.log10(c.cast("double") * (self.rest / max(1, self.n))))


def root_of(n: int, v: int, ones: list[int]) -> Root:
    """``ones[k]`` is the number of words seen k + 1 times."""
    unseen = (ones[0] + 1) / (n + 2)
    star, mass = [], 0.0
    for k in range(1, KATZ + 1):
        s = (k + 1) * ones[k] / ones[k - 1] if ones[k - 1] and ones[k] else float(k)
        star.append(min(s, float(k)))
        mass += star[-1] * ones[k - 1]
    high = n - sum((k + 1) * ones[k] for k in range(KATZ))
    rest = (n * (1 - unseen) - mass) / high if high > 0 else 1.0
    if rest <= 0 or high <= 0:        # too few words for Good-Turing: all counts in proportion
        star, rest = [k * (1 - unseen) for k in range(1, KATZ + 1)], 1 - unseen
    return Root(n, v, star, rest, unseen)


def most_frequent(df: DataFrame, c: str, limit: int) -> Column:
    """Whether ``c`` is so high that at most ``limit`` rows have it or more."""
    grade = F.floor(16 * F.log2(c))       # at most about a thousand
    sizes = df.where(F.col(c) > 0).groupBy(grade.alias("grade")).agg(
        F.count("*").alias("n")).collect()
    least, total = None, 0
    for row in sorted(sizes, key=lambda r: -r.grade):
        total += row.n
        if total > limit:
            break
        least = row.grade
    return F.lit(False) if least is None else (F.col(c) > 0) & (grade >= least)


def word_arcs(docs: DataFrame, learnable: Column, counts: DataFrame,
              root: Root) -> tuple[DataFrame, DataFrame]:
    """Words (word, c, weight) and arcs (code, count, gain), both whole.

    ``weight`` is the log10 of a word's root arc and failure arc; every state's arcs and what it
    backs off to add up to one. ``gain`` is what a pair's arc differs from the first word's failure
    arc and the second's root arc.
    """
    kept = (docs.where(learnable).select("text")
            .mapInArrow(_pairs, "u long, w long, count long")
            .groupBy("u", "w").agg(F.sum("count").alias("count"))
            .where(F.col("count") >= MIN_PAIR))
    learned = counts.where("c > 0")
    lower = written(kept.join(learned.select(F.col("word").alias("w"),
                                             root.log10(F.col("c")).alias("root")), "w")
                    .select("u", pair_code(F.col("u"), F.col("w")).alias("code"), "count", "root"),
                    "pairs")
    states = lower.groupBy("u").agg(F.sum(F.col("count") - DISCOUNT).alias("_kept"),
                                    F.sum(F.pow(F.lit(10.0), "root")).alias("_lower"))
    free = F.greatest(1 - F.col("_kept") / F.col("c"), F.lit(1e-9))
    backoff = F.coalesce(F.log10(free / F.greatest(1 - F.col("_lower"), F.lit(1e-9))), F.lit(0.0))
    words = written(counts.join(states, counts["word"] == states["u"], "left")
                    .select("word", "c", backoff.alias("backoff"),
                            (root.log10(F.col("c")) + backoff).alias("weight")), "words")
    first = words.where("c > 0").select(
        F.col("word").alias("u"), (F.log10("c") + F.col("backoff")).alias("_less"))
    arcs = written(lower.join(first, "u").select(
        "code", "count",
        (F.log10(F.col("count") - DISCOUNT) - F.col("_less") - F.col("root")).alias("gain")), "arcs")
    return words, arcs


def bitmap_of(arcs: DataFrame) -> np.ndarray:
    """Bits at the first ``BITS`` bits of the arcs' hashes."""
    bit = F.shiftrightunsigned("code", 64 - BITS)
    found = (arcs.groupBy(F.shiftrightunsigned(bit, 6).alias("at"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(code, {64 - BITS}) & 63))"))
                  .alias("bits")).toArrow())
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def score(docs: DataFrame, learnable: Column, cache: int = CACHE) -> DataFrame:
    """doc_id, row_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null counts as empty: such a text is its end token alone. Rows are scored one by one, so
    repeated and null ids are kept. ``docs`` must give the same rows in the same order whenever it
    is read, as a table does. Without training texts every word is unseen. An empty table gives
    no rows; other columns are ignored. ``cache`` is the number of words, and of pairs, that tasks
    hold; scores do not depend on it but for the order of sums.
    """
    counts = word_counts(docs, learnable)
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"),
                       *[F.count_if(F.col("c") == k + 1).alias(f"n{k}")
                         for k in range(KATZ + 1)]).first()
    n, v = total["n"] or 0, total["v"] or 0
    root = root_of(n, v, [total[f"n{k}"] or 0 for k in range(KATZ + 1)])
    words, arcs = word_arcs(docs, learnable, counts, root)
    often, usual = most_frequent(words, "c", cache), most_frequent(arcs, "count", cache)
    top = words.where(often).select("word", "c", "weight").toArrow()
    best = arcs.where(usual).select("code", "gain").toArrow()
    held = Cache(top["word"].to_numpy().view(np.uint64), top["weight"].to_numpy(),
                 np.log10(top["c"].to_numpy() + 1.0), best["code"].to_numpy().view(np.uint64),
                 best["gain"].to_numpy(), bitmap_of(arcs.where(~usual)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.monotonically_increasing_id().alias("row_id"), "text")
    walked = written(rows.mapInArrow(
        lambda b: _traverse(b, held),
        "doc_id long, row_id long, n_tokens long, n_known long, base double, score double, "
        "rare array<long>, times array<int>, codes array<long>, code_times array<int>"), "walked")

    def apart(keys: str, times: str, name: str) -> DataFrame:
        return walked.select("row_id", F.explode(F.arrays_zip(keys, times)).alias("r")).select(
            "row_id", F.col(f"r.{keys}").alias(name), F.col(f"r.{times}").alias("times"))

    of_words = apart("rare", "times", "word").join(words.where(~often), "word").select(
        "row_id", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("base"),
        (F.col("times") * F.col("weight")).alias("score"))
    of_pairs = apart("codes", "code_times", "code").join(arcs.where(~usual), "code").select(
        "row_id", F.lit(0).alias("known"), F.lit(0.0).alias("base"),
        (F.col("times") * F.col("gain")).alias("score"))
    sums = of_words.unionByName(of_pairs).groupBy("row_id").agg(
        F.sum("known").alias("known"), F.sum("base").alias("more_base"),
        F.sum("score").alias("more"))
    norm = float(np.log10(n + v + 1))
    return (walked.drop("rare", "times", "codes", "code_times").join(sums, "row_id", "left")
            .select("doc_id", "row_id", "n_tokens",
                    (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more_base", F.lit(0.0))
                     - F.col("n_tokens") * norm).alias("base_score"),
                    (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")))


def automaton(frequent: np.ndarray, c: np.ndarray, root: np.ndarray, codes: np.ndarray,
              counts: np.ndarray, d: float = DISCOUNT) -> Automaton:
    """Arcs and backoff weights: every state's arcs and what it backs off to add up to one."""
    n = max(1, frequent.size)
    u, w = codes // n, codes % n
    p_root = 10.0 ** root
    p = (counts - d) / np.maximum(c[u], 1) if codes.size else np.zeros(0)
    kept = np.bincount(u, p, minlength=n)
    lower = np.bincount(u, p_root[w] if codes.size else None, minlength=n) if codes.size else \
        np.zeros(n)
    weight = (1 - np.minimum(kept, 1 - 1e-9)) / np.maximum(1 - lower, 1e-9)
    return Automaton(frequent, root, dict(zip(codes.tolist(), np.log10(p).tolist())),
                     np.log10(weight).tolist())


def held_out() -> Column:
    return F.coalesce(F.pmod(crc32(F.col("doc_id")), F.lit(7)) == 2, F.lit(False))
