"""Filter interaction audit (operator 12).

Every document passes or fails each of five filters, so a part of the corpus is summed up by a
2x2x2x2x2 table of counts. One row per (part, pattern of failures) leaves Spark; per part the
counts are reshaped to that tensor, and every figure of every filter order is one ``einsum``
that selects pass, fail or all along each axis.

Filters: A under ``MIN_WORDS`` words; B few distinct words; C many capitals; D a symbol of
``SYMBOLS``; E the same text as a document with a smaller id. Words are maximal runs without
white space. E needs the smallest id of each text table-wide: rows are first summed by
(id, text digest), then by digest with the smallest id's row kept beside the sums, so a text
that a third of all rows share is combined before it is shuffled.

Null text counts as empty, a null part as the empty string. A null id is neither smaller than
any other nor has a smaller one, and has no labels. Repeated rows with one id count each; equal
texts of one id do not fail E. Of repeated labels, one with the value suffices. Texts are told
apart by SHA-256 and length. No documents give no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10    # words, percent, percent
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n", "good", "toxic")
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])

AUDIT = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
    T.StructField("step", T.IntegerType()),
    *[T.StructField(n, T.LongType()) for n in ("kept", "removed", "redundant", "unique_fails",
                                               "good_lost", "toxic_lost", "shapley")]])


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 16, B 8, C 4, D 2."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: _bits(text, F.size(w), F.size(F.array_distinct(w))))[0]


def _bits(text: Column, words: Column, distinct: Column) -> Column:
    chars = F.length(text)
    capitals = chars - F.length(F.translate(text, CAPITALS, ""))
    plain = F.length(F.translate(text, SYMBOLS, ""))
    conditions = (words < MIN_WORDS, distinct * 100 < words * MIN_DISTINCT,
                  capitals * 100 > chars * MAX_CAPITALS, plain < chars)
    return sum(F.when(c, 1 << 4 - k).otherwise(0) for k, c in enumerate(conditions))


def patterns(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by failed filters, 32 rows a part at most."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.coalesce(part, F.lit("")).alias("part"),
        text_failures(text).alias("mask"),
        F.concat(F.unhex(F.sha2(text, 256)), F.encode(F.length(text).cast("string"), "utf-8"))
        .alias("digest"))
    ids = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    known = F.col("doc_id").isNotNull()   # null ids would all meet in one task of the join
    marked = (ids.where(known).join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
              .unionByName(ids.where(~known), allowMissingColumns=True))
    counts = [F.col("n"), *[F.col("n") * F.coalesce(m, F.lit(0)) for m in MEASURES[1:]]]
    marked = marked.select("doc_id", "part", "mask", "digest",
                           *[c.alias(m) for c, m in zip(counts, MEASURES, strict=True)])
    texts = marked.groupBy("digest", "part", "mask").agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        F.min(F.when(known, F.struct("doc_id", *MEASURES))).alias("first"),
        *[F.sum(F.when(~known, F.col(m)).otherwise(0)).alias(f"{m}_0") for m in MEASURES])
    # a text's rows are few by now, one per part
    whole = texts.groupBy("digest", "mask").agg(
        F.min("first.doc_id").alias("least"),
        F.collect_list(F.struct("part", "first", *MEASURES, *[f"{m}_0" for m in MEASURES])).alias("parts"))
    own = whole.select("mask", "least", F.explode("parts").alias("p")).select("mask", "least", "p.*")
    is_first = F.col("first.doc_id") == F.col("least")
    stay = {m: F.col(f"{m}_0") + F.when(is_first, F.col(f"first.{m}")).otherwise(0) for m in MEASURES}
    both = own.select("part", F.explode(F.array(
        F.struct("mask", *[stay[m].alias(m) for m in MEASURES]),
        F.struct((F.col("mask") + 1).alias("mask"),
                 *[(F.col(m) - stay[m]).alias(m) for m in MEASURES]))).alias("c")).select("part", "c.*")
    return both.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def contract(counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from its counts by pattern."""
    tensor = np.zeros((len(MEASURES), 32), np.int64)
    tensor[:, counts["mask"].to_numpy()] = counts[list(MEASURES)].to_numpy().T
    tensor = tensor.reshape(len(MEASURES), 2, 2, 2, 2, 2)

    @lru_cache(None)
    def selected(passing: frozenset, failing: str) -> np.ndarray:
        chosen = [PASS if f in passing else FAIL if f in failing else ALL for f in FILTERS]
        return np.einsum("mabcde,a,b,c,d,e->m", tensor, *chosen)

    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        for at, f in enumerate(order):
            before = frozenset(order[:at])
            removed, good, toxic = selected(before, f).tolist()
            failing, unique = selected(frozenset(), f)[0], selected(frozenset(FILTERS) - {f}, f)[0]
            shapley[f] += removed
            rows.append(("".join(order), at + 1, int(selected(before | {f}, "")[0]), removed,
                         int(failing) - removed, int(unique), good, toxic, f))
    return pd.DataFrame([(counts["part"].iloc[0], *r[:-1], shapley[r[-1]]) for r in rows],
                        columns=AUDIT.names)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What every filter removes at every step of every order, by part.

    ``docs`` holds doc_id, text and ``part``; ``labels`` doc_id, quality, toxic. Other columns
    are not read.
    """
    return patterns(docs, labels, part).groupBy("part").applyInPandas(contract, AUDIT)
