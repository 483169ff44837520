"""Completeness audit of a run: what a retry could heal and what blocks completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import strip
from assaykit.operators.panel import TRIPLE
from assaykit.session import computed_once


def parse_log(lines: DataFrame, *keep: str) -> DataFrame:
    """Text lines (``value``) to ``record`` VARIANT; blank lines go, damaged ones stay null.

    Only JSON objects are records.  ``keys`` are the record's field names. Columns of ``keep``
    stay.
    """
    filled = lines.where(strip(F.col("value")) != "")
    keys = F.json_object_keys("value")
    record = F.when(keys.isNotNull(), F.try_parse_json("value"))
    return filled.select("value", *keep, computed_once(F.struct(keys.alias("keys"),
                                                         record.alias("record"))).alias("_r")
                         ).select("value", *keep, "_r.*")


def field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("record"), f"$.{name}", kind)


def _failed() -> Column:
    """An absent flag is a success; a present one must be true."""
    return F.array_contains("keys", "call_ok") & ~F.coalesce(field("call_ok", "boolean"), F.lit(False))


def scan_log(lines: DataFrame) -> DataFrame:
    """One row: failed, total, corrupt.  An empty log gives zeros."""
    return parse_log(lines).agg(
        F.count_if(F.col("record").isNotNull() & _failed()).alias("failed"),
        F.count("*").alias("total"),
        F.count_if(F.col("record").isNull()).alias("corrupt"))


def panel_counts(verdict_lines: DataFrame, *keep: str) -> DataFrame:
    """Lines per (triple, whether they count), by ``keep``: total, corrupt, failed, judges.

    A panel counts readable scores of primary verdicts only.
    """
    known = F.col("record").isNotNull()
    first = F.coalesce(field("judge_role"), F.lit("primary")) == "primary"
    scores = field("scores", "variant")
    return parse_log(verdict_lines, *keep).select(
        *keep, *[field(k).alias(k) for k in TRIPLE], (known & first).alias("counts"),
        (~known).alias("corrupt"), (known & _failed()).alias("failed"),
        (scores.isNotNull() & ~F.is_variant_null(scores)).alias("scored")).groupBy(
        *keep, *TRIPLE, "counts").agg(
        F.count("*").alias("total"), F.count_if("corrupt").alias("corrupt"),
        F.count_if("failed").alias("failed"), F.count_if("scored").alias("judges"))


def verdict_audit(verdict_lines: DataFrame, needed: int) -> DataFrame:
    """One row over a verdict log, from one reading: failed, total, corrupt, the triples
    that have a primary verdict, and those whose panel is below the quorum.
    """
    total = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
             for c in ("failed", "total", "corrupt")]
    return panel_counts(verdict_lines).agg(
        *total, F.count_if("counts").alias("judged_triples"),
        F.count_if(F.col("counts") & (F.col("judges") < needed)).alias("short"))


def quorum(verdict_lines: DataFrame, needed: int) -> DataFrame:
    """One row: triples seen, and those whose panel is below the quorum."""
    return verdict_audit(verdict_lines, needed).select("judged_triples", "short")


def _or_zero(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), c)


def audit_mc(lines: DataFrame, expected: int) -> DataFrame:
    """MC phase: nothing is tolerable, so both signals agree."""
    missing = _or_zero(F.lit(expected) - F.col("total"))
    strict = F.col("failed") + F.col("corrupt") + missing
    return scan_log(lines).select(
        strict.alias("strict_fail"), strict.alias("accept_fail"),
        F.lit(0).cast("bigint").alias("below_quorum"),
        F.lit(expected).cast("bigint").alias("expected"), F.col("total").alias("have"),
        "failed", "corrupt", missing.alias("missing"))


def audit_open(response_lines: DataFrame, verdict_lines: DataFrame, expected: int,
               n_personas: int, needed: int) -> DataFrame:
    """Open phase: failed verdicts are tolerable while every panel holds a quorum.

    A response without any verdict is counted as a panel below quorum, and damaged
    verdict lines block acceptance.  The two one-row scans are stacked and folded.
    """
    g = scan_log(response_lines).select(F.col("failed").alias("gf"), F.col("total").alias("gt"),
                                        F.col("corrupt").alias("gc"))
    j = verdict_audit(verdict_lines, needed).select(
        F.col("failed").alias("jf"), F.col("total").alias("jt"), F.col("corrupt").alias("jc"),
        "judged_triples", "short")
    both = g.unionByName(j, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns]).select(
        *open_signals(expected, n_personas))


def open_signals(expected: int, n_personas: int) -> list[Column]:
    """The open audit from its counts: ``gf, gt, gc`` failed, all and corrupt generations,
    ``jf, jt, jc`` the same of verdicts, ``judged_triples`` and ``short`` panels."""
    c = F.col
    made = _or_zero(c("gt") - c("gf"))
    gm, jm = _or_zero(F.lit(expected) - c("gt")), _or_zero(made * n_personas - c("jt"))
    below = c("short") + _or_zero(made - c("judged_triples"))
    return [
        (c("gf") + c("gc") + gm + c("jf") + c("jc") + jm).alias("strict_fail"),
        (c("gf") + c("gc") + gm + c("jc") + below).alias("accept_fail"),
        below.alias("below_quorum"), c("gf").alias("gen_failed"), c("gc").alias("gen_corrupt"),
        gm.alias("gen_missing"), c("gt").alias("gen_have"),
        F.lit(expected).cast("bigint").alias("gen_expected"), c("jf").alias("judge_failed"),
        c("jc").alias("judge_corrupt"), jm.alias("judge_missing"), c("jt").alias("judge_have"),
        (made * n_personas).alias("judge_expected")]
