"""Reviewer panels: fan-out results to keep / reject / unreviewed decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions.judging import number
from assaykit.functions.text import LETTERS, letter_at, letters_of, strip

# Flags that count against an item and the keep thresholds.
MC_BAD = ("ambiguous", "multiple_correct", "unfair", "factually_wrong")
OPEN_BAD = ("unrealistic", "rubric_heterodox", "factually_wrong")
QUORUM = 3
MIN_AGREEMENT, MIN_CLARITY, MAX_DEFENSIBLE, MAX_BAD = 0.6, 4.0, 1.5, 1
MIN_REALISTIC, MIN_FAIR = 4.0, 4.0
KAPPA_CATEGORIES = 6


def typed_reviews(raw: DataFrame, payload: str = "review") -> DataFrame:
    """Review payloads (JSON strings) as typed columns; empty objects are no review."""
    v = F.try_parse_json(payload)
    present = v.isNotNull() & (F.size(F.json_object_keys(payload)) > 0)
    flags = F.coalesce(F.try_variant_get(v, "$.flags", "array<string>"),
                       F.array().cast("array<string>"))
    body = F.struct(
        F.try_variant_get(v, "$.best_answer", "string").alias("best_answer"),
        number(v, "clarity").alias("clarity"),
        number(v, "n_defensible_options").alias("n_defensible"),
        number(v, "realistic").alias("realistic"),
        number(v, "rubric_fair").alias("rubric_fair"),
        F.filter(flags, lambda f: f.isNotNull() & ~f.isin("", "none")).alias("flags"))
    seq = ["seq"] if "seq" in raw.columns else []
    return raw.select("question_id", "persona", *seq,
                      F.coalesce("resolicited", F.lit(False)).alias("resolicited"),
                      F.when(F.coalesce(present, F.lit(False)), body).alias("review"))


def latest_reviews(typed: DataFrame) -> DataFrame:
    """One review per (item, persona); the second pass wins only when it parsed.

    Of several in one pass the one with the largest ``seq`` wins; without that column, any rule
    that does not depend on file order will do: the largest hash. An (item, persona) has a handful
    of rows, so they are put in order where they meet.
    """
    last = F.col("seq") if "seq" in typed.columns else F.xxhash64(F.to_json("review"))
    order = W.partitionBy("question_id", "persona").orderBy(
        F.col("review").isNotNull().desc(), F.desc("resolicited"), last.desc())
    return (typed.withColumn("_n", F.row_number().over(order)).where("_n = 1")
            .select("question_id", "persona", "review.*",
                    F.col("review").isNotNull().alias("parsed")))


def _bad(flags: tuple[str, ...]) -> Column:
    return F.size(F.filter("flags", lambda f: f.isin(*flags)))


def _status(n: Column, keep: Column) -> Column:
    return (F.when(n < QUORUM, "unreviewed").when(keep, "kept").otherwise("rejected"))


def review_mc(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Blind-review roll-up and decision per MC item; items without reviews stay in."""
    key = items.select("question_id", F.size("choices").alias("n_choices"),
                       letter_at(F.col("answer_index")).alias("key_letter"))
    seen = latest.where("parsed").join(key, "question_id")
    pick = F.substring(F.upper(strip(F.col("best_answer"))), 1, 1)
    letter = F.when((pick != "") & F.contains(letters_of(F.col("n_choices")), pick), pick)
    panel = (seen.withColumn("letter", letter).groupBy("question_id").agg(
        F.count("letter").alias("n_reviewers"),
        F.count_if(F.col("letter") == F.col("key_letter")).alias("n_agree"),
        F.avg("clarity").alias("clarity"), F.avg("n_defensible").alias("defensible"),
        F.sum(_bad(MC_BAD)).alias("bad")))
    out = items.join(panel, "question_id", "left")
    agree = F.coalesce(F.try_divide("n_agree", "n_reviewers"), F.lit(0.0))
    clarity = F.coalesce("clarity", F.lit(0.0))
    defensible = F.coalesce(F.when(F.col("defensible") != 0, F.col("defensible")), F.lit(1.0))
    bad = F.coalesce("bad", F.lit(0).cast("bigint"))
    n = F.coalesce("n_reviewers", F.lit(0).cast("bigint"))
    keep = ((agree >= MIN_AGREEMENT) & (clarity >= MIN_CLARITY)
            & (defensible <= MAX_DEFENSIBLE) & (bad <= MAX_BAD))
    return out.select(
        *items.columns, agree.alias("key_agreement"), clarity.alias("mean_clarity"),
        defensible.alias("mean_n_defensible"), n.alias("n_reviewers"), bad.alias("bad_flags"),
        _status(n, keep).alias("status"))


def review_open(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Realism and rubric roll-up per open item; a review without a realism score is none."""
    panel = (latest.where("parsed AND realistic IS NOT NULL").groupBy("question_id").agg(
        F.count("*").alias("n_reviewers"), F.avg("realistic").alias("realistic"),
        F.avg("rubric_fair").alias("fair"), F.avg("clarity").alias("clarity"),
        F.sum(_bad(OPEN_BAD)).alias("bad")))
    out = items.join(panel, "question_id", "left")
    zero = F.lit(0.0)
    realistic, fair = F.coalesce("realistic", zero), F.coalesce("fair", zero)
    clarity, bad = F.coalesce("clarity", zero), F.coalesce("bad", F.lit(0).cast("bigint"))
    n = F.coalesce("n_reviewers", F.lit(0).cast("bigint"))
    keep = ((realistic >= MIN_REALISTIC) & (fair >= MIN_FAIR) & (clarity >= MIN_CLARITY)
            & (bad <= MAX_BAD))
    return out.select(
        *items.columns, realistic.alias("mean_realistic"), fair.alias("mean_rubric_fair"),
        clarity.alias("mean_clarity"), n.alias("n_reviewers"), bad.alias("bad_flags"),
        _status(n, keep).alias("status"))


def answer_ratings(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Valid reviewer answers as (unit, category) rows."""
    n = items.select("question_id", F.size("choices").alias("n_choices"))
    pick = F.substring(F.upper(strip(F.col("best_answer"))), 1, 1)
    return (latest.where("parsed").join(n, "question_id")
            .where((pick != "") & F.contains(letters_of(F.col("n_choices")), pick))
            .select(F.col("question_id").alias("unit"),
                    (F.instr(F.lit(LETTERS), pick) - 1).alias("category")))


def modal_panel(ratings: DataFrame) -> DataFrame:
    """Ratings of the units whose panel has the most common size (ties: the smaller)."""
    sizes = ratings.groupBy("unit").agg(F.count("*").alias("raters"))
    mode = (sizes.groupBy("raters").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "raters").limit(1).select("raters"))
    units = sizes.join(mode, "raters").select("unit")
    return ratings.join(units, "unit", "left_semi")


def published(reviewed: DataFrame) -> DataFrame:
    """Kept items without their internal review columns."""
    internal = ["key_agreement", "mean_clarity", "mean_n_defensible", "mean_realistic",
                "mean_rubric_fair", "n_reviewers", "bad_flags", "status"]
    return reviewed.where(F.col("status") == "kept").drop(*internal)


def validation_report(reviewed: DataFrame, split: DataFrame) -> DataFrame:
    """Counts per format.  ``reviewed``: format, status; ``split``: format, holdout."""
    status = reviewed.groupBy("format").agg(
        F.count("*").alias("candidates"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("kept", "rejected", "unreviewed")])
    sides = split.groupBy("format").agg(F.count_if(~F.col("holdout")).alias("public"),
                                        F.count_if("holdout").alias("holdout"))
    return status.join(sides, "format", "left").na.fill(0, ["public", "holdout"])


def drop_reasons(reviewed: DataFrame, *order: str, limit: int | None = None) -> DataFrame:
    """Dropped items with their review summary; a ``limit`` gives the first in ``order``."""
    dropped = reviewed.where(F.col("status") != "kept")
    return dropped if limit is None else dropped.orderBy(*order).limit(limit)


def unreviewed_ids(reviewed: DataFrame) -> DataFrame:
    """Items whose panel never reached a quorum, as rows."""
    return reviewed.where(F.col("status") == "unreviewed").select("question_id")
