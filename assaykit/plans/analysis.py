"""The two analyses of a run, table by table.

Results share the per-item table, the only input of every interval.  Interval tables start
from a checkpointed histogram (one job each when they are built); the rest is lazy.  With ``cache=True`` that table is persisted; for very large runs write it
with ``sources.tables`` and pass it back instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.exact import exact_mean
from assaykit.operators import (bootstrap, cohort as cohorts, intervals, items as item_stats,
                                leaderboard, pairwise, panel, reliability, scoring)
from assaykit.session import cut_lineage

RESAMPLES = 100_000   # fixed value: resamples of the published run
SEED = 19470417       # fixed value: its seed
CI = 0.95


def mc_board(table: DataFrame, cohort: DataFrame, resamples: int = RESAMPLES,
             seed: int = SEED, ci: float = CI) -> DataFrame:
    """Ranked choice leaderboard with bootstrap and exact intervals, from an item table."""
    board = leaderboard.with_cohort(leaderboard.mc_overall(table), cohort)
    boot = bootstrap.mean_ci(table, ["model"], "p", resamples, seed, "mc-overall", ci)
    lo, hi = intervals.clopper_pearson(F.col("majority_correct"), F.col("n"), ci)
    return leaderboard.ranked(board.join(boot.drop("n"), "model", "left")).select(
        "rank", "model", "label", "tier", "generation", "mean", "lo", "hi",
        F.bround(lo, 4).alias("cp_lo"), F.bround(hi, 4).alias("cp_hi"),
        F.bround("parse_fail_rate", 4).alias("parse_fail_rate"),
        F.bround("mean_within_item_sd", 4).alias("mean_within_item_sd"), "n", "sem",
        "served_mismatch_artifact", "served_mismatch_genuine", "n_call_failed", "n_calls")


def mc_groups(items: DataFrame, bank: DataFrame, resamples: int = RESAMPLES, seed: int = SEED,
              ci: float = CI) -> DataFrame:
    """Means by dimension, difficulty and axis with their bootstrap intervals."""
    keys = ["model", "breakdown", "level"]
    known = items.join(bank.select("question_id", *leaderboard.BREAKDOWNS), "question_id")
    long = known.select("model", "p", F.inline(F.array(*[
        F.struct(F.lit(c).alias("breakdown"), F.col(c).alias("level"))
        for c in leaderboard.BREAKDOWNS])))
    means = long.groupBy(*keys).agg(exact_mean(F.col("p")).alias("mean"),
                                    leaderboard.sem(F.col("p")).alias("sem"))
    boot = bootstrap.mean_ci(long, keys, "p", resamples, seed, "mc-group", ci)
    return means.join(boot, keys)


def pair_table(items: DataFrame, cohort: DataFrame, digits: int, resamples: int = RESAMPLES,
               seed: int = SEED, ci: float = CI, label: str = "mc-pair",
               with_mcnemar: bool = True) -> DataFrame:
    """All model pairs: difference, interval, bootstrap p, Holm verdict, McNemar.

    One job reduces the responses to a checkpointed histogram per pair; everything else
    works on that.
    """
    histogram = cut_lineage(
        pairwise.difference_histogram(pairwise.shared_items(items, cohort)))
    boot = bootstrap.paired_ci(histogram, ["a", "b"], resamples, seed, label, ci)
    facts = pairwise.discordance(histogram)
    if with_mcnemar:
        facts = pairwise.mcnemar(facts)
    both = facts.join(boot.drop("n"), ["a", "b"]).withColumn("p_bootstrap", F.bround("p", 5))
    tested = pairwise.resolution_ok(pairwise.holm(both, [], "p_bootstrap", "a", "b"), [],
                                    resamples)
    return tested.select(
        "a", "b", "n_items", *[F.bround(c, digits).alias(c) for c in ("diff", "lo", "hi")],
        "p_bootstrap", "p_holm", "significant", "floor_ok",
        *([F.bround("mcnemar_p", 5).alias("mcnemar_p")] if with_mcnemar else []))


def _sequence(order: list[str] | str) -> str:
    """The one BIGINT column that puts a log in order (``latest.packed`` makes one of several)."""
    if isinstance(order, str):
        return order
    if len(order) != 1:
        raise ValueError("a log needs one sequence column; see operators.latest.packed")
    return order[0]


def analyze_mc(responses: DataFrame, cohort: DataFrame, order: list[str] | str,
               bank: DataFrame | None = None, resamples: int = RESAMPLES, seed: int = SEED,
               ci: float = CI, cost: str = "cost_usd", cache: bool = True
               ) -> dict[str, DataFrame]:
    """Choice results.  ``order`` is the record sequence that decides repeated cells;
    without a ``bank`` the item metadata is taken from the records."""
    known = cohorts.in_cohort(responses, cohort)
    classified = scoring.classify_served(known, cost)
    table = scoring.item_table(classified)
    if cache:
        table = table.persist()
    items = scoring.scored_items(table)
    meta = bank if bank is not None else scoring.item_meta(known, _sequence(order))
    outcomes = item_stats.last_outcome(scoring.scoreable(classified), "question_id",
                                       _sequence(order))
    analysis = item_stats.item_analysis(outcomes.persist() if cache else outcomes)
    return {
        "mc_per_item": items,
        "mc_overall": mc_board(table, cohort, resamples, seed, ci),
        "mc_by": mc_groups(items, meta, resamples, seed, ci),
        "mc_pairwise": pair_table(items, cohort, 4, resamples, seed, ci),
        "mc_items": analysis,
        "mc_item_summary": item_stats.item_summary(analysis),
        "mc_outside_cohort": cohorts.outside_cohort(responses, cohort),
    }


def open_board(scores: DataFrame, cohort: DataFrame, resamples: int = RESAMPLES,
               seed: int = SEED, ci: float = CI) -> DataFrame:
    """Ranked open leaderboard."""
    board = leaderboard.with_cohort(panel.open_overall(scores), cohort)
    boot = bootstrap.mean_ci(panel.open_items(scores), ["model"], "p", resamples, seed,
                             "open-overall", ci)
    return leaderboard.ranked(board.join(boot.drop("n"), "model", "left")).select(
        "rank", "model", "label", "tier", "generation", "mean", "lo", "hi", "n", "sem",
        "n_unscored_records",
        F.bround("mean_must_include_coverage", 4).alias("mean_must_include_coverage"),
        F.bround("mean_should_not_violations", 4).alias("mean_should_not_violations"))


def open_groups(scores: DataFrame, resamples: int = RESAMPLES, seed: int = SEED,
                ci: float = CI) -> DataFrame:
    """Open means by dimension with intervals over item means."""
    keys = ["model", "dimension"]
    units = (scores.where(F.col("composite_100").isNotNull())
             .groupBy(*keys, "question_id").agg(exact_mean(F.col("composite_100"), panel.FULL).alias("p")))
    boot = bootstrap.mean_ci(units, keys, "p", resamples, seed, "open-dim", ci)
    return panel.open_by_dimension(scores).join(boot.drop("n"), keys)


def analyze_open(scores: DataFrame, verdicts: DataFrame, cohort: DataFrame, dims: list[str],
                 order: list[str] | str, resamples: int = RESAMPLES, seed: int = SEED,
                 ci: float = CI) -> dict[str, DataFrame]:
    """Open results.  ``verdicts`` carry ``scores`` payloads and the columns of ``order``."""
    known = cohorts.in_cohort(scores, cohort)
    complete = panel.last_complete(verdicts, dims, _sequence(order))
    return {
        "open_overall": open_board(known, cohort, resamples, seed, ci),
        "open_by_dim": open_groups(known, resamples, seed, ci),
        "open_judge_dims": panel.judge_dimension_means(known),
        "open_pairwise": pair_table(panel.open_items(known), cohort, 3, resamples, seed, ci,
                                    "open-pair", with_mcnemar=False),
        "judge_irr": reliability.judge_agreement_summary(complete, dims),
        "judge_irr_by_metric": reliability.judge_agreement(complete, dims),
    }


SECTIONS = ("mc_overall", "mc_by", "mc_pairwise", "mc_items", "open_overall", "open_by_dim",
            "open_judge_dims", "open_pairwise", "judge_irr")


def summary(cells: DataFrame, bank: DataFrame, panels: DataFrame, ratings: DataFrame,
            cohort: DataFrame, dims: list[str], open_cohort: DataFrame | None = None,
            resamples: int = RESAMPLES, pair_resamples: int | None = None, seed: int = SEED,
            ci: float = CI) -> dict[str, DataFrame]:
    """All sections of a run's results, from tables that hold each evaluation once: ``cells``
    (``scoring.cell_table``), ``panels`` (panel scores) and ``ratings`` (``panel.last_complete``).

    Pass stored tables: every section reads one of them, and no section reads a log.
    """
    table = scoring.cell_items(cells)
    items, pairs = scoring.scored_items(table), pair_resamples or resamples
    open_models = cohort if open_cohort is None else open_cohort
    outcomes = cells.where(F.col("x").isNotNull()).select("model", "run_index", "question_id", "x")
    return {
        "mc_overall": mc_board(table, cohort, resamples, seed, ci),
        "mc_by": mc_groups(items, bank, resamples, seed, ci),
        "mc_pairwise": pair_table(items, cohort, 4, pairs, seed, ci),
        "mc_items": item_stats.item_analysis(outcomes),
        "open_overall": open_board(panels, open_models, resamples, seed, ci),
        "open_by_dim": open_groups(panels, resamples, seed, ci),
        "open_judge_dims": panel.judge_dimension_means(panels),
        "open_pairwise": pair_table(panel.open_items(panels), open_models, 3, pairs, seed, ci,
                                    "open-pair", with_mcnemar=False),
        "judge_irr": reliability.judge_agreement_summary(ratings, dims)}
