import re

import pytest
from pyspark.sql import functions as F

from assaykit.functions import calls
from assaykit.operators import leaderboard, panel, scoring
from assaykit.plans import analysis

REC = ("model string, question_id string, run_index int, correct boolean, call_ok boolean,"
       "model_served string, served_all string, cost_usd double, parse_ok boolean,"
       "dimension string, difficulty string, axis string, seq int")


def records(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"call_ok": True, "served": r[0], "served_all": None, "cost": 0.01, "parse_ok": True}
        d.update(r[4] if len(r) > 4 else {})
        full.append((r[0], r[1], r[2], r[3], d["call_ok"], d["served"], d["served_all"], d["cost"],
                     d["parse_ok"], "dim", "basic", "axis", i))
    return spark.createDataFrame(full, REC)


@pytest.fixture(scope="module")
def cohort(spark):
    return spark.createDataFrame([("a", "t", "A", 1.7, 0), ("b", "t", "B", None, 1)],
                                 "model string, tier string, label string, generation double, ord int")


def analyse(spark, cohort, rows):
    return analysis.analyze_mc(records(spark, rows), cohort, ["seq"], resamples=400, cache=False)


def test_failures_shrink_n_not_accuracy(spark, cohort):
    rows = [("a", f"q{q}", r, True) for q in range(4) for r in range(2)]
    rows += [("a", "q0", 2, False, {"call_ok": False})]
    rows += [("b", f"q{q}", 0, q < 2) for q in range(4)] + [("stray", "q0", 0, True)]
    out = analyse(spark, cohort, rows)
    got = {r.model: r for r in out["mc_overall"].collect()}
    assert got["a"].mean == 1.0 and got["a"].n_call_failed == 1 and got["b"].mean == 0.5
    assert got["a"].cp_hi == 1.0 and got["a"].cp_lo < 1.0 and got["a"].lo == got["a"].hi == 1.0
    assert got["a"].generation == 1.7 and got["b"].generation is None
    assert [(r.model, r.n_dropped) for r in out["mc_outside_cohort"].collect()] == [("stray", 1)]


def test_breakdowns_take_the_last_metadata(spark, cohort):
    rows = [("a", f"q{q}", 0, q < 3) for q in range(4)]
    got = analyse(spark, cohort, rows)["mc_by"].collect()
    assert {(r.breakdown, r.level, r["mean"], r.n) for r in got} == {
        ("dimension", "dim", 0.75, 4), ("difficulty", "basic", 0.75, 4), ("axis", "axis", 0.75, 4)}


def test_artifact_and_genuine_fallback(spark, cohort):
    rows = [("a", f"q{q}", 0, True) for q in range(6)]
    rows += [("a", "q6", 0, True, {"served": "b", "cost": 0.0102}),
             ("a", "q7", 0, True, {"served": "b", "cost": 0.002})]
    got = analyse(spark, cohort, rows)["mc_overall"].first()
    assert (got.served_mismatch_artifact, got.served_mismatch_genuine, got.n) == (1, 1, 7)


def test_served_all_names_the_model_and_no_baseline_means_genuine(spark):
    rows = [("a", "q0", 0, True), ("a", "q1", 0, True, {"served": "b", "cost": 0.0,
                                                        "served_all": "b,a-20250101"})]
    rows += [("c", "q0", 0, True, {"cost": None}), ("c", "q1", 0, True, {"served": "b"})]
    rows += [("d", "q0", 0, True, {"served": "b"})]
    got = {(r.model, r.question_id): r.call_class
           for r in scoring.classify_served(records(spark, rows)).collect()}
    assert got["a", "q1"] == "artifact" and got["c", "q0"] == "clean"
    assert got["c", "q1"] == "genuine" and got["d", "q0"] == "genuine"


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_log_is_shuffled_by_model_and_item_only(spark, adaptive):
    """With a model that holds 90 % of the log: one exchange above it, of partial sums."""
    rows = [("a" if i % 10 else f"m{i % 7}", f"q{i % 300}", i % 3, i % 2 == 0,
             {"served": "b"} if i % 11 == 0 else {}) for i in range(3000)]
    log = records(spark, rows)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        plan = scoring.item_table(scoring.classify_served(log))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    plan = plan.split("== Initial Plan ==")[-1]
    exchanges = re.findall(r"Exchange (\w+)\(([^#]*)#\d+, ([^#]*)#", plan)
    assert exchanges == [("hashpartitioning", "model", "question_id")] and plan.count(" Exchange ") == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "partial_count" in plan


def test_many_models_meet_mismatches_only(spark, monkeypatch):
    """Beyond the bound of the broadcast the result is the same, and clean records are not joined."""
    rows = [("a", f"q{i}", 0, True, {"served": "b", "cost": c} if i % 3 else {"cost": 0.01})
            for i, c in enumerate([0.001, 0.009, 0.004, 0.02] * 20)]
    log = records(spark, rows)
    def classes():
        return sorted((r.question_id, r.call_class) for r in scoring.classify_served(log).collect())
    want = classes()
    monkeypatch.setattr(scoring, "BROADCAST_MODELS", 0)
    assert classes() == want and {c for _, c in want} == {"clean", "artifact", "genuine"}


def test_pairs_are_adjusted(spark, cohort):
    rows = [("a", f"q{q}", 0, True) for q in range(10)]
    rows += [("b", f"q{q}", 0, q % 2 == 0) for q in range(10)]
    pair = analyse(spark, cohort, rows)["mc_pairwise"].first()
    assert (pair.a, pair.b, pair.diff, pair.n_items) == ("a", "b", 0.5, 10)
    assert pair.p_holm >= pair.p_bootstrap and pair.significant == (pair.p_holm < 0.05)
    assert pair.mcnemar_p == pytest.approx(2 / 2 ** 5)


def test_repeated_cells_all_count_in_the_mean(spark):
    rows = [("a", "q", 0, True), ("a", "q", 0, False), ("a", "q", 1, False)]
    got = scoring.per_item(records(spark, rows)).first()
    assert (got.runs, got.hits, got.p) == (3, 1, pytest.approx(1 / 3))


def test_open_unit_is_the_item(spark, cohort):
    rows = [("a", q, r, "life", base) for q, base in (("q1", 40.0), ("q2", 80.0)) for r in range(3)]
    rows += [("a", "q3", 0, "life", None)]
    df = spark.createDataFrame(rows, "model string, question_id string, run_index int,"
                               "dimension string, composite_100 double").withColumns({
        "must_include_coverage": F.lit(0.8), "mean_should_not_violations": F.lit(0.1),
        "dim_means": F.create_map(F.lit("voice"), F.lit(3.0))})
    got = analysis.open_board(df, cohort, 200).first()
    assert (got.n, got.mean, got.n_unscored_records) == (2, 60.0, 1)
    by = analysis.open_groups(df, 200).first()
    assert (by.n, by.mean) == (2, 60.0) and by.lo >= 40.0 and by.hi <= 80.0
    dims = panel.judge_dimension_means(df).first()
    assert (dims.judge_dimension, dims["mean"], dims.weakest) == ("voice", 3.0, True)


@pytest.mark.parametrize("asked, served, ok", [
    ("m-4-8", "m-4-8", True), ("m-4-5", "m-4-5-20251001", True), ("m-4-5-20251001", "m-4-5", True),
    ("m-4-8", "m-4-8-fast", False), ("m-4-8-fast", "m-4-8", False), ("m-4", "m-4-6", False),
    ("m", None, True), ("m", "", True), ("m", "m-2025100", False), ("m", "m-20251001x", False)])
def test_served_match(spark, asked, served, ok):
    df = spark.createDataFrame([(asked, served)], "a string, s string")
    assert df.select(calls.served_ok(F.col("a"), F.col("s"))).first()[0] is ok


def test_rank_treats_a_missing_mean_as_zero(spark):
    df = spark.createDataFrame([("x", None, 0), ("y", 0.5, 1), ("z", 0.0, 2)],
                               "model string, mean double, ord int")
    got = {r.model: r["rank"] for r in leaderboard.ranked(df).collect()}
    assert got == {"y": 1, "x": 2, "z": 3}
