"""Plans that must keep their shape."""

import pytest

import __spark_entry__ as entry_point
from assaykit.operators import items, latest
from assaykit.plans import fixtures, mc, open as open_plans
from pyspark.sql import functions as F

QUERIES = entry_point.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("name", [
    "E7_last_record_wins", "D6_panel_scores", "D7_open_overall", "F8_judge_agreement",
    "F7_krippendorff_alpha", "C7_latest_reviews", "E2_first_per_stem", "D1_counts_by_cell",
    "X2_crosscheck_agreement", "D2_item_means", "D3_mc_overall"])
def test_no_sort_aggregate(spark, sf_dir, name):
    assert "SortAggregate" not in plan_of(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["E2_first_per_stem", "E3_stratified_holdout"])
def test_complete_rows_are_not_sorted(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_grid_is_never_spelled_out(spark, sf_dir):
    plan = QUERIES["C12_missing_work"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "LeftAnti" not in plan


def test_sequences_sort_like_their_parts(spark):
    rows = [(a, b, c) for a in (0, 1, 7) for b in (0, 3) for c in (0, 5, 1023)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    seq = latest.packed((F.col("a"), 3), (F.col("b"), 2), (F.col("c"), 10))
    assert [tuple(r)[:3] for r in df.withColumn("s", seq).orderBy("s").collect()] == sorted(rows)
    for bad in ([(8, 0, 0)], [(0, -1, 0)]):
        with pytest.raises(Exception, match="exceeds"):
            spark.createDataFrame(bad, "a int, b int, c int").select(seq).collect()
    with pytest.raises(ValueError):
        latest.packed((F.col("a"), 40), (F.col("b"), 30))


def test_last_and_first_rows(spark):
    rows = [("k", 3, "x", [1]), ("k", 9, None, []), ("k", 5, "z", None), (None, 1, "n", [2]), ("j", 2, "y", [3])]
    df = spark.createDataFrame(rows, "k string, seq long, t string, a array<int>")
    last = {(r.k, r.seq, r.t) for r in latest.last_rows(df, F.col("k"), "seq").collect()}
    assert last == {("k", 9, None), (None, 1, "n"), ("j", 2, "y")}
    first = {(r.k, r.seq, r.t) for r in latest.first_rows(df, F.col("k"), "seq").collect()}
    assert first == {("k", 3, "x"), (None, 1, "n"), ("j", 2, "y")}
    values = {r.k: r.v for r in latest.last_values(
        df.withColumn("v", F.when(F.col("seq") != 9, F.col("seq"))), ["k"], "seq").collect()}
    assert values == {"k": None, None: 1, "j": 2}


def test_last_outcome_with_keys_of_large_tables(spark):
    # 360 times the tables of sf0.1: 7.2 million parts, 360,000 suppliers, 54 million orders
    rows = [(order, line, 7_199_999, supplier) for order in (3, 53_999_999) for line in (1, 7)
            for supplier in (0, 16_384, 359_999)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, question_id long, l_suppkey long")
    seq = df.withColumn("seq", mc.sequence())
    assert [tuple(r)[:4] for r in seq.orderBy("seq").collect()] == sorted(rows)
    last = items.last_outcome(seq.withColumn("model", F.lit("m")).withColumn("run_index", F.lit(0)).withColumn(
        "correct", F.col("l_suppkey") == 359_999), "question_id", "seq").collect()
    assert [(r.question_id, r.x) for r in last] == [(7_199_999, 1)]


def test_holm_corrects_the_whole_bootstrap_family(spark, sf_dir):
    family = QUERIES["F2_paired_difference_hash"](spark, sf_dir).collect()
    tested = {(r.a, r.b): r.p_bootstrap for r in QUERIES["E1_holm"](spark, sf_dir).collect()}
    assert tested.keys() == {(r.a, r.b) for r in family}
    assert all(abs(tested[r.a, r.b] - r.p) < 1e-5 for r in family)


def test_holm_family_has_the_resamples_it_needs(spark, sf_dir):
    family = mc.hash_pairs(spark, sf_dir, mc.PAIR_RESAMPLES).collect()
    tested = {(r.a, r.b): r for r in QUERIES["E1_holm"](spark, sf_dir).collect()}
    assert tested.keys() == {(r.a, r.b) for r in family}
    assert all(abs(tested[r.a, r.b].p_bootstrap - r.p) < 1e-5 for r in family)
    assert 0 < sum(r.significant for r in tested.values()) < len(family)


def test_clear_differences_survive_holm_in_the_open_family(spark, sf_dir, monkeypatch):
    """Every model is ahead of the next on every item: all pairs are significant."""
    models = [r.model for r in mc.cohort(spark, sf_dir).orderBy("ord").collect()]
    rows = [(m, q, 90.0 - 3 * i + q % 2) for i, m in enumerate(models) for q in range(40)]
    scores = spark.createDataFrame(rows, "model string, question_id long, composite_100 double")
    monkeypatch.setattr(open_plans, "scores", lambda *_: scores)
    got = {r.family: r for r in QUERIES["D18_significance_counts"](spark, sf_dir).collect()}["open"]
    pairs = len(models) * (len(models) - 1) // 2
    assert (got.n_pairs, got.n_nominal, got.n_significant) == (pairs, pairs, pairs)


@pytest.mark.parametrize("name", ["judge_base", "judge_text"])
def test_verdicts_are_dealt_by_their_number(spark, sf_dir, monkeypatch, name):
    orders = fixtures.table(spark, sf_dir, "orders").count()
    monkeypatch.setattr(fixtures, "VERDICT_ORDERS", -(-orders // 64))
    verdicts = fixtures.fixture(spark, sf_dir, name)
    assert verdicts.rdd.getNumPartitions() >= 60
    monkeypatch.setattr(fixtures, "VERDICT_ORDERS", 50_000)
    assert verdicts.count() == fixtures.fixture(spark, sf_dir, name).count()
