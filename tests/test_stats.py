import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions.exact import UNIT
from assaykit.operators import bootstrap, intervals, items, pairwise, reliability
from assaykit.operators import ranking
from assaykit.operators.ranking import kth_value, rank_by_hash, take_by_hash


def test_holm_vector(spark):
    df = spark.createDataFrame([("f", 1, .01), ("f", 2, .04), ("f", 3, .03), ("g", 1, .04)],
                               "fam string, i int, p double")
    got = {(r.fam, r.i): (r.p_holm, r.significant)
           for r in pairwise.holm(df, ["fam"], "p", "i").collect()}
    assert got == {("f", 1): (.03, True), ("f", 2): (.06, False), ("f", 3): (.06, False),
                   ("g", 1): (.04, True)}


@pytest.mark.parametrize("k, n, lo, hi", [
    (213, 213, 0.025 ** (1 / 213), 1.0), (0, 10, 0.0, 1 - 0.025 ** (1 / 10)), (0, 0, 0.0, 1.0),
    # published tables: 5 of 10, 50 of 100
    (5, 10, 0.18708603, 0.81291397), (50, 100, 0.39832112, 0.60167888)])
def test_exact_interval(spark, k, n, lo, hi):
    df = spark.createDataFrame([(k, n)], "k bigint, n bigint")
    a, b = intervals.clopper_pearson(F.col("k"), F.col("n"))
    r = df.select(a.alias("lo"), b.alias("hi")).first()
    assert r.lo == pytest.approx(lo, abs=1e-7) and r.hi == pytest.approx(hi, abs=1e-7)


def test_exact_interval_covers_its_tail(spark):
    n = 5000
    df = spark.createDataFrame([(k, n) for k in (1, 37, 2500, 4999)], "k bigint, n bigint")
    a, b = intervals.clopper_pearson(F.col("k"), F.col("n"))
    for r in df.select("k", a.alias("lo"), b.alias("hi")).collect():
        def term(j, p):
            return math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                            + j * math.log(p) + (n - j) * math.log1p(-p))
        assert sum(term(j, r.hi) for j in range(r.k + 1)) == pytest.approx(0.025, abs=1e-6)
        assert sum(term(j, r.lo) for j in range(r.k, n + 1)) == pytest.approx(0.025, abs=1e-6)


def test_mcnemar(spark):
    df = spark.createDataFrame([(0, 0), (15, 0), (20, 20), (3, 9), (40, 10)],
                               "only_a bigint, only_b bigint")
    got = [(r.mcnemar_stat, r.mcnemar_p) for r in pairwise.mcnemar(df).collect()]
    assert got[0] == (0.0, 1.0)
    assert got[1][1] == pytest.approx(2 * 0.5 ** 15)
    assert got[2] == (pytest.approx(1 / 40), pytest.approx(math.erfc(math.sqrt(1 / 80))))
    assert got[3][1] == pytest.approx(2 * sum(math.comb(12, i) for i in range(4)) / 2 ** 12)
    assert got[4][1] == pytest.approx(math.erfc(math.sqrt(29 ** 2 / 50 / 2)))
    edwards = [(r.edwards_stat, r.edwards_p) for r in pairwise.mcnemar_edwards(df).collect()]
    assert edwards[0] == (0.0, 1.0) and edwards[2] == (0.0, 1.0)


REFERENCE = [[1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
             [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
             [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
             [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None]]


def alpha(spark, matrix):
    rows = [("m", u, float(v)) for row in matrix for u, v in enumerate(row) if v is not None]
    df = spark.createDataFrame(rows, "metric string, unit int, value double")
    got = reliability.krippendorff_alpha(df, ["metric"]).collect()
    return got[0].alpha if got else None


def test_alpha_vectors(spark):
    assert alpha(spark, REFERENCE) == pytest.approx(0.849, abs=0.001)
    assert alpha(spark, [[3, 3, 3], [3, 3, 3]]) is None
    assert alpha(spark, [[1, 2, 3], [1, 2, 3]]) == 1.0
    assert alpha(spark, [[1, 2, 3], [3, 2, 1]]) < 1
    assert alpha(spark, [[1, 2, 3]]) is None
    rng = np.random.default_rng(0)
    assert abs(alpha(spark, rng.integers(1, 6, (3, 400)).tolist())) < 0.06


def kappa(spark, rows, k):
    df = spark.createDataFrame([(u, c) for u, row in enumerate(rows) for c in row],
                               "unit int, category int")
    return reliability.fleiss_kappa(df, k).first().kappa


def test_kappa(spark):
    assert kappa(spark, [[0, 0, 0], [0, 0, 0]], 3) == 1.0
    assert kappa(spark, [[0], [1]], 3) is None
    assert kappa(spark, [[0, 0, 1], [1, 1, 1], [2, 0, 2]], 3) == pytest.approx(
        (5 / 9 - (9 + 16 + 4) / 81) / (1 - (9 + 16 + 4) / 81))
    with pytest.raises(Exception, match="number of raters"):
        kappa(spark, [[0, 0], [1]], 3)
    with pytest.raises(Exception, match="out of range"):
        kappa(spark, [[0, 3]], 3)


def test_item_analysis(spark):
    matrix = {"q1": [1, 1, 1, 0], "q2": [1, 0, 1, 0], "q3": [0, 0, 1, 0], "full": [1, 1, 1, 1]}
    rows = [("m", r, q, x) for q, v in matrix.items() for r, x in enumerate(v)]
    rows += [("m", 0, "partial", 1)]
    df = spark.createDataFrame(rows, "model string, run_index int, question_id string, x int")
    got = {r.question_id: r for r in items.item_analysis(df).collect()}
    assert set(got) == set(matrix)
    total = np.sum(list(matrix.values()), axis=0)
    for q, v in matrix.items():
        assert got[q].difficulty_p == np.mean(v) and got[q].n_resp == 4
        if q == "full":
            assert got[q].discrimination is None
        else:
            assert got[q].discrimination == pytest.approx(np.corrcoef(v, total - v)[0, 1])


# ---- bootstrap --------------------------------------------------------------------

def groups(spark, data, parts=4):
    rows = [(g, i, float(x)) for g, xs in data.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, i int, p double").repartition(parts)


DATA = {"few": [1.0] * 80 + [0.0] * 20, "ceiling": [1.0] * 30, "one": [0.4],
        "wide": list(np.random.default_rng(3).random(700))}


def test_kernel_follows_the_index_bootstrap(spark):
    got = {r.g: r for r in bootstrap.mean_ci(groups(spark, DATA), ["g"], "p", 8000, 5).collect()}
    assert (got["ceiling"].lo, got["ceiling"].hi) == (1.0, 1.0)
    assert got["one"].lo == pytest.approx(0.4) and got["one"].n == 1
    rng = np.random.default_rng(11)
    for g in ("few", "wide"):
        x = np.array(DATA[g])
        means = x[rng.integers(0, len(x), (8000, len(x)))].mean(axis=1)
        sd = means.std()
        for mine, brute in zip((got[g].lo, got[g].hi), np.quantile(means, [.025, .975])):
            assert abs(mine - brute) < 0.12 * sd


def test_chunked_draws_have_the_same_law(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CHUNK_VALUES", 16)   # 'wide' becomes dozens of chunks
    df = groups(spark, {"wide": DATA["wide"]})
    hist = bootstrap.value_histogram(df, ["g"], "p")
    assert bootstrap._chunks(hist, ["g"]).count() > 10
    sums = bootstrap.resampled_sums(hist, ["g"], 6000, 5, "t").collect()
    means = np.concatenate([r.sums for r in sums]) / 700 / UNIT
    x = np.array(DATA["wide"])
    assert len(means) == 6000
    assert means.mean() == pytest.approx(x.mean(), abs=4 * x.std() / math.sqrt(700 * 6000))
    assert means.std() == pytest.approx(x.std() / math.sqrt(700), rel=0.05)


def test_result_does_not_depend_on_partitioning(spark):
    runs = [sorted((r.g, r.lo, r.hi) for r in bootstrap.mean_ci(
        groups(spark, DATA, parts), ["g"], "p", 1200, 5).collect()) for parts in (1, 8, 64)]
    assert runs[0] == runs[1] == runs[2]


def test_hash_form_equals_brute_force(spark):
    import hashlib

    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()

    xs = DATA["few"]
    order = sorted(range(len(xs)), key=lambda i: (md5(str(i)), i))
    want = []
    for b in range(25):
        idx = [math.floor(int(md5(f"9|{b}|{j}")[:8], 16) / 2 ** 32 * len(xs))
               for j in range(len(xs))]
        want.append(sum(xs[order[i]] for i in idx))
    got = bootstrap.hash_bootstrap(groups(spark, {"few": xs}), ["g"], "p", "i", 25, 9).collect()
    assert [r.s / UNIT for r in sorted(got, key=lambda r: r.resample)] == want


def test_hash_form_over_buckets_and_groups(spark, monkeypatch):
    """Groups of one item to many, a null group and null values, cut into many buckets."""
    import hashlib

    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()

    monkeypatch.setattr(bootstrap, "BUCKET_ROWS", 300)
    rng = np.random.default_rng(3)
    data = {"one": 1, "three": 3, None: 70, "many": 1500, "more": 2300}
    rows = [(g, int(i), None if i % 13 == 5 else float(rng.integers(-20, 21)) / 20)
            for g, n in data.items() for i in rng.choice(10**6, n, replace=False)]
    want = {}
    for g in data:
        xs = [round(p * UNIT) for _, p in sorted((md5(str(i)), p) for h, i, p in rows
                                                 if h == g and p is not None)]
        for b in range(12):
            want[g, len(xs), b] = sum(xs[math.floor(int(md5(f"9|{b}|{j}")[:8], 16) / 2 ** 32 * len(xs))]
                                      for j in range(len(xs)))
    df = spark.createDataFrame(rows, "g string, i long, p double").repartition(5)
    drawn = bootstrap.hash_bootstrap(df, ["g"], "p", "i", 12, 9)
    assert {(r.g, r.n, r.resample): r.s for r in drawn.collect()} == {
        k: v for k, v in want.items() if k[1]}
    # items go to their buckets once; no draw is made per item
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


def paired(spark, a, b, resamples=1000):
    rows = [("x", "y", float(u), float(v)) for u, v in zip(a, b)]
    df = spark.createDataFrame(rows, "a string, b string, va double, vb double")
    return bootstrap.paired_ci(pairwise.difference_histogram(df), ["a", "b"], resamples, 3)


def test_paired_edges(spark):
    assert paired(spark, [], []).collect() == []
    r = paired(spark, [1] * 20, [0] * 20).first()
    assert 0 < r.p <= 2 / 1001 and (r.lo, r.hi) == (1.0, 1.0)
    r = paired(spark, [1, 0, 1], [1, 0, 1]).first()
    assert (r.p, r.lo, r.hi, r.n) == (1.0, 0.0, 0.0, 3)
    # thirds cancel exactly, so every resample is a tie
    assert paired(spark, [1 / 3 + 1 / 3, 1 / 3], [2 / 3, 1 / 3]).first().p == 1.0


def test_ties_at_zero_for_any_number_of_runs(spark):
    for runs in (3, 23, 97, 1009):
        a, b = [1 / runs, (runs - 2) / runs], [0, (runs - 1) / runs]
        r = paired(spark, a, b).first()
        assert r.p == 1.0 and r.lo == pytest.approx(-1 / runs) and r.hi == pytest.approx(1 / runs)
    many = spark.createDataFrame([("x", "y", 1 / 23, 0.0)] * 23 + [("x", "y", 0.0, 1.0)],
                                 "a string, b string, va double, vb double")
    assert pairwise.discordance(pairwise.difference_histogram(many)).first().diff == 0


def test_chunks_have_no_limit(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CHUNK_VALUES", 2)
    df = spark.range(6000).select(F.lit("g").alias("g"), (F.col("id") / 6000).alias("p"))
    chunks = bootstrap._chunks(bootstrap.value_histogram(df, ["g"], "p"), ["g"]).collect()
    assert len(chunks) > 1024 and max(len(c["values"]) for c in chunks) < 16
    assert sum(len(c["values"]) for c in chunks) == 6000
    totals = sum(bootstrap.chunk_totals(6000, 20, 7, c["at"], np.array(c["weights"])) for c in chunks)
    assert totals.tolist() == [6000] * 20


def test_shared_items_vanish_without_overlap(spark):
    its = spark.createDataFrame([("a", "q1", 1.0), ("b", "q2", 1.0)],
                                "model string, question_id string, p double")
    cohort = spark.createDataFrame([("a", 0), ("b", 1)], "model string, ord int")
    assert pairwise.shared_items(its, cohort).count() == 0


# ---- ranks --------------------------------------------------------------------------

def test_rank_by_hash_is_the_global_order(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id",
                                  F.md5(F.col("id").cast("string")).alias("h"))
    got = rank_by_hash(df, ["g"], "h", "id").collect()
    for g in (0, 1):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.h, r.id))
        assert [r["rank"] for r in mine] == list(range(1, 1501))
        assert {r.group_size for r in mine} == {1500}


def test_kth_value_with_ties_nulls_and_outliers(spark):
    data = {"a": [1, 2, 3, 4], "b": [1, 5, 9], "c": [7] * 9, "d": [1] * 50 + [2, 3, 10 ** 9]}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.kth, r.n) for r in kth_value(df, ["g"], "v", F.floor(F.col("n") / 2)).collect()}
    assert got == {g: (float(sorted(v)[len(v) // 2]), len(v)) for g, v in data.items()}


@pytest.mark.parametrize("few", [50_000, 3])
def test_kth_value_of_crowded_values(spark, monkeypatch, few):
    """Ranges are cut until few values are left; equal results however few that is."""
    monkeypatch.setattr(ranking, "FEW", few)
    data = {"close": [1 + i / 1e9 for i in range(400)], "wide": [(-1) ** i * 1.7 ** i for i in range(80)],
            "mixed": [5.0] * 100 + [5.0 + i / 1e12 for i in range(90)] + [-1e300, 1e300], "one": [2.5]}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0, 0.5, 0.99):
        got = {r.g: r.kth for r in kth_value(df, ["g"], "v", F.floor(F.col("n") * share)).collect()}
        assert got == {g: sorted(v)[int(len(v) * share)] for g, v in data.items()}


@pytest.mark.parametrize("few, groups", [(50_000, ["g"]), (2, ["g"]), (2, [])])
def test_take_by_hash(spark, monkeypatch, few, groups):
    """The quota of each group, exactly, with repeated rows and null groups."""
    monkeypatch.setattr(ranking, "FEW", few)
    ids = [i for i in range(900)] + [7] * 30 + [8] * 5
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 3, i, "text" * 9) for i in ids],
                               "g int, id long, text string").withColumn(
        "h", F.md5((F.col("id") % 850).cast("string")))
    for share in (0.0, 0.31, 1.0, 5.0):
        quota = F.bround(F.col("group_size") * share)
        got = take_by_hash(df, groups, "h", quota, "id").collect()
        by = {}
        for r in got:
            by.setdefault(r.g if groups else 0, []).append(r)
        assert len(got) == len(ids)
        for own in by.values():
            n = min(len(own), round(len(own) * share))
            assert sum(r.taken for r in own) == n
            order = sorted((r.h, r.id) for r in own)
            assert sorted((r.h, r.id) for r in own if r.taken) == order[:n]


def test_complete_rows_stay_where_they_are(spark):
    """Full rows meet their group's threshold by a broadcast: no sort, window or shuffle."""
    df = spark.range(2000).select("id", (F.col("id") % 4).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    plan = take_by_hash(df, ["g"], "h", F.col("group_size") / 2, "id")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert "BroadcastHashJoin" in plan
    assert not any(x in plan for x in ("Window", "Sort", "Exchange hashpartitioning", "Exchange rangepartitioning"))


# ---- Poisson weights ---------------------------------------------------------------------

def test_poisson_weights_have_the_law():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 4000)
    w = bootstrap.poisson_weights(keys, 0, 250)
    assert (bootstrap.poisson_weights(keys, 100, 50) == w[:, 100:150]).all()
    share = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    law = [math.exp(-1) / math.factorial(k) for k in range(5)]
    assert np.abs(share - law).max() < 0.002
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


def test_poisson_sums_of_many_resamples(spark):
    """Resamples in several shards, the last one shorter, and items that both groups share."""
    rng = np.random.default_rng(4)
    rows = [(g, f"q{i}", int(v) / 20) for g, n in (("a", 40), ("b", 25))
            for i, v in enumerate(rng.integers(-20, 21, n))]
    df = spark.createDataFrame(rows, "g string, q string, x double").repartition(3)
    parts = bootstrap.poisson_sums(df, ["g"], "x", "q", 1100, 7).collect()
    for g in ("a", "b"):
        own = [(q, round(x * UNIT)) for h, q, x in rows if h == g]
        keys = np.array([int(hashlib.md5(f"7|{q}".encode()).hexdigest()[:15], 16) for q, _ in own])
        w = bootstrap.poisson_weights(keys, 0, 1100)
        mine = sorted((r for r in parts if json.loads(r["_g"])["g"] == g), key=lambda r: r.shard)
        assert [len(r.sums) for r in mine] == [500, 500, 100]
        assert sum((r.sums for r in mine), []) == (np.array([v for _, v in own]) @ w).tolist()
        assert sum((r.weights for r in mine), []) == w.sum(axis=0).tolist()


def test_poisson_agrees_with_the_histogram(spark, monkeypatch):
    """Continuous values, several groups, one of them a single item."""
    rng = np.random.default_rng(2)
    rows = [("a", f"q{i}", float(x)) for i, x in enumerate(rng.beta(2, 3, 900))]
    rows += [("b", f"q{i}", float(x)) for i, x in enumerate(rng.normal(0.01, 0.2, 700).clip(-1, 1))]
    rows += [("c", "q0", 0.5), ("c", "q1", None), (None, "q2", 0.25)]
    df = spark.createDataFrame(rows, "g string, q string, x double")
    want = {r.g: r for r in bootstrap.mean_ci(df, ["g"], "x", 4000, 7).collect()}
    got = {r.g: r for r in bootstrap.poisson_ci(df, ["g"], "x", "q", 4000, 7).collect()}
    assert set(got) == set(want) == {"a", "b", "c", None}
    for g in ("a", "b"):
        width = want[g].hi - want[g].lo
        assert got[g].n == want[g].n and got[g].method == "poisson"
        assert abs(got[g].lo - want[g].lo) < 0.05 * width and abs(got[g].hi - want[g].hi) < 0.05 * width
    assert got["a"].p == pytest.approx(2 / 4001) and got["b"].p > 0.01
    assert (got["c"].lo, got["c"].hi) == (0.5, 0.5)
    # the same result however the rows lie, and however often partial sums are handed on
    monkeypatch.setattr(bootstrap, "POISSON_BYTES", 1)
    again = {r.g: r for r in bootstrap.poisson_ci(df.repartition(13), ["g"], "x", "q", 4000, 7).collect()}
    assert again == got
