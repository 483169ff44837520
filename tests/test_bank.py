import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaykit.operators import bank, reviews, validate

TYPES = ["correct", "near_miss", "folk_trap", "overreach"]
ITEM = ("pack string, format string, axis string, dimension string, difficulty string,"
        "question string, choices array<string>, answer_index int,"
        "distractor_types array<string>, source string, question_id string")


def mc(**over):
    d = {"pack": "p1", "format": "mc", "axis": "facts", "dimension": "history",
         "difficulty": "basic", "question": "Which book opens the series?",
         "choices": ["One", "Two", "Three", "Four"], "answer_index": 0,
         "distractor_types": ["correct", "near_miss", "near_miss", "folk_trap"],
         "source": "Book 1", "question_id": "q"}
    return {**d, **over}


def frame(spark, items):
    names = [c.split()[0] for c in ITEM.split(",")]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in items], ITEM)


@pytest.fixture(scope="module")
def vocab(spark):
    taxonomy = spark.createDataFrame(
        [("p1", "history", "facts", "mc"), ("p1", "culture", "life", "mc"),
         ("p1", "culture", "life", "open"), ("p2", "history", "other", "mc")],
        "pack string, dimension string, axis string, format string")
    types = spark.createDataFrame([(p, t) for p in ("p1", "p2") for t in TYPES],
                                  "pack string, type string")
    return taxonomy, types


CASES = [
    (mc(), None), (mc(answer_index=9), "range answer_index 9"), (mc(answer_index=None), "range answer_index"),
    (mc(choices=["a", "A ", "b", "c"]), "repeat choices"), (mc(choices=["a", " ", "b", "c"]), "blank choices"),
    (mc(choices=["a", None, "b", "c"]), "blank choices"),
    (mc(choices=["a", "b"]), "length choices 2"), (mc(choices=None), "length choices"),
    (mc(question=" short "), "short question"), (mc(question=None), "short question"),
    (mc(source=""), "absent source"), (mc(source=None), "absent source"), (mc(axis="life"), "foreign axis facts"),
    (mc(axis="nowhere"), "unlisted axis nowhere; foreign axis facts"),
    (mc(axis=None), "unlisted axis; foreign axis facts"),
    (mc(dimension="cookery"), "unlisted dimension cookery"), (mc(difficulty="hard"), "unlisted difficulty hard"),
    (mc(distractor_types=["near_miss", "correct", "near_miss", "folk_trap"]), "off_key distractor_types"),
    (mc(distractor_types=["correct", "correct", "near_miss", "folk_trap"]), "keys distractor_types 2"),
    (mc(distractor_types=["correct", "near_miss"]), "length distractor_types 2"),
    (mc(distractor_types=["correct", "x", "near_miss", None]), "unlisted distractor_types"),
    (mc(distractor_types=None), None), (mc(dimension="culture", axis="life"), None),
    (mc(format="essay"), "unlisted format essay"), (mc(format=None), "unlisted format"),
    (mc(pack="p2"), "foreign axis other; unlisted axis facts"), (mc(pack="p2", axis="other"), None),
    (mc(pack="p9"), "unlisted dimension history; unlisted axis facts; unlisted distractor_types"),
]


def test_mc_rules(spark, vocab):
    rows = [mc_ | {"question_id": str(i)} for i, (mc_, _) in enumerate(CASES)]
    checked = validate.validate_items(frame(spark, rows), *vocab)
    assert "Join" not in checked._jdf.queryExecution().executedPlan().toString()
    got = {int(r.question_id): r.e for r in checked.select("question_id", validate.shown().alias("e")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert sorted(got[i].split("; ")) == sorted((want or "").split("; ")), (i, got[i])


def test_open_rules(spark, vocab):
    base = ("p1", "open", "life", "culture", "basic", "A long enough scenario for testing.")
    rows = [(*base, (["x"], ["y"], "z")), (*base, ([], ["y"], "z")), (*base, (["x"], None, "")),
            (*base, None), (*base[:5], "tiny", (["x"], ["y"], "z"))]
    df = spark.createDataFrame(
        rows, "pack string, format string, axis string, dimension string, difficulty string,"
              "prompt string, rubric struct<must_include:array<string>,should_not:array<string>,"
              "ideal_reasoning_pattern:string>")
    got = [r[0] for r in validate.validate_items(df, *vocab).select(validate.shown()).collect()]
    assert got == ["", "absent rubric.must_include",
                   "absent rubric.should_not; absent rubric.ideal_reasoning_pattern",
                   "absent rubric", "short prompt"]


def test_two_key_deduplication_is_sequential(spark):
    rng = random.Random(5)
    for trial in range(4):
        pool = [(i, f"id{rng.randrange(12)}", f"s{rng.randrange(12)}") for i in range(60)]
        seen_id, seen_stem, want = set(), set(), []
        for i, qid, stem in pool:
            if qid not in seen_id and stem not in seen_stem:
                seen_id.add(qid)
                seen_stem.add(stem)
                want.append(i)
        df = spark.createDataFrame(pool, "pos int, question_id string, stem string").repartition(7)
        assert sorted(r.pos for r in bank.deduplicate(df, "pos").collect()) == want


@pytest.mark.parametrize("frac", [0.2, 0.5])
def test_holdout_sizes_are_exact_and_stable(spark, frac):
    sizes = {("a", "basic"): 1, ("a", None): 5, ("b", "basic"): 13, ("c", "x"): 400}
    rows = [(f"{d}{e}{i}", d, e) for (d, e), n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "question_id string, dimension string, difficulty string")
    runs = [{r.question_id for r in bank.stratified_holdout(df.repartition(k), frac, 7)
             .where("holdout").collect()} for k in (1, 9)]
    assert runs[0] == runs[1]
    held = Counter((d, e) for q, d, e in rows if q in runs[0])
    assert held == {k: round(n * frac) for k, n in sizes.items() if round(n * frac)}
    other = {r.question_id for r in bank.stratified_holdout(df, frac, 8).where("holdout").collect()}
    assert other != runs[0]


def test_sample_has_the_exact_size(spark):
    keys = spark.createDataFrame([("m", f"q{i}", r) for i in range(20) for r in range(3)] * 2,
                                 "model string, question_id string, run_index int")
    a = bank.sample_keys(keys, 0.25, 1).collect()
    assert len(a) == 15 == len(set(a)) and set(a) == set(bank.sample_keys(keys, 0.25, 1).collect())


def test_balancing_keeps_pairs_and_maps_back(spark, vocab):
    old = [mc(question_id=f"q{i}", question=f"Question number {i} in full?", answer_index=i % 4,
              distractor_types=[("correct" if j == i % 4 else TYPES[1 + j % 3]) for j in range(4)])
           for i in range(400)]
    old[7]["distractor_types"] = None
    before = frame(spark, old)
    out = bank.balance_positions(before, 42)
    rows = {r.question_id: r for r in out.collect()}
    for d in old:
        r = rows[d["question_id"]]
        assert sorted(r.order) == [0, 1, 2, 3]
        assert r.choices == [d["choices"][i] for i in r.order]
        assert r.choices[r.answer_index] == d["choices"][d["answer_index"]]
        if d["distractor_types"] is None:
            assert r.distractor_types is None
        else:
            assert r.distractor_types == [d["distractor_types"][i] for i in r.order]
    assert all(60 < n < 140 for n in Counter(r.answer_index for r in rows.values()).values())
    assert validate.validate_items(out, *vocab).where("size(errors) > 0").count() == 0
    rebuilt = {r.question_id: r for r in bank.position_map(
        before, out.drop("order", "answer_from", "answer_to")).collect()}
    assert all(rebuilt[q].order == rows[q].order and rebuilt[q].answer_to == rows[q].answer_to
               and rebuilt[q].answer_from == rows[q].answer_from for q in rows)


def test_balancing_refuses_mismatched_types(spark):
    with pytest.raises(Exception, match="distractor_types length"):
        bank.balance_positions(frame(spark, [mc(distractor_types=["correct"])]), 1).collect()


def test_quota_plan(spark):
    df = spark.createDataFrame([("d", 40, ["x", "y"]), ("tiny", 1, ["x"])],
                               "dimension string, target int, subtopics array<string>")
    rows = bank.quota_plan(df).collect()
    per = Counter()
    for r in rows:
        per[r.dimension, r.difficulty] += r["count"]
    # ceil(52), then 30 / 40 / 20 percent half-even and the rest
    assert [per["d", k] for k in ("basic", "intermediate", "advanced", "expert")] == [16, 21, 10, 5]
    assert [per["tiny", k] for k in ("basic", "intermediate", "advanced", "expert")] == [1, 1, 0, 2]
    second = next(r for r in rows if r.difficulty == "basic" and r.batch == 1)
    assert (second["count"], second.subtopics) == (7, ["y", "x"])


REVIEW = "question_id string, persona string, parse_ok boolean, resolicited boolean, review string"


def decisions(spark, rows):
    items = frame(spark, [mc(question_id=q) for q in ("q1", "q2", "q3")])
    latest = reviews.latest_reviews(reviews.typed_reviews(spark.createDataFrame(rows, REVIEW)))
    return {r.question_id: r for r in reviews.review_mc(items, latest).collect()}


def body(letter="A", clarity=5, n=1, flags="[]"):
    return (f'{{"best_answer": "{letter}", "clarity": {clarity}, "n_defensible_options": {n},'
            f'"flags": {flags}}}')


def test_review_rules(spark):
    rows = [("q1", f"p{i}", True, False, body(" a) because")) for i in range(3)]
    # the second pass replaces a failed first pass but not a parsed one
    rows += [("q2", f"p{i}", True, False, body()) for i in range(2)]
    rows += [("q2", "p2", False, False, None), ("q2", "p2", True, True, body("B", flags='["unfair"]')),
             ("q2", "p1", False, True, None)]
    rows += [("q3", "p0", True, False, body("Z")), ("q3", "p1", True, False, "{}")]
    got = decisions(spark, rows)
    assert got["q1"].status == "kept" and got["q1"].key_agreement == 1.0
    assert got["q2"].n_reviewers == 3 and got["q2"].key_agreement == pytest.approx(2 / 3)
    assert got["q2"].bad_flags == 1 and got["q2"].status == "kept"
    assert got["q3"].n_reviewers == 0 and got["q3"].status == "unreviewed"
    assert got["q3"].mean_clarity == 5.0 and got["q3"].key_agreement == 0.0


def test_items_without_reviews_stay(spark):
    got = decisions(spark, [("q1", "p", True, False, body())])
    assert {q: r.status for q, r in got.items()} == dict.fromkeys(("q1", "q2", "q3"), "unreviewed")
    assert got["q2"].mean_n_defensible == 1.0


def test_modal_panel_prefers_the_smaller_size(spark):
    rows = [(u, c) for u, n in (("a", 2), ("b", 3), ("c", 2), ("d", 3)) for c in range(n)]
    df = spark.createDataFrame(rows, "unit string, category int")
    assert {r.unit for r in reviews.modal_panel(df).collect()} == {"a", "c"}
