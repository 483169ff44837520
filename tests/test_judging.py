import json

from pyspark.sql import functions as F

from assaykit.functions.judging import PATTERN_DEPTH, spans, with_last_object, with_objects
from assaykit.operators import panel
from assaykit.sources.shards import with_array_items

DIMS = ["accuracy", "voice", "wisdom", "distinct"]


def verdict(v=4, **over):
    return {**{d: v for d in DIMS}, **over}


def panels(spark, payloads):
    rows = [("m", "q", 0, f"p{i}", "primary", p if p is None or isinstance(p, str)
             else json.dumps(p), i) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(
        rows, "model string, question_id string, run_index int, persona string,"
              "judge_role string, js string, seq int").withColumn(
        "scores", F.try_parse_json("js")).drop("js")
    return panel.panel_scores(panel.sanitise(panel.primary(df), DIMS), DIMS).first()


def last(spark, text, required=None):
    df = spark.createDataFrame([(text,)], "t string")
    got = with_last_object(df, F.col("t"), "v", required).select(F.to_json("v")).first()[0]
    return got and json.loads(got)


def found(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in with_objects(df, F.col("t"), "o", **kw).orderBy("i").collect()]


def test_last_object_wins_and_strings_hide_braces(spark):
    t = 'prefix {"a":1} mid {"b":2, "c": "close} but {open", "d": {"e": {"f": []}}} end'
    assert last(spark, t)["c"] == "close} but {open"
    assert last(spark, t, ["a"]) == {"a": 1}
    assert last(spark, t, ["zz"]) is None
    assert last(spark, t + ' {"a": null}', ["a"]) == {"a": None}   # a null value is present
    assert last(spark, t + ' {"a": 2, "a": 3} {"a": oops}', ["a"]) == {"a": 1}


def scan(text):
    """Brace counting, character by character, as a plain reference."""
    out, depth, start, quoted, escaped = [], 0, None, False, False
    for i, ch in enumerate(text):
        if quoted:
            escaped, quoted = (False, True) if escaped else (ch == "\\", ch != '"')
            continue
        if ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start:i + 1])
    return out


def test_spans_equal_brace_counting(spark):
    import random
    rng = random.Random(7)
    texts = ["".join(rng.choice('{}"\\a:1 \n') for _ in range(rng.randrange(40)))
             for _ in range(2000)]
    texts += [t + tail for t in texts[:300] for tail in (nested(30), nested(12) + " {", '{"' * 12)]
    for t, o in zip(texts, found(spark, texts), strict=True):
        assert o == scan(t) == spans(t), t


def test_one_meaning_of_an_object_at_every_size(spark):
    """Depth, number of objects and an unclosed tail do not change what an object is."""
    for levels in (1, PATTERN_DEPTH, PATTERN_DEPTH + 1, 20, 60):
        for flat in (0, 1, 30):
            want = [nested(levels)] + ['{"x": "{"}'] * flat
            text = "so " + " and ".join(want)
            assert found(spark, [text, text + " {open", text + ' {"a": "'] ) == [want] * 3
    assert found(spark, [None, "", "none", "{"]) == [None, [], [], []]


def test_plain_texts_skip_the_scan(spark):
    """Only texts with an object that the pattern cannot close reach Python."""
    df = spark.createDataFrame([("{} " * 50,), (nested(PATTERN_DEPTH),)], "t string")
    plan = with_objects(df, F.col("t"), "o")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "CASE WHEN" in plan
    assert spans("{a {b} c} }{ {d}") == ["{a {b} c}"]


def test_malformed_counts_are_missing(spark):
    r = panels(spark, [verdict(must_include_hits="three", must_include_total=3,
                               should_not_violations=None)])
    assert r.composite_100 == 75.0
    assert r.must_include_coverage is None and r.mean_should_not_violations is None


def test_hits_cannot_exceed_total(spark):
    r = panels(spark, [verdict(must_include_hits=7, must_include_total=3,
                               should_not_violations=0)])
    assert r.must_include_coverage == 1.0 and r.mean_should_not_violations == 0.0


def test_normal_panel(spark):
    r = panels(spark, [
        verdict(4, must_include_hits=2, must_include_total=4, should_not_violations=1),
        verdict(5, must_include_hits=3, must_include_total=4, should_not_violations=0)])
    assert (r.n_judges, r.must_include_coverage, r.mean_should_not_violations) == (2, 5 / 8, 0.5)
    assert r.composite_5 == 4.5


def test_clamping_strings_and_junk(spark):
    r = panels(spark, [verdict(9, accuracy="2", voice="N/A", wisdom=None, distinct=-3)])
    assert dict(r.dim_means) == {"accuracy": 2.0, "voice": None, "wisdom": None, "distinct": 1.0}
    assert r.composite_5 == 1.5


def test_empty_and_missing_payloads_are_no_judges(spark):
    r = panels(spark, [None, "{}"])
    assert r.n_judges == 0 and r.composite_100 is None


def test_complete_ratings_need_all_numbers(spark):
    rows = [("m", "q", 0, "p1", None, json.dumps(verdict(9))),
            ("m", "q", 0, "p2", "primary", json.dumps(verdict(accuracy="4"))),
            ("m", "q", 0, "p3", "crosscheck", json.dumps(verdict()))]
    df = spark.createDataFrame(rows, "model string, question_id string, run_index int,"
                               "persona string, judge_role string, js string").withColumn(
        "scores", F.try_parse_json("js"))
    got = panel.complete_ratings(df, DIMS).collect()
    assert [(r.persona, r.composite) for r in got] == [("p1", 9.0)]


def nested(depth):
    return '{"k": ' * depth + "1" + "}" * depth


def test_objects_of_any_depth(spark):
    deep = nested(40)
    texts = {
        f"so {deep} and {{open": [deep],
        f'a "quote {nested(20)} then {{"s": "}}{{ \\" }}"}}': [nested(20), '{"s": "}{ \\" }"}'],
        nested(3) + "} x " + nested(18) + nested(2): [nested(3), nested(18), nested(2)],
        "{" * 30: [],
    }
    for (t, want), o in zip(texts.items(), found(spark, texts), strict=True):
        assert o == want
        assert last(spark, t) == (json.loads(want[-1]) if want else None)


def test_salvage_of_deep_items(spark):
    text = f"[{nested(30)}, {nested(2)}, broken"
    df = spark.createDataFrame([(text + "]",)], "t string")
    assert with_array_items(df, "t", "v").first().v == [nested(30), nested(2)]


def test_last_of_repeated_crosschecks_counts(spark):
    rows = [("m", "q", 0, "p", role, seq, json.dumps(dict.fromkeys(DIMS, v)))
            for role, seq, v in [("primary", 1, 5), ("primary", 2, 2), ("crosscheck", 3, 4),
                                 ("crosscheck", 4, 3), ("crosscheck", 5, None)]]
    df = spark.createDataFrame(rows, "model string, question_id string, run_index int,"
                               "persona string, judge_role string, seq long, js string").withColumn(
        "scores", F.try_parse_json("js"))
    r = panel.crosscheck_pairs(df, DIMS, "seq").first()
    assert (r.primary, r.crosscheck) == (2.0, 3.0)


def test_deep_and_unclosed_texts_stay_in_the_jvm(spark, monkeypatch):
    from pyspark.sql import functions as F

    from assaykit.functions import judging

    @F.pandas_udf("array<string>")
    def none(texts):
        assert texts.isna().all()
        return texts.map(lambda t: None)

    monkeypatch.setattr(judging, "_scanner", lambda strings: none)
    deep = '{"a": ' * 27 + "1" + "}" * 27
    texts = [deep, f"x {deep} y {deep}", '{"x": "{"} and {so on', deep + ' {"open": "{}', "{", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = judging.with_objects(df, F.col("t"), "o").collect()
    assert [r.o for r in got] == [None if t is None else spans(t) for t in texts]


def test_last_object_is_parsed_from_the_end(spark):
    from pyspark.sql import functions as F
    texts = ['{"a": 1} {"a": 2} {draft}', '{"a": 1} {"b": 2}', '{draft} {"a": null}', "{draft}", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = with_last_object(df, F.col("t"), "v", ["a"]).select(F.to_json("v").alias("j")).collect()
    assert [r.j for r in got] == ['{"a":2}', '{"a":1}', '{"a":null}', None, None]


def test_numbers_are_read_once(spark):
    from pyspark.sql import functions as F

    from assaykit.operators import panel
    text = '{"a": "4", "b": 9, "must_include_hits": 3, "must_include_total": 2, "should_not_violations": -1}'
    raw = spark.createDataFrame([("m", 1, 0, 0, None, 1, text)], "model string, question_id int, "
                                "run_index int, persona int, judge_role string, seq long, text string")
    typed = panel.sanitise(raw.withColumn("scores", F.try_parse_json("text")), ["a", "b"])
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(f"$.{k},") == 1 for k in ("a", "b", panel.HITS, panel.TOTAL, panel.VIOLATIONS))
    r = typed.first()
    assert (r.a, r.b, r.hits, r.points, r.violations, r.judged) == (4.0, 5.0, 2.0, 2.0, None, True)
