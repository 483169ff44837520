import pytest
from pyspark.sql import functions as F

from assaykit.functions.answers import answer_letter, harness_letter, letter_matches_key
from assaykit.functions.text import stem, strip, without_reasoning
from assaykit.plans.fixtures import ANSWER_CHOICES, ANSWERS

MORE = [
    ("Line B", 4, "B"), ("ANSWER: (C)", 4, "C"), ("ANSWER: B\n\nANSWER: H", 4, "B"),
    ("Answer: A or B\nOption C", 4, "C"), ("answerB", 4, None), ("going with e", 4, None),
    ("  \n ", 4, None), (None, 4, None), ("ANSWER: C or d", 4, None), ("*A*.", 4, "A"),
    ("the best answer is\tD!", 4, "D"), ("i'd go with (**b**)", 4, "B"),
]


def test_extraction_vectors(spark):
    rows = [(i, t, n, e) for i, (t, n, e) in enumerate(ANSWERS + MORE)]
    df = spark.createDataFrame(rows, "i int, text string, n int, expected string")
    options = F.slice(F.array(*[F.lit(c) for c in ANSWER_CHOICES]), F.lit(1), F.col("n"))
    got = df.select("i", "text", "expected",
                    answer_letter(F.col("text"), F.col("n"), options).alias("got")).collect()
    assert [(r.i, r.text, r.got) for r in got if r.got != r.expected] == []


def test_choice_texts_are_optional_and_only_the_tail_counts(spark):
    text = "the first alternative" + " x" * 300
    df = spark.createDataFrame([(text,), ("x " * 300 + "the first alternative",)], "t string")
    options = F.array(*[F.lit(c) for c in ANSWER_CHOICES[:4]])
    got = [r[0] for r in df.select(answer_letter(F.col("t"), F.lit(4), options)).collect()]
    assert got == [None, "A"]
    assert df.select(answer_letter(F.col("t"), F.lit(4))).first()[0] is None


def test_correctness_of_missing_letter(spark):
    df = spark.createDataFrame([("B", 1), ("B", 0), (None, 0)], "l string, k int")
    got = [r[0] for r in df.select(letter_matches_key(F.col("l"), F.col("k"))).collect()]
    assert got == [True, False, False]


def test_harness_takes_the_last_upper_case_letter(spark):
    df = spark.createDataFrame([("ANSWER: A then ANSWER: (C)",), ("answer: b",)], "t string")
    assert [r[0] for r in df.select(harness_letter(F.col("t"))).collect()] == ["C", None]


@pytest.mark.parametrize("raw, want", [
    ("<think>x</think>\n\nfinal ", "final"), ("bare </think> a </think> b", "b"),
    ("  plain ", "plain")])
def test_reasoning_is_removed(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(without_reasoning(F.col("t"))).first()[0] == want


def test_stem_is_normalised_and_cut(spark):
    df = spark.createDataFrame([("  What's  UP, Doc?! ",), ("ab " * 100,), ("中文",), (None,)], "t string")
    got = [r[0] for r in df.select(stem(F.col("t"), 160)).collect()]
    assert got[0] == "what s up doc" and len(got[1]) == 160 and got[2:] == ["", ""]


def test_strip_looks_at_the_ends_only(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["", "a", "  ", " a b ", "　\x1c x y\x85\r\n", "​a​", "­ a",
             "".join(spaces), "x".join(spaces), *[f"{s}é🙂{s}" for s in spaces], None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.s == (None if r.t is None else r.t.strip())
    # a pattern is tried at every character of a text
    assert "regexp" not in df._jdf.queryExecution().toString()
