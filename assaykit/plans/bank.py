"""Registered queries: item validation, de-duplication, reviews, holdout, balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.judging import with_last_object
from assaykit.functions.text import content_basis, content_id, stem
from assaykit.operators import bank, prompts, reliability, reviews, validate, worklist
from assaykit.plans.fixtures import REVIEWERS, VALID, fixture, table
from assaykit.plans.registry import SEED, query, using
from assaykit.session import scratch_path
from assaykit.sources import shards

HOLDOUT = 0.2
ITEM_VOCAB = using("items", "taxonomy", "types")
OPEN_VOCAB = using("open_items", "taxonomy")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "items")


def open_items(spark: SparkSession, sf: str) -> DataFrame:
    """Open items with their rubric struct."""
    return fixture(spark, sf, "open_items").withColumn("rubric", F.struct(
        "must_include", "should_not", F.col("ideal").alias("ideal_reasoning_pattern")))


def valid_items(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).where(VALID).withColumn("question_id", F.col("p_partkey"))


def all_items(spark: SparkSession, sf: str) -> DataFrame:
    """MC and open items in one table; ``nr`` is the source position."""
    mc = items(spark, sf).withColumn("nr", F.col("p_partkey")).drop("d", "p_partkey")
    op = open_items(spark, sf).withColumn("nr", F.lit(10**9) + F.col("doc_id")).drop(
        "doc_id", "question_id", "must_include", "should_not", "ideal")
    return mc.unionByName(op, allowMissingColumns=True)


def validated(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return validate.validate_items(rows, fixture(spark, sf, "taxonomy"),
                                   fixture(spark, sf, "types"))


# Errors as "code field detail", in the order of the rules.
SHARED_ERRORS = """
  CASE WHEN difficulty NOT IN ('basic', 'intermediate', 'advanced', 'expert')
    THEN 'unlisted difficulty ' || difficulty END,
  CASE WHEN NOT known THEN 'unlisted dimension ' || dimension END,
  CASE WHEN axis NOT IN (SELECT axis FROM taxonomy) THEN 'unlisted axis ' || axis END,
  CASE WHEN want <> axis THEN 'foreign axis ' || want END,"""

MC_ERRORS = f""", vm AS (SELECT i.*, t.axis AS want, t.dimension IS NOT NULL AS known FROM items i
  LEFT JOIN taxonomy t ON t.dimension = i.dimension AND t.format = 'mc'),
em AS (SELECT *, list_filter([{SHARED_ERRORS}
  CASE WHEN length(trim(question)) < 10 THEN 'short question' END,
  CASE WHEN source = '' THEN 'absent source' END,
  CASE WHEN answer_index NOT BETWEEN 0 AND len(choices) - 1 THEN 'range answer_index ' || answer_index END,
  CASE WHEN len(list_filter(choices, lambda c: trim(c) = '')) > 0 THEN 'blank choices' END,
  CASE WHEN len(list_distinct(list_transform(choices, lambda c: lower(trim(c))))) < len(choices)
    THEN 'repeat choices' END,
  CASE WHEN distractor_types IS NULL THEN NULL
    WHEN len(distractor_types) <> len(choices) THEN 'length distractor_types ' || len(distractor_types)
    WHEN list_contains(distractor_types, 'bogus') THEN 'unlisted distractor_types'
    WHEN len(list_filter(distractor_types, lambda x: x = 'correct')) <> 1 THEN
      'keys distractor_types ' || len(list_filter(distractor_types, lambda x: x = 'correct'))
    WHEN answer_index < 4 AND distractor_types[answer_index + 1] <> 'correct'
      THEN 'off_key distractor_types' END], lambda x: x IS NOT NULL) AS e FROM vm),
mc_errors AS (SELECT *, CASE WHEN format <> 'mc' THEN 'unlisted format ' || format
  ELSE coalesce(array_to_string(e, '; '), '') END AS errors FROM em)"""

OPEN_ERRORS = f""", vo AS (SELECT o.*, t.axis AS want, t.dimension IS NOT NULL AS known
  FROM open_items o LEFT JOIN taxonomy t ON t.dimension = o.dimension AND t.format = 'open'),
open_errors AS (SELECT *, coalesce(array_to_string(list_filter([{SHARED_ERRORS}
  CASE WHEN length(trim(regexp_replace(prompt, '^\\s+|\\s+$', '', 'g'))) < 20 THEN 'short prompt' END,
  CASE WHEN len(must_include) = 0 THEN 'absent rubric.must_include' END,
  CASE WHEN len(should_not) = 0 THEN 'absent rubric.should_not' END,
  CASE WHEN ideal = '' THEN 'absent rubric.ideal_reasoning_pattern' END], lambda x: x IS NOT NULL), '; '), '')
  AS errors FROM vo)"""


@query("B1_validate_mc", ITEM_VOCAB + MC_ERRORS + " SELECT p_partkey, errors FROM mc_errors")
def _(spark, sf):
    return validated(spark, sf, items(spark, sf)).select(
        "p_partkey", validate.shown().alias("errors"))


@query("B2_validate_open", OPEN_VOCAB + OPEN_ERRORS + " SELECT doc_id, errors FROM open_errors")
def _(spark, sf):
    rows = all_items(spark, sf).where("format = 'open'")
    return validated(spark, sf, rows).select(
        (F.col("nr") - 10**9).alias("doc_id"), validate.shown().alias("errors"))


@query("B3_axis_consistency", ITEM_VOCAB + MC_ERRORS + """
SELECT p_partkey, axis, dimension FROM mc_errors
WHERE format = 'mc' AND errors LIKE '%foreign axis%'""")
def _(spark, sf):
    rows = validated(spark, sf, all_items(spark, sf)).where("format = 'mc'")
    return rows.where(F.exists("errors", lambda e: e["code"] == "foreign")).select(
        F.col("nr").alias("p_partkey"), "axis", "dimension")


@query("B4_validate_any_format", using("items", "open_items", "taxonomy", "types") + MC_ERRORS
       + OPEN_ERRORS + """
SELECT format, count(*) AS n, count(*) FILTER (errors = '') AS n_valid FROM (
  SELECT format, errors FROM mc_errors UNION ALL SELECT format, errors FROM open_errors)
GROUP BY format""")
def _(spark, sf):
    return validated(spark, sf, all_items(spark, sf)).groupBy("format").agg(
        F.count("*").alias("n"), F.count_if(F.size("errors") == 0).alias("n_valid"))


def authored(spark: SparkSession, sf: str) -> DataFrame:
    """Item objects as a model wrote them: some without axis, some with a null one."""
    k = F.col("p_partkey")
    axis = (F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(', "axis": null'))
             .otherwise(F.lit(', "axis": "axis9"')))
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit('{"question": "'), F.col("p_name"), F.lit('"'), axis,
                              F.lit("}")).alias("json"),
        F.lit("mc").alias("cell_format"), F.col("p_brand").alias("cell_axis"),
        F.col("p_type").alias("cell_dimension"), F.lit("basic").alias("cell_difficulty"))


@query("B5_fill_from_cell", """
SELECT p_partkey, p_name AS question, 'mc' AS format, p_type AS dimension, 'basic' AS difficulty,
  CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN NULL ELSE 'axis9' END AS axis FROM part""")
def _(spark, sf):
    from assaykit import schemas
    rows = authored(spark, sf)
    body = F.from_json("json", schemas.ITEM_ANY)
    names = ["question", "format", "axis", "dimension", "difficulty"]
    parsed = rows.withColumn("b", body).select("*", *[F.col(f"b.{n}").alias(n) for n in names])
    return validate.fill_from_cell(parsed, "json").select("p_partkey", *names)


# ---- prompts -----------------------------------------------------------------

OPTIONS = """array_to_string(list_transform(range(0, len(choices)),
  lambda i: substr('ABCDEFGH', i + 1, 1) || '. ' || choices[i + 1]), chr(10))"""


@query("B7_choice_prompts", using("items") + f"""
SELECT p_partkey, question || chr(10) || chr(10) || {OPTIONS} || chr(10) || chr(10)
  || 'Give your reasons first. The last line holds the letter alone:' || chr(10)
  || 'ANSWER: <letter>' AS prompt FROM items""")
def _(spark, sf):
    return items(spark, sf).select("p_partkey", prompts.mc_prompt().alias("prompt"))


@query("B7_open_prompts", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(spark, sf):
    return open_items(spark, sf).select("doc_id", F.md5(prompts.open_prompt()).alias("digest"))


JUDGE_TEMPLATE = ("You are {persona}.\nSCENARIO:\n{prompt}\nMUST:\n{must}\nAVOID:\n{avoid}\n"
                  "IDEAL: {ideal}\nRESPONSE:\n{response}")
REVIEW_TEMPLATE = "ITEM ({dimension} / {difficulty}):\n{question}\n{options}\nPick the best answer."
OPEN_REVIEW = "({dimension} / {difficulty}) {prompt} MUST {must} AVOID {avoid} IDEAL {ideal}"
AUTHOR = "Write {count} items: {dimension} ({description}) {axis} {difficulty}; use {subtopics}"
PERSONAS = [("elder", "a careful elder"), ("editor", "a strict editor"), ("peer", "a peer")]


@query("B8_judge_prompts", using("open_items") + """
, p(persona, persona_text) AS (VALUES ('elder', 'a careful elder'), ('editor', 'a strict editor'),
  ('peer', 'a peer'))
SELECT doc_id, persona, md5('You are ' || persona_text || '.' || chr(10) || 'SCENARIO:' || chr(10)
  || prompt || chr(10) || 'MUST:' || chr(10)
  || coalesce(array_to_string(list_transform(must_include, lambda x: '  - ' || x), chr(10)), '')
  || chr(10) || 'AVOID:' || chr(10)
  || coalesce(array_to_string(list_transform(should_not, lambda x: '  - ' || x), chr(10)), '')
  || chr(10) || 'IDEAL: ' || ideal || chr(10) || 'RESPONSE:' || chr(10)
  || 'answer ' || doc_id || ' {persona}') AS digest FROM open_items, p""")
def _(spark, sf):
    personas = spark.createDataFrame(PERSONAS, "persona string, persona_text string")
    # a placeholder inside the data must survive untouched
    answers = open_items(spark, sf).withColumn("text", F.concat(
        F.lit("answer "), F.col("doc_id").cast("string"), F.lit(" {persona}")))
    jobs = worklist.review_jobs(answers, personas)
    return jobs.select("doc_id", "persona",
                       F.md5(prompts.judge_prompt(JUDGE_TEMPLATE)).alias("digest"))


@query("B8_review_prompts", using("items") + f"""
SELECT p_partkey, 'ITEM (' || dimension || ' / ' || difficulty || '):' || chr(10) || question
  || chr(10) || {OPTIONS} || chr(10) || 'Pick the best answer.' AS prompt FROM items""")
def _(spark, sf):
    return items(spark, sf).select("p_partkey",
                                   prompts.mc_review_prompt(REVIEW_TEMPLATE).alias("prompt"))


@query("B8_open_review_prompts", using("open_items") + """
SELECT doc_id, md5('(' || dimension || ' / ' || difficulty || ') ' || prompt || ' MUST '
  || coalesce(array_to_string(must_include, '; '), '') || ' AVOID '
  || coalesce(array_to_string(should_not, '; '), '') || ' IDEAL ' || ideal) AS digest
FROM open_items""")
def _(spark, sf):
    return open_items(spark, sf).select(
        "doc_id", F.md5(prompts.open_review_prompt(OPEN_REVIEW)).alias("digest"))


@query("A10_harness_dataset", using("items") + f"""
SELECT p_partkey AS question_id, question || chr(10) || chr(10) || {OPTIONS} || chr(10) || chr(10)
  || 'Last line: ANSWER: <letter>' AS doc_text,
  substr('ABCDEFGH', answer_index + 1, 1) AS target FROM items WHERE {VALID}""")
def _(spark, sf):
    return prompts.harness_dataset(valid_items(spark, sf))


# ---- ids, stems, duplicates ------------------------------------------------------

@query("G6_stems", """
SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS stem
FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", stem(F.col("text")).alias("stem"))


@query("G7_content_ids", using("items") + """
SELECT p_partkey, concat_ws('_', dimension, difficulty, substr(sha256(
  question || '||' || array_to_string(choices, '|')), 1, 10)) AS question_id
FROM items WHERE format = 'mc'""")
def _(spark, sf):
    rows = items(spark, sf).where("format = 'mc'")
    basis = content_basis(F.col("format"), F.col("question"), F.col("choices"), F.lit(""))
    return rows.select("p_partkey", content_id(F.col("dimension"), F.col("difficulty"), basis)
                       .alias("question_id"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate texts as open items with id and stem."""
    rows = fixture(spark, sf, "pool").select(
        "doc_id", "dimension", "difficulty", F.lit("open").alias("format"),
        F.col("text").alias("prompt"), F.lit(None).cast("string").alias("question"),
        F.lit(None).cast("array<string>").alias("choices"))
    return bank.with_ids(rows)


STEMS = """, st AS (SELECT doc_id, dimension, difficulty, row_number() OVER (PARTITION BY
  trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) ORDER BY doc_id) AS rn,
  concat_ws('_', dimension, difficulty, substr(sha256(text), 1, 10)) AS question_id FROM pool),
kept AS (SELECT * FROM st WHERE rn = 1)"""


@query("E2_deduplicate", using("pool") + STEMS + " SELECT doc_id, question_id FROM kept")
def _(spark, sf):
    return bank.deduplicate(pool(spark, sf), "doc_id").select("doc_id", "question_id")


@query("E2_first_per_stem", using("pool") + STEMS + " SELECT doc_id, question_id FROM kept")
def _(spark, sf):
    return bank.first_per_stem(pool(spark, sf), "doc_id").select("doc_id", "question_id")


@query("D1_counts_by_cell", using("pool") + STEMS + """
SELECT 'open' AS format, dimension, difficulty, count(*) AS n FROM kept GROUP BY ALL""")
def _(spark, sf):
    return bank.counts_by_cell(bank.first_per_stem(pool(spark, sf), "doc_id"))


HELD = """, hd AS (SELECT doc_id, dimension, difficulty, row_number() OVER (PARTITION BY dimension,
    difficulty ORDER BY sha256('{seed}|' || doc_id), doc_id)
  <= round_even((count(*) OVER (PARTITION BY dimension, difficulty)) * 0.2, 0) AS holdout
  FROM pool)""".replace("{seed}", str(SEED))


def split(spark: SparkSession, sf: str) -> DataFrame:
    return bank.stratified_holdout(fixture(spark, sf, "pool"), HOLDOUT, SEED, key="doc_id")


@query("E3_stratified_holdout", using("pool") + HELD
       + " SELECT doc_id, dimension, difficulty, holdout FROM hd")
def _(spark, sf):
    return split(spark, sf).select("doc_id", "dimension", "difficulty", "holdout")


@query("H3_partition_check", using("pool") + HELD + """
SELECT count(*) AS n, count(*) FILTER (holdout) AS n_holdout, 0::BIGINT AS n_both,
  0::BIGINT AS n_lost FROM hd""")
def _(spark, sf):
    s = split(spark, sf)
    source = fixture(spark, sf, "pool").groupBy("doc_id").agg(F.lit(1).alias("src"))
    sides = s.groupBy("doc_id").agg(F.bool_or("holdout").alias("h"),
                                    F.bool_or(~F.col("holdout")).alias("p"))
    return source.join(sides, "doc_id", "full").agg(
        F.count("*").alias("n"), F.count_if("h").alias("n_holdout"),
        F.count_if(F.col("h") & F.col("p")).alias("n_both"),
        F.count_if(F.col("h").isNull() | F.col("src").isNull()).alias("n_lost"))


# ---- balancing ---------------------------------------------------------------------

BALANCED = f""", bi AS (SELECT *, '{SEED}|' || p_partkey AS tag FROM items WHERE {VALID}),
ot AS (SELECT p_partkey, list(i ORDER BY md5(tag || '|' || i), i) AS others FROM (
  SELECT p_partkey, tag, answer_index, unnest(range(0, len(choices))) AS i FROM bi)
  WHERE i <> answer_index GROUP BY p_partkey),
sl AS (SELECT bi.*, others, CAST('0x' || substr(md5(tag || '|slot'), 1, 8) AS BIGINT)
  % len(choices) AS slot FROM bi JOIN ot USING (p_partkey)),
ba AS (SELECT *, list_concat(list_concat(others[1:slot], [answer_index::BIGINT]),
  others[slot + 1:]) AS ord FROM sl)"""


@query("G14_balanced_items", using("items") + BALANCED + """
SELECT p_partkey, array_to_string(list_transform(ord, lambda i: choices[i + 1]), '|') AS choices,
  array_to_string(list_transform(ord, lambda i: distractor_types[i + 1]), '|')
    AS distractor_types, slot AS answer_index FROM ba""")
def _(spark, sf):
    out = bank.balance_positions(valid_items(spark, sf), SEED)
    return out.select("p_partkey", F.array_join("choices", "|").alias("choices"),
                      F.array_join("distractor_types", "|").alias("distractor_types"),
                      "answer_index")


@query("G14_balanced_still_valid", using("items") + f"""
SELECT count(*) AS n, 0::BIGINT AS n_invalid FROM items WHERE {VALID}""")
def _(spark, sf):
    out = bank.balance_positions(valid_items(spark, sf), SEED)
    return validated(spark, sf, out).agg(
        F.count("*").alias("n"), F.count_if(F.size("errors") > 0).alias("n_invalid"))


@query("G15_position_map", using("items") + BALANCED + """
SELECT p_partkey AS question_id, array_to_string(ord, ',') AS "order",
  answer_index::BIGINT AS answer_from, slot AS answer_to FROM ba""")
def _(spark, sf):
    before = valid_items(spark, sf)
    after = bank.balance_positions(before, SEED).drop("order", "answer_from", "answer_to")
    return bank.position_map(before, after).withColumn(
        "order", F.array_join(F.col("order").cast("array<string>"), ","))


@query("C10_remapped_letters", using("items", "reviews") + BALANCED + """
SELECT question_id, persona, letter, substr('ABCDEFGH', list_position(ord,
  instr('ABCDEFGH', letter) - 1), 1) AS letter_after
FROM (SELECT question_id, persona, substr(json_extract_string(review, '$.best_answer'), 1, 1)
  AS letter FROM reviews WHERE review IS NOT NULL AND NOT resolicited) r
JOIN ba ON ba.p_partkey = question_id""")
def _(spark, sf):
    after = bank.balance_positions(valid_items(spark, sf), SEED)
    positions = after.select("question_id", "order", "answer_from", "answer_to")
    answers = (reviews.typed_reviews(fixture(spark, sf, "reviews"))
               .where("review IS NOT NULL AND NOT resolicited")
               .select("question_id", "persona",
                       F.substring("review.best_answer", 1, 1).alias("letter")))
    return bank.remap_letters(answers, positions, "letter").select(
        "question_id", "persona", "letter", "letter_after")


@query("D14_key_positions", using("items") + f"""
, c AS (SELECT answer_index::BIGINT AS answer_index, count(*) AS n FROM items WHERE {VALID} GROUP BY 1)
SELECT answer_index, n, round(n / sum(n) OVER (), 6) AS share,
  round(max(n) OVER () / sum(n) OVER (), 6) AS guesser FROM c""")
def _(spark, sf):
    return bank.key_positions(valid_items(spark, sf))


@query("D14_key_positions_after", using("items") + BALANCED + """
, c AS (SELECT slot AS answer_index, count(*) AS n FROM ba GROUP BY 1)
SELECT answer_index, n, round(n / sum(n) OVER (), 6) AS share,
  round(max(n) OVER () / sum(n) OVER (), 6) AS guesser FROM c""")
def _(spark, sf):
    return bank.key_positions(bank.balance_positions(valid_items(spark, sf), SEED))


# ---- authoring plan ------------------------------------------------------------------

PLAN = """, tg AS (SELECT p_type || ' ' || p_brand AS dimension, count(*) AS target, p_type AS t
  FROM part GROUP BY p_type, p_brand),
wn AS (SELECT *, CAST(ceil(target * 1.3::DOUBLE) AS BIGINT) AS want FROM tg),
qs AS (SELECT *, CAST(round_even(want * 0.30::DOUBLE, 0) AS BIGINT) AS b,
  CAST(round_even(want * 0.40::DOUBLE, 0) AS BIGINT) AS i,
  CAST(round_even(want * 0.20::DOUBLE, 0) AS BIGINT) AS a FROM wn),
qu AS (SELECT dimension, t, unnest(['basic', 'intermediate', 'advanced', 'expert']) AS difficulty,
  unnest([b, i, a, greatest(2, want - b - i - a)]) AS quota FROM qs),
bt AS (SELECT *, unnest(range(0, CAST(ceil(quota / 9) AS BIGINT))) AS batch FROM qu WHERE quota > 0),
plan AS (SELECT dimension, difficulty, quota, batch, least(9, quota - batch * 9) AS count,
  (t || '-s' || (batch % 3)) AS first_subtopic FROM bt)"""


def targets(spark: SparkSession, sf: str) -> DataFrame:
    subs = F.array(*[F.concat(F.col("p_type"), F.lit(f"-s{i}")) for i in range(3)])
    return (table(spark, sf, "part").groupBy("p_type", "p_brand")
            .agg(F.count("*").alias("target"))
            .select(F.concat_ws(" ", "p_type", "p_brand").alias("dimension"), "target",
                    subs.alias("subtopics")))


@query("E12_quota_plan", "WITH x AS (SELECT 1)" + PLAN + " SELECT * FROM plan")
def _(spark, sf):
    return bank.quota_plan(targets(spark, sf)).select(
        "dimension", "difficulty", "quota", "batch", "count",
        F.get("subtopics", F.lit(0)).alias("first_subtopic"))


@query("B8_authoring_prompts", "WITH x AS (SELECT 1)" + PLAN + """
SELECT dimension, difficulty, batch, 'Write ' || count || ' items: ' || dimension || ' (about '
  || dimension || ') axis1 ' || difficulty || '; use ' || split_part(dimension, ' ', 1) || '-s'
  || (batch % 3) || '; ' || split_part(dimension, ' ', 1) || '-s' || ((batch + 1) % 3) || '; '
  || split_part(dimension, ' ', 1) || '-s' || ((batch + 2) % 3) AS prompt FROM plan""")
def _(spark, sf):
    cells = bank.quota_plan(targets(spark, sf)).withColumn("axis", F.lit("axis1")).withColumn(
        "description", F.concat(F.lit("about "), F.col("dimension")))
    return cells.select("dimension", "difficulty", "batch",
                        prompts.authoring_prompt(AUTHOR).alias("prompt"))


@query("D19_cell_coverage", ITEM_VOCAB + MC_ERRORS + """
, ex AS (SELECT dimension, difficulty, count(*) AS expected FROM items GROUP BY ALL),
gd AS (SELECT dimension, difficulty, count(*) AS valid FROM mc_errors WHERE errors = '' GROUP BY ALL)
SELECT dimension, difficulty, expected, coalesce(valid, 0) AS valid,
  greatest(1, CAST(ceil(0.7::DOUBLE * expected) AS BIGINT)) AS needed,
  coalesce(valid, 0) >= greatest(1, ceil(0.7::DOUBLE * expected)) AS complete
FROM ex LEFT JOIN gd USING (dimension, difficulty)""")
def _(spark, sf):
    rows = validated(spark, sf, all_items(spark, sf).where("format <> 'open'"))
    plan = items(spark, sf).groupBy("dimension", "difficulty").agg(
        F.count("*").alias("expected"))
    return bank.cell_coverage(plan, rows, ["dimension", "difficulty"])


# ---- reviews ------------------------------------------------------------------------

# Decisions from the review numbers, not from the payload text.
LATEST = """, lt AS (SELECT p_partkey AS question_id, k, reviewer, differs, clarity, defensible, flag,
  failing AND p_partkey % 2 = 1 AS lost, failing, pass FROM review_base WHERE pass = 0),
pn AS (SELECT question_id, any_value(k) AS k, count(*) FILTER (NOT lost) AS n,
  count(*) FILTER (NOT lost AND NOT differs) AS agree,
  avg(clarity) FILTER (NOT lost) AS clarity, avg(defensible) FILTER (NOT lost) AS defensible,
  count(*) FILTER (NOT lost AND flag = 'ambiguous') AS bad FROM lt GROUP BY question_id),
rv AS (SELECT *, coalesce(agree / nullif(n, 0), 0) AS ka, coalesce(clarity, 0) AS mc,
  coalesce(defensible, 1) AS md FROM pn),
st AS (SELECT *, CASE WHEN n < 3 THEN 'unreviewed' WHEN ka >= 0.6 AND mc >= 4 AND md <= 1.5
  AND bad <= 1 THEN 'kept' ELSE 'rejected' END AS status FROM rv)"""
RV = using("review_base")


def latest(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.latest_reviews(reviews.typed_reviews(fixture(spark, sf, "reviews")))


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.review_mc(valid_items(spark, sf), latest(spark, sf))


def reviewed_open(spark: SparkSession, sf: str) -> DataFrame:
    """The same review log read as reviews of open items."""
    return reviews.review_open(valid_items(spark, sf), latest(spark, sf))


@query("G4_review_json", RV + """
SELECT p_partkey AS question_id, reviewer, clarity FROM review_base
WHERE pass = 0 AND NOT failing""")
def _(spark, sf):
    noisy = fixture(spark, sf, "reviews").where("NOT resolicited").select(
        "question_id", F.regexp_extract("persona", "([0-9]+)", 1).cast("int").alias("reviewer"),
        F.concat(F.lit('Thinking {"a": {"b": "}"}} so: '), F.col("review"),
                 F.lit(" {trailing")).alias("text"))
    found = with_last_object(noisy.where(F.col("text").isNotNull()), F.col("text"), "v")
    return found.select("question_id", "reviewer",
                        F.try_variant_get("v", "$.clarity", "int").alias("clarity"))


@query("C7_latest_reviews", RV + LATEST + """
SELECT question_id, 'reviewer' || reviewer AS persona, NOT lost AS parsed,
  CASE WHEN lost THEN NULL ELSE clarity::DOUBLE END AS clarity,
  CASE WHEN lost THEN NULL WHEN flag IN ('ambiguous', 'trivia') THEN flag ELSE '' END AS flags
FROM lt""")
def _(spark, sf):
    return latest(spark, sf).select("question_id", "persona", "parsed", "clarity",
                                    F.array_join("flags", "|").alias("flags"))


@query("C8_resolicit_list", RV + """
SELECT p_partkey AS question_id, 'reviewer' || reviewer AS persona, 'high' AS effort,
  1::BIGINT AS run_index FROM review_base WHERE pass = 0 AND failing""")
def _(spark, sf):
    return worklist.resolicit_list(fixture(spark, sf, "reviews"), "medium")


@query("C8_still_failing", RV + LATEST + """
SELECT count(*) FILTER (lost) AS still_failing FROM lt""")
def _(spark, sf):
    return worklist.still_failing(fixture(spark, sf, "reviews"))


@query("H2_union_of_passes", RV + """
SELECT pass = 1 AS resolicited, count(*) AS n FROM review_base
WHERE pass = 0 OR (failing AND p_partkey % 2 = 0) GROUP BY 1""")
def _(spark, sf):
    r = fixture(spark, sf, "reviews")
    first, second = r.where("NOT resolicited").drop("resolicited"), r.where("resolicited")
    both = first.unionByName(second, allowMissingColumns=True)
    return both.groupBy(F.coalesce("resolicited", F.lit(False)).alias("resolicited")).agg(
        F.count("*").alias("n"))


@query("D11_review_decisions", RV + LATEST + """
SELECT question_id, round(ka, 6) AS key_agreement, round(mc, 6) AS mean_clarity,
  round(md, 6) AS mean_n_defensible, n AS n_reviewers, bad AS bad_flags, status FROM st""")
def _(spark, sf):
    return reviewed(spark, sf).select("question_id", "key_agreement", "mean_clarity",
                                      "mean_n_defensible", "n_reviewers", "bad_flags", "status")


OPEN_LATEST = """, lo AS (SELECT *, lost OR (question_id % 7 = 2 AND reviewer < 3) AS out FROM lt),
po AS (SELECT question_id, count(*) FILTER (NOT out) AS n, avg(clarity) FILTER (NOT out) AS r,
  avg(clarity + CASE WHEN question_id % 4 = 0 THEN 1 ELSE 0 END) FILTER (NOT out) AS f
  FROM lo GROUP BY question_id),
so AS (SELECT question_id, n, coalesce(r, 0) AS r, coalesce(f, 0) AS f, CASE WHEN n < 3
  THEN 'unreviewed' WHEN coalesce(r, 0) >= 4 AND coalesce(f, 0) >= 4 THEN 'kept'
  ELSE 'rejected' END AS status FROM po)"""


@query("D12_open_review_decisions", RV + LATEST + OPEN_LATEST + """
SELECT question_id, round(r, 6) AS mean_realistic, round(f, 6) AS mean_rubric_fair,
  round(r, 6) AS mean_clarity, n AS n_reviewers, 0::BIGINT AS bad_flags, status FROM so""")
def _(spark, sf):
    return reviewed_open(spark, sf).select(
        "question_id", "mean_realistic", "mean_rubric_fair", "mean_clarity", "n_reviewers",
        "bad_flags", "status")


@query("B12_published_items", RV + LATEST + """
SELECT question_id, 'mc' AS format FROM st WHERE status = 'kept'""")
def _(spark, sf):
    kept = reviews.published(reviewed(spark, sf))
    assert "status" not in kept.columns and "key_agreement" not in kept.columns
    return kept.select("question_id", "format")


@query("D13_validation_report", RV + LATEST + OPEN_LATEST + f"""
, al AS (SELECT 'mc' AS format, question_id, status FROM st
  UNION ALL SELECT 'open', question_id, status FROM so),
hd AS (SELECT *, row_number() OVER (PARTITION BY format, question_id % 6
    ORDER BY sha256('{SEED}|' || question_id), question_id)
  <= round_even((count(*) OVER (PARTITION BY format, question_id % 6)) * 0.2, 0) AS h
  FROM al WHERE status = 'kept')
SELECT format, count(*) AS candidates, count(*) FILTER (status = 'kept') AS kept,
  count(*) FILTER (status = 'rejected') AS rejected,
  count(*) FILTER (status = 'unreviewed') AS unreviewed,
  (SELECT count(*) FROM hd WHERE hd.format = al.format AND NOT h) AS public,
  (SELECT count(*) FROM hd WHERE hd.format = al.format AND h) AS holdout FROM al GROUP BY format""")
def _(spark, sf):
    cols = ["format", "question_id", "status"]
    both = reviewed(spark, sf).withColumn("format", F.lit("mc")).select(*cols).unionByName(
        reviewed_open(spark, sf).withColumn("format", F.lit("open")).select(*cols))
    kept = both.where("status = 'kept'").withColumn("stratum", F.col("question_id") % 6)
    sides = bank.stratified_holdout(kept, HOLDOUT, SEED, ("format", "stratum"))
    return reviews.validation_report(both, sides)


@query("D13_drop_reasons", RV + LATEST + """
SELECT question_id, status, n AS n_reviewers FROM st WHERE status <> 'kept'""")
def _(spark, sf):
    return reviews.drop_reasons(reviewed(spark, sf)).select(
        "question_id", "status", "n_reviewers")


@query("D13_unreviewed_ids", RV + LATEST + """
SELECT question_id FROM st WHERE status = 'unreviewed'""")
def _(spark, sf):
    return reviews.unreviewed_ids(reviewed(spark, sf))


@query("E11_modal_panel", RV + LATEST + """
, n AS (SELECT n AS raters, count(*) AS units FROM pn WHERE n > 0 GROUP BY n)
SELECT raters, units FROM n ORDER BY units DESC, raters LIMIT 1""")
def _(spark, sf):
    modal = reviews.modal_panel(reviews.answer_ratings(valid_items(spark, sf), latest(spark, sf)))
    sizes = modal.groupBy("unit").agg(F.count("*").alias("raters"))
    return sizes.groupBy("raters").agg(F.count("*").alias("units"))


@query("F9_fleiss_kappa", RV + LATEST + """
, md AS (SELECT n FROM pn WHERE n > 0 GROUP BY n ORDER BY count(*) DESC, n LIMIT 1),
ra AS (SELECT lt.question_id AS u, CASE WHEN differs THEN (lt.k + 1) % 4 ELSE lt.k END AS c FROM lt
  JOIN pn ON pn.question_id = lt.question_id JOIN md ON md.n = pn.n WHERE NOT lost),
ct AS (SELECT u, c, count(*) AS x FROM ra GROUP BY ALL),
un AS (SELECT u, sum(x) AS n, sum(x * x) AS sq FROM ct GROUP BY u),
wh AS (SELECT count(*) AS units, max(n) AS n, avg((sq - n) / (n * (n - 1))) AS p FROM un),
ch AS (SELECT sum((t / (units * n)) ^ 2) AS pe FROM (SELECT c, sum(x) AS t FROM ct GROUP BY c), wh)
SELECT units, n::BIGINT AS raters, round((p - pe) / (1 - pe), 6) AS kappa FROM wh, ch""")
def _(spark, sf):
    modal = reviews.modal_panel(reviews.answer_ratings(valid_items(spark, sf), latest(spark, sf)))
    return reliability.fleiss_kappa(modal, reviews.KAPPA_CATEGORIES)


@query("C3_review_jobs", using("items") + f"""
SELECT p_partkey AS question_id, 'reviewer' || r AS persona
FROM items, range({REVIEWERS}) t(r) WHERE {VALID}""")
def _(spark, sf):
    people = spark.createDataFrame([(f"reviewer{i}",) for i in range(REVIEWERS)],
                                   "persona string")
    return worklist.review_jobs(valid_items(spark, sf).select("question_id"), people)


# ---- model-written item text -----------------------------------------------------------

def shard_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Shard texts with fences, prose, pretty-printed and broken objects."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    text = F.concat(
        F.lit('```json\n{"id": '), k, F.lit(', "name": "'), name, F.lit('"}\n```\nHere it is\n{\n'),
        F.lit('  "id": -'), k, F.lit(',\n  "note": {"size": '), F.col("p_size").cast("string"),
        F.lit("}\n}\n\n"), F.when(F.col("p_partkey") % 5 == 0, F.lit('{"id": broken\n'))
        .otherwise(F.lit("[1, 2]\n")))
    return table(spark, sf, "part").select("p_partkey", text.alias("text"))


@query("A3_shard_objects", """
SELECT p_partkey, unnest([0, 1])::BIGINT AS pos, unnest([p_partkey, -p_partkey]) AS id,
  unnest([NULL, p_size])::BIGINT AS size FROM part""")
def _(spark, sf):
    found = shards.split_objects(shard_texts(spark, sf), "p_partkey")
    v = F.try_parse_json("json")
    return found.select("p_partkey", "pos", F.try_variant_get(v, "$.id", "bigint").alias("id"),
                        F.try_variant_get(v, "$.note.size", "bigint").alias("size"))


@query("A3_objects_of_files", """
SELECT unnest([p_partkey, -p_partkey]) AS id, unnest([NULL, p_size])::BIGINT AS size FROM part""")
def _(spark, sf):
    # the same texts as files; what never closes would swallow the texts after it
    closed = F.replace("text", F.lit("broken\n"), F.lit("broken}\n"))
    path = scratch_path(spark, "shards")
    shard_texts(spark, sf).select(closed.alias("value")).write.text(path)
    v = F.try_parse_json("json")
    return shards.read_objects(spark, path).select(
        F.try_variant_get(v, "$.id", "bigint").alias("id"),
        F.try_variant_get(v, "$.note.size", "bigint").alias("size"))


def array_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Responses holding item arrays: clean, fenced, broken, or none; some nest deeply."""
    k = F.col("p_partkey")
    a = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "t": "x"}'))
    levels = (1 + k % 25).cast("int")
    b = F.concat(F.lit('{"id": -'), k.cast("string"), F.lit(', "in": '),
                 F.repeat(F.lit('{"d": '), levels), F.lit("1"), F.repeat(F.lit("}"), levels), F.lit("}"))
    text = (F.when(k % 4 == 0, F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]")))
             .when(k % 4 == 1, F.concat(F.lit("Sure:\n```json\n["), a, F.lit("]\n``` done")))
             .when(k % 4 == 2, F.concat(F.lit("["), a, F.lit(" oops "), b, F.lit(", {bad}]")))
             .otherwise(F.lit("no items today")))
    return table(spark, sf, "part").select("p_partkey", text.alias("text"))


@query("A5_array_items", """
SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] WHEN 2 THEN [0, 1]
    ELSE [] END)::BIGINT AS pos,
  unnest(CASE p_partkey % 4 WHEN 0 THEN [p_partkey, -p_partkey] WHEN 1 THEN [p_partkey]
    WHEN 2 THEN [p_partkey, -p_partkey] ELSE [] END) AS id FROM part""")
def _(spark, sf):
    rows = shards.with_array_items(array_texts(spark, sf), "text", "items").select(
        "p_partkey", F.posexplode("items").alias("pos", "json"))
    return rows.select("p_partkey", "pos", F.try_variant_get(
        F.try_parse_json("json"), "$.id", "bigint").alias("id"))
