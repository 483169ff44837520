"""Registered queries: sources, sinks, work lists, response text, call metadata, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit import schemas
from assaykit.functions import calls as call_fns
from assaykit.functions.answers import answer_letter, harness_letter, letter_matches_key
from assaykit.functions.text import LETTERS, utc, without_reasoning
from assaykit.operators import panel, scoring, worklist
from assaykit.operators.bank import sample_keys
from assaykit.plans import analysis, bank, mc
from assaykit.plans import open as open_plans
from assaykit.plans.fixtures import ANSWER_CHOICES, ANSWERS, fixture, table
from assaykit.plans.registry import SCORED, SEED, query, using
from assaykit.session import cut_lineage, scratch_path, stored
from assaykit.sources import jsonl, tables
from assaykit.streaming import intake, waves

RUNS = 3
FRACTION = 0.25
AT = using("answer_text")
CL = using("calls")


# ---- sources and sinks -------------------------------------------------------------

@query("A1_jsonl_scan", using("items") + """
SELECT p_partkey::VARCHAR AS question_id, format, axis, dimension, difficulty, question,
  answer_index::BIGINT AS answer_index, array_to_string(choices, '|') AS choices, source FROM items""")
def _(spark, sf):
    path = scratch_path(spark, "items")
    rows = bank.items(spark, sf).withColumn("question_id", F.col("p_partkey").cast("string"))
    jsonl.write_jsonl(rows.drop("pack", "d", "p_partkey"), path)
    return jsonl.read_jsonl(spark, path, schemas.ITEM_MC).select(
        "question_id", "format", "axis", "dimension", "difficulty", "question", "answer_index",
        F.array_join("choices", "|").alias("choices"), "source")


@query("A2_jsonl_sink", """
SELECT count(*) AS written, count(*) AS read_back, sum(length(text))::BIGINT AS chars,
  count(*) AS with_null_key FROM documents""")
def _(spark, sf):
    path = scratch_path(spark, "documents")
    rows = table(spark, sf, "documents").withColumn("nothing", F.lit(None).cast("string"))
    written = jsonl.write_jsonl(rows, path)
    back = jsonl.read_lines(spark, path)
    return back.agg(
        F.lit(written).alias("written"), F.count("*").alias("read_back"),
        F.sum(F.length(F.get_json_object("value", "$.text"))).alias("chars"),
        F.count_if(F.array_contains(F.json_object_keys("value"), "nothing"))
        .alias("with_null_key"))


@query("A6_atomic_replace", """
SELECT count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier""")
def _(spark, sf):
    root = scratch_path(spark, "suppliers")
    suppliers = table(spark, sf, "supplier")
    tables.replace_table(suppliers.where("s_suppkey % 2 = 0"), root)
    tables.replace_table(suppliers, root)
    return tables.current_table(spark, root).agg(
        F.count("*").alias("n"), F.sum("s_acctbal").alias("balance"))


@query("A8_run_configuration", """
WITH live(phase, name, live) AS (VALUES ('mc', 'effort', 'low'), ('mc', 'runs', '5'),
  ('open', 'effort', 'high'), ('open', 'runs', '3'))
SELECT n_name AS run_id, phase, name,
  CASE WHEN phase = 'mc' AND name = 'effort' THEN 'effort-' || n_regionkey
    WHEN phase = 'open' AND n_nationkey % 2 = 0 AND name = 'runs' THEN n_nationkey::VARCHAR
    ELSE live END AS value,
  CASE WHEN (phase = 'mc' AND name = 'effort')
    OR (phase = 'open' AND n_nationkey % 2 = 0 AND name = 'runs') THEN 'run manifest'
    ELSE 'live configuration' END AS provenance FROM nation, live""")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    live = spark.createDataFrame(
        [("mc", "effort", "low"), ("mc", "runs", "5"), ("open", "effort", "high"),
         ("open", "runs", "3")], "phase string, name string, value string")
    region = F.col("n_regionkey").cast("string")

    def entry(phase, at, settings):
        return nation.select(F.col("n_name").alias("run_id"), "n_nationkey",
                             F.lit(phase).alias("phase"), F.lit(at).alias("written_at"),
                             settings.alias("settings"))

    manifest = (
        entry("mc", "2025-01-01T00:00:00Z", F.create_map(F.lit("effort"), F.lit("stale")))
        .unionByName(entry("mc", "2025-01-02T00:00:00Z", F.create_map(
            F.lit("effort"), F.concat(F.lit("effort-"), region))))
        .unionByName(entry("open", "2025-01-02T00:00:00Z", F.create_map(
            F.lit("runs"), F.col("n_nationkey").cast("string"))).where("n_nationkey % 2 = 0")))
    return tables.stamp_configuration(live, manifest.drop("n_nationkey"))


# Tiers in two sessions stand for models and runs, so that most items are complete.
@query("A9_summary_sections", using("responses", "cohort", "judge_base") + SCORED.replace(
    "sc AS", "rs AS").replace("FROM sc", "FROM rs") + mc.DENSE.replace("FROM sc", "FROM rs")
    + open_plans.PANEL + open_plans.OPEN_MEANS + open_plans.COMPLETE + """,
ti AS (SELECT DISTINCT tier, question_id, dimension, difficulty, axis FROM rs),
tp AS (SELECT x.tier AS a, y.tier AS b, count(*) AS n FROM ti x JOIN ti y
  ON x.question_id = y.question_id AND x.tier < y.tier GROUP BY ALL)
SELECT 'mc_overall' AS section, count(DISTINCT tier) AS n_rows, count(*)::DOUBLE AS total FROM ti
UNION ALL SELECT 'mc_by', (SELECT count(*) FROM (SELECT DISTINCT tier, dimension FROM ti))
  + (SELECT count(*) FROM (SELECT DISTINCT tier, difficulty FROM ti))
  + (SELECT count(*) FROM (SELECT DISTINCT tier, axis FROM ti)), 3.0 * count(*) FROM ti
UNION ALL SELECT 'mc_pairwise', count(*), sum(n) FROM tp
UNION ALL SELECT 'mc_items', count(*), sum(n_resp) FROM ia
UNION ALL SELECT 'open_overall', count(*), sum(n) FROM om JOIN cohort USING (model)
UNION ALL SELECT 'open_by_dim', (SELECT count(*) FROM (SELECT DISTINCT model, dimension FROM sc
    WHERE composite_100 IS NOT NULL)), count(*) FROM oi
UNION ALL SELECT 'open_judge_dims', (SELECT count(*) FROM (UNPIVOT (SELECT DISTINCT model,
    max(accuracy) AS accuracy, max(voice) AS voice, max(wisdom) AS wisdom, max(distinct_) AS d FROM sc
    GROUP BY model) ON accuracy, voice, wisdom, d INTO NAME k VALUE v)), (SELECT count(DISTINCT model) FROM sc)
UNION ALL SELECT 'open_pairwise', count(*), sum(n) FROM (SELECT a, b, count(*) AS n FROM po GROUP BY ALL)
UNION ALL SELECT 'judge_irr', 1, (SELECT count(DISTINCT (model, question_id, run_index)) FROM cr)""")
def _(spark, sf):
    log = mc.classified(spark, sf).select(
        F.col("tier").alias("model"), (F.col("run_index") % 2).alias("run_index"), "question_id", "correct",
        "parse_ok", "call_class", mc.sequence().alias("seq"))
    tiers = table(spark, sf, "region").select(
        F.col("r_name").alias("model"), F.col("r_name").alias("label"), F.col("r_name").alias("tier"),
        F.lit(None).cast("double").alias("generation"), F.col("r_regionkey").alias("ord"))
    rated = cut_lineage(open_plans.verdicts(spark, sf).drop("text"))     # the judges' texts are read once
    sections = analysis.summary(
        stored(scoring.cell_table(log, "seq"), "cells"), fixture(spark, sf, "bank"),
        stored(open_plans.panels(rated), "panels"),
        stored(panel.last_complete(rated, open_plans.DIMS, "seq"), "ratings"), tiers, open_plans.DIMS,
        mc.cohort(spark, sf), resamples=200)
    root = scratch_path(spark, "summary")
    tables.publish(sections, root, "run")
    found = tables.published(spark, root, "run")
    totals = {"mc_pairwise": F.sum("n_items"), "mc_items": F.sum("n_resp"), "open_pairwise": F.sum("n_items"),
              "open_judge_dims": F.count_if("weakest"), "judge_irr": F.sum("n_units")}
    parts = [df.agg(F.lit(n).alias("section"), F.count("*").alias("n_rows"),
                    totals.get(n, F.sum("n") if "n" in df.columns else F.lit(0)).cast("double").alias("total"))
             for n, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- work lists -----------------------------------------------------------------------

@query("C1_work_grid", using("items", "cohort") + f"""
SELECT p_partkey AS question_id, model, r AS run_index FROM items, cohort, range({RUNS}) t(r)
WHERE {bank.VALID}""")
def _(spark, sf):
    return worklist.work_grid(bank.valid_items(spark, sf).select("question_id"),
                              mc.cohort(spark, sf), RUNS)


PEOPLE = [("strict",), ("lenient",), ("expert",)]


@query("C2_judge_jobs", AT + """
SELECT conv_id, turn, persona FROM answer_text,
  (VALUES ('strict'), ('lenient'), ('expert')) p(persona) WHERE t % 3 <> 0""")
def _(spark, sf):
    r = fixture(spark, sf, "answer_text").select(
        "conv_id", "turn", F.lit("m").alias("model"), F.col("conv_id").alias("question_id"),
        F.col("turn").alias("run_index"), F.when(F.col("t") % 3 == 0, "").otherwise(
            F.col("text")).alias("text"))
    jobs = worklist.judge_jobs(r, spark.createDataFrame(PEOPLE, "persona string"))
    return jobs.select("conv_id", "turn", "persona")


# One cache entry per key: the last event's outcome.
CACHE = """, ca AS (SELECT key, arg_max(call_ok, event_id) AS ok, arg_max(model, event_id) AS model,
    arg_max(struct_pack(s := model_served), event_id).s AS served FROM calls GROUP BY key),
go AS (SELECT key, ok AND (served IS NULL OR served = model OR served = model || '-20250101') AS hit
  FROM ca)"""


def jobs_and_cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    log = fixture(spark, sf, "calls")
    jobs = log.select("key", "model").distinct()
    cache = (log.groupBy("key").agg(F.max_by(F.struct(
        F.col("call_ok").alias("ok"), F.when(F.col("event_id") % 4 != 0, F.col("model"))
        .alias("model_requested"), "model_served", F.col("props").alias("text")), "event_id")
        .alias("c")).select("key", "c.*"))
    return jobs, cache


@query("C4_reused_work", CL + CACHE + " SELECT key, hit AS cache_hit FROM go")
def _(spark, sf):
    return worklist.reuse(*jobs_and_cache(spark, sf)).select("key", "cache_hit")


@query("C4_outstanding_work", CL + CACHE + " SELECT key FROM go WHERE NOT hit")
def _(spark, sf):
    return worklist.outstanding(*jobs_and_cache(spark, sf)).select("key")


SAMPLED = f""", kd AS (SELECT DISTINCT model, question_id, run_index FROM responses WHERE call_ok),
sm AS (SELECT *, row_number() OVER (ORDER BY sha256(concat_ws('|', '{SEED}', model, question_id,
    run_index)), model, question_id, run_index)
  <= round_even((count(*) OVER ()) * {FRACTION}, 0) AS taken FROM kd)"""


@query("E10_exact_sample", using("responses") + SAMPLED + """
SELECT model, question_id, run_index::BIGINT AS run_index FROM sm WHERE taken""")
def _(spark, sf):
    keys = scoring.completed(mc.responses(spark, sf)).select("model", "question_id", "run_index")
    return sample_keys(keys, FRACTION, SEED)


@query("C9_crosscheck_jobs", using("responses") + SAMPLED + """
SELECT model, question_id, run_index::BIGINT AS run_index, persona FROM sm,
  (VALUES ('strict'), ('lenient'), ('expert')) p(persona) WHERE taken""")
def _(spark, sf):
    r = mc.responses(spark, sf).withColumn("text", F.when(F.col("call_ok"), "x").otherwise(""))
    return worklist.crosscheck_jobs(r, spark.createDataFrame(PEOPLE, "persona string"),
                                    FRACTION, SEED)


@query("C12_missing_work", using("responses", "items", "cohort") + f"""
SELECT p_partkey AS question_id, model, r AS run_index FROM items, cohort, range({RUNS}) t(r)
WHERE {bank.VALID} AND NOT EXISTS (SELECT 1 FROM responses x WHERE x.question_id = p_partkey
  AND x.model = cohort.model AND x.run_index = r)""")
def _(spark, sf):
    return worklist.missing_runs(bank.valid_items(spark, sf), mc.cohort(spark, sf),
                                 mc.responses(spark, sf), RUNS)


@query("C12_missing_by_model", using("responses", "items", "cohort") + f"""
SELECT model, count(*) AS n_missing, count(DISTINCT p_partkey) AS n_items
FROM items, cohort, range({RUNS}) t(r)
WHERE {bank.VALID} AND NOT EXISTS (SELECT 1 FROM responses x WHERE x.question_id = p_partkey
  AND x.model = cohort.model AND x.run_index = r) GROUP BY model""")
def _(spark, sf):
    gaps = worklist.missing_runs(bank.valid_items(spark, sf), mc.cohort(spark, sf),
                                 mc.responses(spark, sf), RUNS)
    # one row per (model, item) before the distinct count
    cells = gaps.groupBy("model", "question_id").agg(F.count("*").alias("n"))
    return cells.groupBy("model").agg(F.sum("n").alias("n_missing"), F.count("*").alias("n_items"))


# ---- response text -----------------------------------------------------------------------

def answers(spark: SparkSession, sf: str) -> DataFrame:
    options = F.slice(F.array(*[F.lit(c) for c in ANSWER_CHOICES]), F.lit(1), F.col("n_choices"))
    return fixture(spark, sf, "answer_text").withColumn("choices", options)


@query("G1_answer_letters", AT + """
SELECT conv_id, turn, t::BIGINT AS template, expected AS letter FROM answer_text""")
def _(spark, sf):
    return answers(spark, sf).select(
        "conv_id", "turn", F.col("t").alias("template"),
        answer_letter(F.col("text"), F.col("n_choices"), F.col("choices")).alias("letter"))


@query("G2_correctness", AT + """
SELECT conv_id, turn, coalesce(instr('ABCDEFGH', expected) - 1 = answer_index, false) AS correct
FROM answer_text""")
def _(spark, sf):
    letter = answer_letter(F.col("text"), F.col("n_choices"), F.col("choices"))
    return answers(spark, sf).select(
        "conv_id", "turn", letter_matches_key(letter, F.col("answer_index")).alias("correct"))


def answer_bank(spark: SparkSession, sf: str) -> DataFrame:
    """The items behind the answer texts: one per template and key."""
    return answers(spark, sf).select(
        (F.col("t") * 4 + F.col("answer_index")).alias("question_id"), "choices",
        F.col("answer_index").cast("int").alias("answer_index")).distinct()


def answer_log(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select(
        "conv_id", "turn",
        F.concat(F.lit("m"), (F.col("conv_id") % 5).cast("string")).alias("model"),
        (F.col("t") * 4 + F.col("answer_index")).alias("question_id"),
        ((F.col("conv_id") + F.col("turn")) % 9 != 0).alias("call_ok"), "text")


SCORED_TEXT = """, s AS (SELECT conv_id, turn, 'm' || (conv_id % 5) AS model, (conv_id + turn) % 9 <> 0 AS call_ok,
  CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL ELSE expected END AS parsed_letter, answer_index
  FROM answer_text)"""


@query("C5_score_responses", AT + SCORED_TEXT + """
SELECT conv_id, turn, call_ok, parsed_letter, parsed_letter IS NOT NULL AS parse_ok,
  coalesce(instr('ABCDEFGH', parsed_letter) - 1 = answer_index, false) AS correct FROM s""")
def _(spark, sf):
    return scoring.score_responses(answer_log(spark, sf), answer_bank(spark, sf)).select(
        "conv_id", "turn", "call_ok", "parsed_letter", "parse_ok", "correct")


# The harness rule knows only "ANSWER: X": its letters by template.
HARNESS = {i: t.rsplit("ANSWER: ", 1)[1].lstrip("(")[0] for i, (t, _, _) in enumerate(ANSWERS)
           if "ANSWER: " in t and t.rsplit("ANSWER: ", 1)[1].lstrip("(")[0] in LETTERS}
HARNESS_CASE = "CASE t " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in HARNESS.items()) + " END"


@query("G17_harness_letters", AT + f"""
SELECT conv_id, turn, {HARNESS_CASE} AS harness,
  {HARNESS_CASE} IS NOT DISTINCT FROM expected AS agrees FROM answer_text""")
def _(spark, sf):
    full = answer_letter(F.col("text"), F.col("n_choices"), F.col("choices"))
    rows = answers(spark, sf).select("conv_id", "turn", full.alias("full"),
                                     harness_letter(F.col("text")).alias("harness"))
    return rows.select("conv_id", "turn", "harness",
                       F.col("harness").eqNullSafe(F.col("full")).alias("agrees"))


@query("G17_harness_mean", AT + f"""
SELECT 'm' || (conv_id % 5) AS model, count(*) AS n,
  round(avg(CASE WHEN {HARNESS_CASE} = substr('ABCDEFGH', CAST(answer_index AS INT) + 1, 1)
    THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM answer_text GROUP BY 1""")
def _(spark, sf):
    model = F.concat(F.lit("m"), (F.col("conv_id") % 5).cast("string"))
    return scoring.harness_mean(answers(spark, sf).withColumn("model", model), ["model"])


@query("G1_letters_whole_text", AT + """
SELECT conv_id, turn, expected AS letter FROM answer_text""")
def _(spark, sf):
    # a restated choice counts anywhere in the response, not only in its closing characters
    return answers(spark, sf).select("conv_id", "turn", answer_letter(
        F.col("text"), F.col("n_choices"), F.col("choices"), tail_chars=None).alias("letter"))


@query("G13_without_reasoning", """
SELECT conv_id, turn, md5(regexp_replace(CASE WHEN turn % 3 = 0 THEN text
  ELSE ' tail ' || text END, '^\\s+|\\s+$', '', 'g')) AS digest FROM conversations""")
def _(spark, sf):
    raw = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat(
        F.lit("<think>a</think> b "), F.col("text"), F.lit("</think> tail "), F.col("text")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(without_reasoning(raw)).alias("digest"))


# ---- call metadata ----------------------------------------------------------------------

@query("G8_served_matches", CL + """
SELECT event_id, event_id % 5 <> 1 AS ok, event_id % 5 <> 1 AS ok_reversed FROM calls""")
def _(spark, sf):
    m, s = F.col("model"), F.col("model_served")
    return fixture(spark, sf, "calls").select(
        "event_id", call_fns.served_ok(m, s).alias("ok"),
        call_fns.served_ok(F.coalesce(s, m), m).alias("ok_reversed"))


@query("G9_dominant_model", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'main'
    WHEN event_id % 10 > event_id % 7 THEN 'main' WHEN event_id % 10 < event_id % 7 THEN 'helper'
    WHEN value >= 10 THEN 'main' ELSE 'helper' END AS model,
  CASE WHEN event_id % 6 > 1 THEN 'main,helper' END AS all_models
FROM events""")
def _(spark, sf):
    def use(tokens, cost):
        return F.struct(tokens.cast("bigint").alias("outputTokens"), cost.alias("costUSD"))

    k, v = F.col("event_id"), F.col("value")
    main, helper = use(k % 10, v), use(k % 7, F.lit(10.0))
    kind = "map<string,struct<outputTokens:bigint,costUSD:double>>"
    usage = (F.when(k % 6 == 0, F.create_map().cast(kind))
              .when(k % 6 == 1, F.create_map(F.lit("main"), main))
              .otherwise(F.create_map(F.lit("main"), main, F.lit("helper"), helper)))
    return table(spark, sf, "events").select(
        "event_id", call_fns.dominant_model(usage).alias("model"),
        call_fns.all_models(usage).alias("all_models"))


@query("G10_retry_list", CL + """
SELECT event_id, event_id % 3 <> 0 AS permanent FROM calls WHERE NOT call_ok""")
def _(spark, sf):
    markers = spark.createDataFrame([("served_mismatch",), ("HTTP 401",)], "marker string")
    return worklist.retry_list(fixture(spark, sf, "calls"), markers).select("event_id", "permanent")


@query("G11_work_keys", using("items") + """
SELECT p_partkey, sha256('{"b":"api","e":"low","m":"' || dimension || '","p":"' || choices[1]
  || '","r":' || (p_partkey % 5) || ',"s":"sys"}') AS key FROM items""")
def _(spark, sf):
    return bank.items(spark, sf).select("p_partkey", call_fns.work_key(
        F.lit("api"), F.col("dimension"), F.lit("sys"), F.get("choices", F.lit(0)),
        F.lit("low"), F.col("p_partkey") % 5).alias("key"))


@query("G12_next_effort", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' WHEN 2 THEN 'xhigh'
  WHEN 3 THEN 'max' WHEN 4 THEN 'max' ELSE 'high' END AS effort FROM events""")
def _(spark, sf):
    names = F.array(*[F.lit(e) for e in (*call_fns.EFFORTS, "unheard-of")])
    return table(spark, sf, "events").select("event_id", call_fns.next_effort(
        F.get(names, (F.col("event_id") % 6).cast("int"))).alias("effort"))


@query("G19_call_stamps", """
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS called_at FROM events""")
def _(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select(
        "event_id", F.unix_timestamp(utc(stamp)).alias("called_at"))


@query("G20_report_rounding", """
SELECT l_orderkey % 100 AS bucket, round_even(avg(l_discount), 4) AS four,
  round_even(avg(l_tax), 3) AS three, round_even(avg(l_quantity) / 1000, 5) AS five
FROM lineitem GROUP BY 1""")
def _(spark, sf):
    # exact sums: the inputs have two decimals
    def mean(c):
        return F.sum(F.round(F.col(c) * 100).cast("bigint")) / F.count("*") / 100

    return (table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("bucket"))
            .agg(F.bround(mean("l_discount"), 4).alias("four"),
                 F.bround(mean("l_tax"), 3).alias("three"),
                 F.bround(mean("l_quantity") / 1000, 5).alias("five")))


# ---- streams --------------------------------------------------------------------------------

def land(df: DataFrame, spark: SparkSession, name: str, files: int, *by: str) -> str:
    """Write a table as the files a stream will pick up."""
    path = scratch_path(spark, name)
    (df.repartitionByRange(files, *by) if by else df.repartition(files)).write.parquet(path)
    return path


@query("J1_stream_scoring", AT + SCORED_TEXT + """
SELECT conv_id, turn, call_ok, parsed_letter, parsed_letter IS NOT NULL AS parse_ok,
  coalesce(instr('ABCDEFGH', parsed_letter) - 1 = answer_index, false) AS correct FROM s""")
def _(spark, sf):
    log = answer_log(spark, sf)
    source = land(log, spark, "responses", 4)
    stream = intake.response_stream(spark, source, log.schema, "parquet", 2)
    out, mark = scratch_path(spark, "scored"), scratch_path(spark, "mark")
    scored = intake.score_stream(stream, stored(answer_bank(spark, sf), "bank"))
    intake.run_available(scored.select("conv_id", "turn", "call_ok", "parsed_letter",
                                       "parse_ok", "correct"), out, mark)
    return spark.read.parquet(out)


@query("J2_stream_progress", using("responses") + """
SELECT model, count(*) AS done, count(*) FILTER (call_ok AND correct) AS hits,
  count(*) FILTER (call_ok AND NOT parse_ok) AS unparsed, count(*) FILTER (NOT call_ok) AS failed,
  sum(cost_micro)::BIGINT AS cost_micro FROM responses GROUP BY model""")
def _(spark, sf):
    log = mc.responses(spark, sf).select("model", "call_ok", "correct", "parse_ok", "cost_micro")
    source = land(log, spark, "log", 4)
    stream = intake.response_stream(spark, source, log.schema, "parquet", 2)
    out, mark = scratch_path(spark, "progress"), scratch_path(spark, "mark")
    intake.run_progress(stream, out, mark)
    return intake.current_progress(spark.read.parquet(out))


def timed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("model"),
        F.concat_ws("-", "user_id", "event_type").alias("key"), "event_id")


@query("J2_stream_rate", """
SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type AS model,
  count(*) AS done FROM events GROUP BY 1, 2""")
def _(spark, sf):
    log = timed(spark, sf)
    source = land(log, spark, "timed", 4, "at")
    # all files in one batch, so nothing is late
    stream = intake.response_stream(spark, source, log.schema, "parquet")
    out, mark = scratch_path(spark, "rate"), scratch_path(spark, "mark")
    intake.run_updates(intake.rate(stream, "at", "1 day", "2 hours"), out, mark)
    return intake.latest(spark.read.parquet(out), "start", "model").select(F.unix_timestamp("start").alias("start"), "model",
                                          "done")


# Events come in four waves by time; every tenth comes one wave late.
@query("J2_stream_late", """
WITH r AS (SELECT epoch(min(ts))::BIGINT AS lo, epoch(max(ts))::BIGINT AS hi FROM events),
e AS (SELECT ts, event_type AS model, least(3, (epoch(ts)::BIGINT - lo) * 4 // (hi - lo + 1)
    + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS wave FROM events, r),
w AS (SELECT x.wave, max(y.ts) - INTERVAL 2 DAY AS mark
  FROM (SELECT DISTINCT wave FROM e) x LEFT JOIN e y ON y.wave < x.wave GROUP BY 1),
l AS (SELECT model, time_bucket(INTERVAL 1 DAY, ts) AS start,
    coalesce(time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= mark, false) AS late
  FROM e JOIN w USING (wave))
SELECT epoch(start)::BIGINT AS start, model, count(*) FILTER (NOT late) AS done, count(*) FILTER (late) AS late
FROM l GROUP BY 1, 2""")
def _(spark, sf):
    seconds = F.unix_timestamp("at")
    log = timed(spark, sf).select("model", "at", "event_id")
    ends = log.agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi")).first()
    quarter = F.floor((seconds - ends.lo) * 4 / (ends.hi - ends.lo + 1))
    wave = F.least(F.lit(3), quarter + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    source = scratch_path(spark, "timed")
    out, mark = scratch_path(spark, "late"), scratch_path(spark, "mark")
    for number in range(4):
        log.where(wave == number).select("model", "at").write.mode("append").parquet(source)
        intake.run_rate(intake.response_stream(spark, source, "model string, at timestamp", "parquet"),
                        out, mark, "at", "1 day", "2 DAY")
    return intake.rates(spark, out).select(F.unix_timestamp("start").alias("start"), "model", "done", "late")


@query("J3_stream_once_per_key", """
SELECT DISTINCT concat(user_id, '-', event_type) AS key FROM events""")
def _(spark, sf):
    log = timed(spark, sf)
    source = land(log.unionByName(log), spark, "replayed", 4)
    stream = intake.response_stream(spark, source, log.schema, "parquet", 2)
    out, mark = scratch_path(spark, "once"), scratch_path(spark, "mark")
    intake.run_available(intake.once_per_key(stream, "key", "at", "60 days").select("key"),
                         out, mark)
    return spark.read.parquet(out)


@query("J4_stream_waves", """
WITH e AS (SELECT event_id % 4 AS wave, event_id % 7 = 0 AS bad, event_id % 91 = 1 AS corrupt FROM events),
w AS (SELECT wave, count(*) AS n, count(*) FILTER (bad AND NOT corrupt) AS f,
  count(*) FILTER (corrupt) AS c FROM e GROUP BY wave),
r AS (SELECT wave + 1 AS waves, (sum(n) OVER o)::BIGINT AS have, (sum(f) OVER o + sum(c) OVER o
  + greatest(0, (SELECT count(*) FROM events) - sum(n) OVER o))::BIGINT AS strict_fail
  FROM w WINDOW o AS (ORDER BY wave))
SELECT waves, have, strict_fail, strict_fail AS accept_fail, CASE WHEN strict_fail = 0 THEN 'clean'
  WHEN waves >= 3 AND strict_fail = 0 THEN 'clean_quorum' WHEN waves >= 40 THEN 'give_up'
  ELSE 'continue' END AS decision FROM r""")
def _(spark, sf):
    k = F.col("event_id")
    body = F.to_json(F.struct("event_id", (k % 7 != 0).alias("call_ok")))
    log = table(spark, sf, "events").select(
        (k % 4).alias("wave"),
        F.when(k % 91 == 1, F.lit("{cut")).otherwise(body).alias("value"))
    source = scratch_path(spark, "waves")
    counts, mark = scratch_path(spark, "counts"), scratch_path(spark, "mark")
    expected = table(spark, sf, "events").count()
    for wave in range(4):  # a wave lands in many files and is read as one micro-batch
        log.where(F.col("wave") == wave).select("value").write.mode("append").parquet(source)
        intake.run_waves(intake.response_stream(spark, source, "value string", "parquet"),
                         counts, mark)
        if intake.finished(intake.wave_states(spark.read.parquet(counts), expected)):
            break
    return intake.wave_states(spark.read.parquet(counts), expected)


# Three personas judge every order's response, one per wave; a tolerable rest fails.
WAVES = """
SELECT o_orderkey AS k, 'response' AS log, -1 AS persona, 'primary' AS role,
  CASE WHEN o_orderkey % 10 < 7 THEN 0 ELSE 1 END AS wave, true AS ok FROM orders
UNION ALL
SELECT o_orderkey, 'verdict', p, 'primary', p, NOT (p = 2 AND o_orderkey % 13 = 5)
FROM orders, (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2) x
UNION ALL
SELECT o_orderkey, 'verdict', 0, 'crosscheck', 1, true FROM orders WHERE o_orderkey % 4 = 0
UNION ALL
SELECT o_orderkey, 'verdict', 2, 'primary', 3, true FROM orders WHERE o_orderkey % 13 = 5"""


@query("J4_open_waves", f"""
WITH l AS ({WAVES}), n AS (SELECT count(*) AS expected FROM orders),
s AS (SELECT w, count(*) FILTER (log = 'response') AS gt, count(*) FILTER (log = 'verdict') AS jt,
    count(*) FILTER (log = 'verdict' AND NOT ok) AS jf
  FROM l, range(3) r(w) WHERE wave <= w GROUP BY w),
t AS (SELECT w, k, count(*) FILTER (ok) AS judges FROM l, range(3) r(w)
  WHERE wave <= w AND log = 'verdict' AND role = 'primary' GROUP BY w, k),
q AS (SELECT w, count(*) AS judged, count(*) FILTER (judges < 2) AS short FROM t GROUP BY w),
a AS (SELECT w + 1 AS waves, gt AS have, greatest(0, expected - gt) + jf + greatest(0, gt * 3 - jt) AS strict_fail,
    greatest(0, expected - gt) + short + greatest(0, gt - judged) AS accept_fail,
    short + greatest(0, gt - judged) AS below_quorum
  FROM s JOIN q USING (w), n)
SELECT *, CASE WHEN strict_fail = 0 THEN 'clean' WHEN waves >= 3 AND accept_fail = 0 THEN 'clean_quorum'
  ELSE 'continue' END AS decision FROM a""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    rows = spark.sql(WAVES.replace("FROM orders", "FROM {orders}"), orders=orders)
    scores = F.when(F.col("ok") & (F.col("log") == "verdict"), F.struct(F.lit(4).alias("accuracy")))
    log = rows.select("wave", "log", F.to_json(F.struct(
        F.lit("m").alias("model"), F.col("k").alias("question_id"), F.lit(0).alias("run_index"),
        "persona", F.col("role").alias("judge_role"), F.col("ok").alias("call_ok"),
        scores.alias("scores"))).alias("value"))
    source, mark = scratch_path(spark, "open-waves"), scratch_path(spark, "mark")
    run = waves.OpenWaves(spark, scratch_path(spark, "run"), orders.count(), 3, 2)
    for wave in range(4):       # the fourth would heal the rest, but the run has ended by then
        log.where(F.col("wave") == wave).select("log", "value").write.mode("append").parquet(source)
        waves.run_open_waves(intake.response_stream(spark, source, "log string, value string", "parquet"),
                             run, mark)
    return run.states()
