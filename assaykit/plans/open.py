"""Registered queries: judge verdicts, panels, open leaderboards, reliability, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.exact import UNIT
from assaykit.functions.judging import rating, tally, with_objects
from assaykit.operators import (audit, bootstrap, leaderboard, pairwise, panel, reliability,
                                scoring)
from assaykit.plans import analysis, mc
from assaykit.plans.fixtures import JUDGE_DIMS, fixture, table
from assaykit.plans.registry import MEAN, NEAR, SCORED, SEED, near_normal, query, using
from assaykit.session import computed_once, cut_lineage

J = using("judge_base")
DIMS = JUDGE_DIMS
NEEDED, PERSONAS, EXPECTED = 2, 3, 16000  # audit parameters of the registered queries

def mean_of(column: str) -> str:
    """SQL mean of a 0-100 column in exact units."""
    return f"(sum(CAST(round({column} / 100 * {UNIT}) AS BIGINT)) / count(*) / {UNIT} * 100)"


UNIT_MEAN = f"(sum(CAST(round(v * {UNIT}) AS BIGINT)) / count(*) / {UNIT})"

# Typed verdicts, last per judge, panels: from the numbers, not from the judge text.
TYPED = """, ty AS (SELECT *, CASE WHEN prose OR junk THEN NULL ELSE least(5, a)::DOUBLE END AS accuracy,
  CASE WHEN prose OR absent THEN NULL ELSE b::DOUBLE END AS voice,
  CASE WHEN prose THEN NULL ELSE c::DOUBLE END AS wisdom,
  CASE WHEN prose THEN NULL ELSE e::DOUBLE END AS distinct_,
  CASE WHEN prose OR seq % 23 = 0 THEN NULL ELSE least(hits, total)::DOUBLE END AS h,
  CASE WHEN prose OR seq % 23 = 0 THEN NULL ELSE total::DOUBLE END AS t,
  CASE WHEN prose OR viol < 0 THEN NULL ELSE viol::DOUBLE END AS v FROM judge_base)"""
PANEL = TYPED + """, la AS (SELECT model, question_id, run_index, persona, arg_max(dimension, seq) AS dimension,
  arg_max(struct_pack(accuracy, voice, wisdom, distinct_, h, t, v, prose), seq) AS r
  FROM ty WHERE role = 'primary' GROUP BY ALL),
pa AS (SELECT model, question_id, run_index, any_value(dimension) AS dimension,
  avg(r.accuracy) AS accuracy, avg(r.voice) AS voice, avg(r.wisdom) AS wisdom,
  avg(r.distinct_) AS distinct_, sum(r.h) / sum(r.t) AS cov, avg(r.v) AS viol,
  count(*) FILTER (NOT r.prose) AS n_judges FROM la GROUP BY model, question_id, run_index),
ps AS (SELECT *, list_avg(list_filter([accuracy, voice, wisdom, distinct_],
  lambda x: x IS NOT NULL)) AS five FROM pa),
sc AS (SELECT *, (five - 1) / 4 * 100 AS composite_100 FROM ps),
oi AS (SELECT model, question_id, """ + mean_of("composite_100") + """ AS p FROM sc
  WHERE composite_100 IS NOT NULL GROUP BY ALL)"""


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict rows with their payload, from the judges' text."""
    return panel.parse_verdicts(fixture(spark, sf, "judge_text"), DIMS)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Panel scores with the item's dimension."""
    return panels(verdicts(spark, sf).drop("text"))


def panels(rated: DataFrame) -> DataFrame:
    typed = panel.sanitise(panel.primary(rated).drop("call_ok"), DIMS)
    last = panel.last_per_judge(typed, "seq")
    meta = F.concat(F.lit("dim"), (F.col("question_id") % 4).cast("string"))
    return panel.panel_scores(last, DIMS).withColumn("dimension", meta)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict log lines; every 53rd is damaged and some predate the role field."""
    ratings = F.struct(*[F.col(c).alias(d) for c, d in zip("abce", DIMS, strict=True)])
    body = F.to_json(F.struct(
        "model", "question_id", "run_index", "persona",
        F.when(F.col("seq") % 3 != 0, F.col("role")).alias("judge_role"),
        (F.col("seq") % 59 != 0).alias("call_ok"), F.when(~F.col("prose"), ratings).alias("scores")))
    line = (F.when(F.col("seq") % 53 == 0, F.concat(F.lit("{truncated "), body))
            .when(F.col("seq") % 61 == 1, F.lit("   ")).otherwise(body))
    return fixture(spark, sf, "judge_base").select(computed_once(line).alias("value"))


def response_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One generation per order; some failed, damaged or without the flag."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(k.alias("question_id"),
                              F.when(k % 5 != 0, k % 50 != 1).alias("call_ok")))
    return o.select(F.when(k % 71 == 0, F.lit("{half")).otherwise(body).alias("value"))


@query("G3_judge_json", J + """
SELECT model, question_id, run_index, persona, role, seq, NOT prose AS parse_ok,
  CASE WHEN prose THEN NULL WHEN junk THEN 'N/A' ELSE CAST(a AS VARCHAR) END AS accuracy,
  CASE WHEN prose THEN NULL ELSE 'close} but {open' END AS justification FROM judge_base""")
def _(spark, sf):
    return verdicts(spark, sf).select(
        "model", "question_id", "run_index", "persona", F.col("judge_role").alias("role"), "seq",
        "parse_ok", F.try_variant_get("scores", "$.accuracy", "string").alias("accuracy"),
        F.try_variant_get("scores", "$.justification", "string").alias("justification"))


@query("G3_object_counts", J + """
SELECT model, count(*) AS n,
  sum(seq % 31 + CASE WHEN prose THEN 1 ELSE 3 END)::BIGINT AS n_objects
FROM judge_base GROUP BY model""")
def _(spark, sf):
    # up to 30 more flat objects, then one that never closes
    text = F.concat("text", F.repeat(F.lit(' {"x": "{"}'), (F.col("seq") % 31).cast("int")),
                    F.lit(" and {so on"))
    found = with_objects(fixture(spark, sf, "judge_text"), text, "spans")
    return found.groupBy("model").agg(
        F.count("*").alias("n"), F.sum(F.size("spans")).alias("n_objects"))


@query("G5_sanitised_numbers", J + TYPED + """
SELECT model, question_id, run_index, persona, role, seq, accuracy, voice,
  CASE WHEN prose THEN NULL WHEN seq % 23 = 0 THEN NULL ELSE hits::DOUBLE END AS hits,
  v AS violations FROM ty""")
def _(spark, sf):
    s = F.col("scores")
    return verdicts(spark, sf).select(
        "model", "question_id", "run_index", "persona", F.col("judge_role").alias("role"), "seq",
        rating(s, "accuracy").alias("accuracy"), rating(s, "voice").alias("voice"),
        tally(s, panel.HITS).alias("hits"), tally(s, panel.VIOLATIONS).alias("violations"))


@query("B11_primary_verdicts", J + """
SELECT persona, count(*) AS n FROM judge_base
WHERE coalesce(CASE WHEN seq % 3 = 0 AND role = 'primary' THEN NULL ELSE role END, 'primary')
  = 'primary' GROUP BY persona""")
def _(spark, sf):
    legacy = fixture(spark, sf, "judge_text").withColumn("judge_role", F.when(
        ~((F.col("seq") % 3 == 0) & (F.col("judge_role") == "primary")), F.col("judge_role")))
    return panel.primary(legacy).groupBy("persona").agg(F.count("*").alias("n"))


@query("D6_panel_scores", J + PANEL + """
SELECT model, question_id, run_index, round(accuracy, 6) AS accuracy, round(voice, 6) AS voice,
  round(wisdom, 6) AS wisdom, round(distinct_, 6) AS "distinct", round(five, 6) AS composite_5,
  round(composite_100, 6) AS composite_100, round(cov, 6) AS must_include_coverage,
  round(viol, 6) AS mean_should_not_violations, n_judges FROM sc""")
def _(spark, sf):
    s = scores(spark, sf)
    return s.select("model", "question_id", "run_index",
                    *[F.col("dim_means")[d].alias(d) for d in DIMS], "composite_5",
                    "composite_100", "must_include_coverage", "mean_should_not_violations",
                    "n_judges")


@query("D5_quick_composite", J + PANEL + """
SELECT model, count(*) AS n, round(""" + mean_of("composite_100") + """, 6) AS composite FROM sc
WHERE composite_100 IS NOT NULL GROUP BY model""")
def _(spark, sf):
    return scoring.quick_composite(scores(spark, sf))


@query("D7_open_overall", J + PANEL + """
, m AS (SELECT model, count(*) AS n, """ + mean_of("p") + """ AS mean,
    CASE WHEN count(*) > 1 THEN stddev_samp(p) / sqrt(count(*)) ELSE 0 END AS sem
  FROM oi GROUP BY model)
SELECT model, n, round(mean, 6) AS mean, round(sem, 6) AS sem, n_unscored_records,
  round(cov, 6) AS mean_must_include_coverage, round(viol, 6) AS mean_should_not_violations
FROM m JOIN (SELECT model, count(*) FILTER (composite_100 IS NULL) AS n_unscored_records,
  avg(cov) AS cov, avg(viol) AS viol FROM sc GROUP BY model) USING (model)""")
def _(spark, sf):
    return panel.open_overall(scores(spark, sf)).select(
        "model", "n", "mean", "sem", "n_unscored_records", "mean_must_include_coverage",
        "mean_should_not_violations")


@query("D8_open_by_dimension", J + PANEL + """
SELECT model, dimension, count(*) AS n, round(""" + mean_of("p") + """, 6) AS mean,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(p) / sqrt(count(*)) ELSE 0 END, 6) AS sem
FROM (SELECT model, dimension, question_id, """ + mean_of("composite_100") + """ AS p FROM sc
  WHERE composite_100 IS NOT NULL GROUP BY ALL) GROUP BY model, dimension""")
def _(spark, sf):
    return panel.open_by_dimension(scores(spark, sf))


@query("D16_judge_dimensions", J + PANEL + """
, lg AS (UNPIVOT (SELECT model, question_id, accuracy, voice, wisdom, distinct_ AS "distinct"
    FROM sc) ON accuracy, voice, wisdom, "distinct" INTO NAME judge_dimension VALUE v),
it AS (SELECT model, judge_dimension, question_id, """ + UNIT_MEAN + """ AS v FROM lg WHERE v IS NOT NULL
  GROUP BY ALL),
mm AS (SELECT model, judge_dimension, round_even(""" + UNIT_MEAN + """, 3) AS mean FROM it GROUP BY ALL)
SELECT model, judge_dimension, mean, row_number() OVER (PARTITION BY model
  ORDER BY mm.mean, judge_dimension) = 1 AS weakest FROM mm""")
def _(spark, sf):
    return panel.judge_dimension_means(scores(spark, sf))


@query("C11_choice_vs_open", using("responses", "judge_base") + SCORED.replace("sc AS", "rs AS")
       .replace("FROM sc", "FROM rs") + PANEL + """
SELECT model, round(a.mean, 6) AS mc_mean, round(b.mean, 6) AS open_mean
FROM (SELECT model, """ + MEAN + """ AS mean FROM pi GROUP BY model) a
JOIN (SELECT model, """ + mean_of("p") + """ AS mean FROM oi GROUP BY model) b USING (model)""")
def _(spark, sf):
    return leaderboard.axes_together(mc.overall(spark, sf),
                                     panel.open_overall(scores(spark, sf)))


OPEN_MEANS = """, om AS (SELECT model, count(*) AS n, """ + mean_of("p") + """ AS mean,
    CASE WHEN count(*) > 1 THEN stddev_samp(p) / sqrt(count(*)) ELSE 0 END AS sem FROM oi GROUP BY model),
so AS (SELECT oi.model, question_id, p, ord FROM oi JOIN cohort USING (model)),
po AS (SELECT x.model AS a, y.model AS b, x.question_id, x.p AS va, y.p AS vb
  FROM so x JOIN so y ON x.question_id = y.question_id AND x.ord < y.ord)"""
JC = using("judge_base", "cohort")


@query("F1_open_ci", JC + PANEL + OPEN_MEANS + f"""
SELECT model, n, round(mean, 6) AS mean, round(sem, 6) AS sem, {NEAR} FROM om""")
def _(spark, sf):
    s = cut_lineage(scores(spark, sf))
    drawn = bootstrap.mean_ci(panel.open_items(s), ["model"], "p", mc.RESAMPLES, SEED, "open-overall")
    return near_normal(drawn.join(panel.open_overall(s).select("model", "mean", "sem"), "model"))


def open_pairs(s: DataFrame, cohort: DataFrame) -> DataFrame:
    return pairwise.shared_items(panel.open_items(s), cohort)


@query("F2_open_pairs", JC + PANEL + OPEN_MEANS + f"""
SELECT a, b, count(*) AS n_items, {NEAR}, true AS diff_near, true AS floor_ok, true AS holm_ok,
  true AS p_agrees FROM po GROUP BY a, b""")
def _(spark, sf):
    s = cut_lineage(scores(spark, sf))
    cohort = mc.cohort(spark, sf)
    d = F.col("va") - F.col("vb")
    facts = open_pairs(s, cohort).groupBy("a", "b").agg(
        F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("sem"))
    drawn = analysis.pair_table(panel.open_items(s), cohort, 3, mc.PAIR_RESAMPLES, SEED,
                                label="open-pair", with_mcnemar=False)
    # three digits of a difference on the scale of 100
    return mc.checked_pairs(drawn.join(facts, ["a", "b"]).withColumn(
        "diff_near", F.abs(F.col("diff") - F.col("mean")) <= 0.00051)).drop("mean", "diff")


@query("F2_open_pairs_poisson", JC + PANEL + OPEN_MEANS + ", " + mc.poisson_sql(
    f"SELECT a, b AS other, question_id AS key, CAST(round((va - vb) / 100 * {UNIT}) AS BIGINT) AS v FROM po",
    "a, other", mc.POISSON_RESAMPLES) + """
SELECT a, other AS b, n, round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi, round(p, 6) AS p, 'poisson' AS method
FROM pc JOIN (SELECT a, b AS other, count(*) AS n FROM po GROUP BY ALL) USING (a, other)""")
def _(spark, sf):
    return poisson_pairs(cut_lineage(scores(spark, sf)), mc.cohort(spark, sf), mc.POISSON_RESAMPLES)


def poisson_pairs(s: DataFrame, cohort: DataFrame, resamples: int) -> DataFrame:
    pairs = open_pairs(s, cohort).withColumn("d", (F.col("va") - F.col("vb")) / panel.FULL)
    return bootstrap.poisson_ci(pairs, ["a", "b"], "d", "item", resamples, SEED)


@query("D18_significance_counts", using("responses", "cohort", "judge_base") + SCORED.replace(
    "sc AS", "rs AS").replace("FROM sc", "FROM rs") + mc.HOLM + PANEL + OPEN_MEANS + ", " + mc.poisson_pairs_sql(
    f"SELECT a, b AS other, question_id AS key, CAST(round((va - vb) / 100 * {UNIT}) AS BIGINT) AS v FROM po",
    mc.PAIR_RESAMPLES) + """,
oq AS (SELECT *, round(p, 5) AS p5 FROM pc),
oo AS (SELECT *, row_number() OVER (ORDER BY p5, a, other) AS rn, count(*) OVER () AS m FROM oq),
oh AS (SELECT *, least(1.0, max((m - rn + 1) * p5) OVER (ORDER BY p5, a, other
  ROWS UNBOUNDED PRECEDING)) AS ph FROM oo)
SELECT 'mc' AS family, count(*) AS n_pairs, count(*) FILTER (pr5 < 0.05) AS n_nominal,
  count(*) FILTER (ph < 0.05) AS n_significant FROM adj
UNION ALL
SELECT 'open', count(*), count(*) FILTER (p5 < 0.05), count(*) FILTER (ph < 0.05) FROM oh""")
def _(spark, sf):
    choice = mc.tested(spark, sf).select(F.lit("mc").alias("family"), "a", "b",
                                         F.col("p_mcnemar").alias("p"))
    # the resamples of a family: 2 * m / (B + 1) stays below its level
    open_ = poisson_pairs(cut_lineage(scores(spark, sf)), mc.cohort(spark, sf), mc.PAIR_RESAMPLES).select(
        F.lit("open").alias("family"), "a", "b", F.bround("p", 5).alias("p"))
    families = pairwise.holm(choice.unionByName(open_), ["family"], "p", "a", "b")
    return leaderboard.significance_counts(families, "p")


# Composites are continuous: means of means over panels.
UNITS_AS_V = f"CAST(round(p / 100 * {UNIT}) AS BIGINT)"


@query("F1_open_ci_poisson", J + PANEL + ", " + mc.poisson_sql(
    f"SELECT model, question_id AS key, {UNITS_AS_V} AS v FROM oi", "model", mc.POISSON_RESAMPLES) + """
SELECT model, n, round(lo, 6) + 0 AS lo, round(hi, 6) + 0 AS hi, 'poisson' AS method
FROM pc JOIN (SELECT model, count(*) AS n FROM oi GROUP BY model) USING (model)""")
def _(spark, sf):
    items = panel.open_items(scores(spark, sf)).withColumn("share", F.col("p") / panel.FULL)
    return bootstrap.poisson_ci(items, ["model"], "share", "question_id", mc.POISSON_RESAMPLES,
                                SEED).drop("p")


@query("D7_open_leaderboard_full", JC + PANEL + OPEN_MEANS + f"""
, re AS (SELECT model, count(*) FILTER (composite_100 IS NULL) AS n_unscored_records,
  avg(cov) AS cov, avg(viol) AS viol FROM sc GROUP BY model)
SELECT row_number() OVER (ORDER BY coalesce(mean, 0) DESC, ord) AS rank, model, label, tier, generation,
  round(mean, 6) AS mean, {{NEAR}}, n, round(sem, 6) AS sem, n_unscored_records,
  round(round_even(cov, 4), 6) AS mean_must_include_coverage,
  round(round_even(viol, 4), 6) AS mean_should_not_violations
FROM om JOIN re USING (model) JOIN cohort USING (model)""".replace("{NEAR}", NEAR))
def _(spark, sf):
    # panel scores are a stored table of a run
    return near_normal(analysis.open_board(cut_lineage(scores(spark, sf)), mc.cohort(spark, sf),
                                           mc.RESAMPLES))


@query("D8_open_by_dimension_ci", J + PANEL + f"""
SELECT model, dimension, count(*) AS n, round({mean_of("p")}, 6) AS mean,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(p) / sqrt(count(*)) ELSE 0 END, 6) AS sem, {NEAR}
FROM (SELECT model, dimension, question_id, {mean_of("composite_100")} AS p FROM sc
  WHERE composite_100 IS NOT NULL GROUP BY ALL) GROUP BY model, dimension""")
def _(spark, sf):
    return near_normal(analysis.open_groups(cut_lineage(scores(spark, sf)), mc.RESAMPLES))


# Complete raw ratings; the raw value is not clamped and numeric strings do not count.
COMPLETE = """, cr AS (SELECT model, question_id, run_index, persona,
    arg_max(struct_pack(a, b, c, e), seq) AS r FROM judge_base
  WHERE role = 'primary' AND NOT prose AND NOT junk AND NOT absent AND seq % 29 <> 0 GROUP BY ALL),
rl AS (SELECT model, question_id, run_index, persona, unnest(['composite', 'accuracy', 'voice',
    'wisdom', 'distinct']) AS metric,
  unnest([(r.a + r.b + r.c + r.e) / 4, r.a::DOUBLE, r.b::DOUBLE, r.c::DOUBLE, r.e::DOUBLE]) AS v
  FROM cr),
un AS (SELECT metric, model, question_id, run_index, count(*) AS m, sum(v) AS s, sum(v * v) AS q
  FROM rl GROUP BY ALL HAVING count(*) >= 2),
al AS (SELECT metric, count(*) AS n_units, sum(m) AS n, sum(s) AS s, sum(q) AS q,
  sum(2 * (m * q - s * s) / (m - 1)) AS d FROM un GROUP BY metric),
alpha AS (SELECT metric, n_units, 1 - (d / n) / (2 * (n * q - s * s) / (n * (n - 1))) AS alpha
  FROM al)"""


def complete(spark: SparkSession, sf: str) -> DataFrame:
    return panel.last_complete(verdicts(spark, sf), DIMS, "seq")


@query("F7_krippendorff_alpha", J + COMPLETE + """
SELECT metric, n_units, round(alpha, 6) AS alpha FROM alpha""")
def _(spark, sf):
    return reliability.judge_agreement(complete(spark, sf), DIMS)


@query("F8_judge_agreement", J + COMPLETE + """
SELECT round(max(alpha) FILTER (metric = 'composite'), 4) AS alpha,
  round(min(alpha) FILTER (metric <> 'composite'), 4) AS min_dimension_alpha,
  (SELECT count(DISTINCT (model, question_id, run_index)) FROM cr) AS n_units,
  (SELECT count(DISTINCT persona) FROM cr) AS n_personas FROM alpha""")
def _(spark, sf):
    return reliability.judge_agreement_summary(complete(spark, sf), DIMS)


CROSS = TYPED + """, sv AS (SELECT model, question_id, run_index, persona, role, seq,
  list_avg(list_filter([accuracy, voice, wisdom, distinct_], lambda x: x IS NOT NULL)) AS s
  FROM ty WHERE NOT prose),
xp AS (SELECT model, question_id, run_index, persona,
  arg_max(s, seq) FILTER (role = 'primary') AS p,
  arg_max(s, seq) FILTER (role = 'crosscheck') AS c
  FROM sv GROUP BY ALL HAVING p IS NOT NULL AND c IS NOT NULL)"""


@query("X2_crosscheck_agreement", J + CROSS + """
SELECT model, count(*) AS n, round(avg(p) - avg(c), 6) AS mean_diff, round(corr(p, c), 6) AS corr
FROM xp GROUP BY model""")
def _(spark, sf):
    return panel.crosscheck_agreement(panel.crosscheck_pairs(verdicts(spark, sf), DIMS, "seq"))


@query("X2_crosscheck_alpha", J + CROSS + """
, lg AS (SELECT model, question_id, run_index, persona, unnest([p, c]) AS v FROM xp),
un AS (SELECT model, question_id, run_index, persona, count(*) AS m, sum(v) AS s, sum(v * v) AS q
  FROM lg GROUP BY ALL),
al AS (SELECT model, count(*) AS n_units, sum(m) AS n, sum(s) AS s, sum(q) AS q,
  sum(2 * (m * q - s * s) / (m - 1)) AS d FROM un GROUP BY model)
SELECT model, n_units, round(1 - (d / n) / (2 * (n * q - s * s) / (n * (n - 1))), 6) AS alpha
FROM al""")
def _(spark, sf):
    pairs = panel.crosscheck_pairs(verdicts(spark, sf), DIMS, "seq")
    long = pairs.select("model", F.struct("question_id", "run_index", "persona").alias("unit"),
                        F.explode(F.array("primary", "crosscheck")).alias("value"))
    return reliability.krippendorff_alpha(long, ["model"])


# ---- audits --------------------------------------------------------------------

LOG = """, ln AS (SELECT *, seq % 53 = 0 AS corrupt, seq % 61 = 1 AND seq % 53 <> 0 AS blank,
  CASE WHEN seq % 3 = 0 OR role = 'primary' THEN 'primary' ELSE 'crosscheck' END AS r
  FROM judge_base),
tr AS (SELECT model, question_id, run_index, count(*) FILTER (NOT prose) AS judges FROM ln
  WHERE NOT corrupt AND NOT blank AND r = 'primary' GROUP BY ALL),
g AS (SELECT count(*) AS gt, count(*) FILTER (o_orderkey % 71 = 0) AS gc,
  count(*) FILTER (o_orderkey % 71 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 50 = 1) AS gf
  FROM orders),
j AS (SELECT count(*) FILTER (NOT blank) AS jt, count(*) FILTER (corrupt) AS jc,
  count(*) FILTER (NOT blank AND NOT corrupt AND seq % 59 = 0) AS jf FROM ln)"""


@query("A4_log_scan", J + LOG + " SELECT jf AS failed, jt AS total, jc AS corrupt FROM j")
def _(spark, sf):
    return audit.scan_log(lines(spark, sf))


@query("D10_quorum_shortfall", J + LOG + f"""
SELECT count(*) AS judged_triples, count(*) FILTER (judges < {NEEDED}) AS short FROM tr""")
def _(spark, sf):
    return audit.quorum(lines(spark, sf), NEEDED)


@query("D9_audit_mc", LOG.replace(", ln AS", "WITH ln AS", 1).replace("FROM judge_base",
       "FROM (SELECT 1 AS seq, '' AS role, '' AS model, 1 AS question_id, 1 AS run_index, true AS prose)")
       + f"""
SELECT gf + gc + greatest(0, {EXPECTED} - gt) AS strict_fail,
  gf + gc + greatest(0, {EXPECTED} - gt) AS accept_fail, 0::BIGINT AS below_quorum,
  {EXPECTED}::BIGINT AS expected, gt AS have, gf AS failed, gc AS corrupt,
  greatest(0, {EXPECTED} - gt) AS missing FROM g""")
def _(spark, sf):
    return audit.audit_mc(response_lines(spark, sf), EXPECTED)


@query("D9_audit_open", J + LOG + f"""
, q AS (SELECT count(*) AS judged, count(*) FILTER (judges < {NEEDED}) AS short FROM tr),
n AS (SELECT *, greatest(0, gt - gf) AS made, greatest(0, {EXPECTED} - gt) AS gm,
  greatest(0, greatest(0, gt - gf) * {PERSONAS} - jt) AS jm,
  short + greatest(0, greatest(0, gt - gf) - judged) AS below FROM g, j, q)
SELECT gf + gc + gm + jf + jc + jm AS strict_fail, gf + gc + gm + jc + below AS accept_fail,
  below AS below_quorum, gf AS gen_failed, gc AS gen_corrupt, gm AS gen_missing, gt AS gen_have,
  {EXPECTED}::BIGINT AS gen_expected, jf AS judge_failed, jc AS judge_corrupt,
  jm AS judge_missing, jt AS judge_have, made * {PERSONAS} AS judge_expected FROM n""")
def _(spark, sf):
    return audit.audit_open(response_lines(spark, sf), lines(spark, sf), EXPECTED, PERSONAS,
                            NEEDED)
