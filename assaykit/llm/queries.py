"""Registered queries of the operators on the given tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import (conversation_queries, exact_dedup, fingerprints, jaccard_join, language_id, language_model,
                          mixing, packing, token_counts, toxicity, url_filters)
from assaykit.llm.shared import table
from assaykit.session import scratch_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; then some deleted and some revised, in a batch that runs twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rollups = token_counts.TokenRollups(spark, scratch_path(spark, "rollups"))
    rollups.commit(1, docs.withColumn("op", F.lit("insert")))
    deleted, revised = F.col("doc_id") % 11 == 3, F.col("doc_id") % 7 == 1
    changes = docs.where(deleted | revised).withColumn(
        "op", F.when(deleted, "delete").otherwise("revise")).withColumn(
        "text", F.concat("text", F.lit(" "), F.coalesce("source", F.lit(""))))
    for _ in range(2):
        rollups.commit(2, changes)
    return rollups.totals()


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"),
                                              "score", "predicted")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.listed_urls(pages))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~language_id.held_out())
    return language_id.identify(docs, model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(table(spark, sf_dir, "documents"))
    return out.withColumn("target", F.round("target", 3))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_model.held_out()
    return language_model.score(docs, ~held).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
        "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

JACCARD_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    {_LOWER}), {_WORDS}) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b
  FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(nx.n) + any_value(ny.n) - count(*))),
same AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY items) AS class_id
  FROM (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS items FROM s GROUP BY 1)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id,
  coalesce(same.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) c ON c.a = w.doc_id
LEFT JOIN same ON same.doc_id = w.doc_id"""

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_PARTS = rf"""
u AS (SELECT page_id, {_REST} AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS q FROM u),
c AS (SELECT page_id, host, path, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM h)"""

URL_SQL = rf"""
WITH {_PARTS},
r(action, dom, prefix) AS (VALUES {', '.join(str(r) for r in url_filters.RULES)}),
best AS (SELECT page_id, arg_max(dom || prefix, length(dom || prefix)) AS rule,
    arg_max(action, length(dom || prefix)) AS action
  FROM c JOIN r ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, prefix)
  GROUP BY 1),
listed AS (SELECT DISTINCT canonical FROM c
  WHERE regexp_matches(host, '(^|[.-])({"|".join(url_filters.LISTED)})([.-]|$)'))
SELECT c.page_id, host, path, rule,
  coalesce(action, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.canonical IS NOT NULL AS listed, c.canonical
FROM c LEFT JOIN best USING (page_id) LEFT JOIN listed l ON l.canonical = c.canonical"""


def _fills(n: int) -> str:
    """The threshold passes of the mix: documents beyond it may fill what is left."""
    out = []
    for k in range(n + 1):
        out.append(f"""
p{k} AS (SELECT t.*, size <= gap AND NOT more AND sum(CASE WHEN size <= gap AND NOT more
    THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= gap AS now FROM s{k} t),
s{k + 1} AS (SELECT doc_id, source, h, size, source_size, target, every, budget, more OR now AS more,
    budget - sum(CASE WHEN more OR now THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap
  FROM p{k})""")
    return ",".join(out)


MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
a AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY 1),
b AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
    + 1]::DOUBLE AS w FROM a),
e AS (SELECT *, 2.0 * source_size AS lim, 2.0 * source_size / w AS ratio FROM b),
f AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(lim) OVER up, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level FROM e
  WINDOW up AS (ORDER BY ratio, source IS NULL, encode(source)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(lim, w * max(CASE WHEN level <= ratio THEN level END)
    OVER ()) AS target FROM f),
s0 AS (SELECT d.doc_id, d.source, h, size, source_size, target, target >= source_size AS every,
    CASE WHEN target >= source_size THEN target - source_size ELSE target END AS budget,
    FALSE AS more, CASE WHEN target >= source_size THEN target - source_size ELSE target END AS gap
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),{_fills(mixing.FILLS)},
again AS (SELECT *, more AND NOT every AND size <= gap AND sum(CASE WHEN more AND NOT every
    AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) <= gap AS twice
  FROM s{mixing.FILLS + 1}),
taken AS (SELECT *, CAST(every AS INT) + CAST(more AS INT) + CAST(twice AS INT) AS copies FROM again)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target,
  size * copies AS taken, copies
FROM taken"""

QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_fingerprints, op3_token_counts, op4_toxicity, op5_url_filter,
    op6_language_id, op7_jaccard_join, op8_mixing, op9_lm_scores, op10_packing,
    pipeline)} | conversation_queries.QUERIES
CHECKS = {"op1_exact_dedup": EXACT_SQL, "op5_url_filter": URL_SQL,
          "op7_jaccard_join": JACCARD_SQL, "op8_mixing": MIXING_SQL} | conversation_queries.CHECKS
