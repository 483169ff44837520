"""The evaluation tables that the registered queries run on, derived from the test tables.

Every derivation is one portable SELECT over whole tables (integer arithmetic and CASE),
so the SQL check reads the same inputs.  Three tokens differ by engine: ``$[...]$`` array
literals, ``$unnest(...)$`` and ``$trim$``-free text building; nothing else does.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from assaykit.functions.text import LETTERS
from assaykit.session import dealt, spread

JUDGE_DIMS = ["accuracy", "voice", "wisdom", "distinct"]
REVIEWERS = 5
DIFFICULTY = """CASE WHEN p_size <= 15 THEN 'basic' WHEN p_size <= 35 THEN 'intermediate'
    WHEN p_size <= 45 THEN 'advanced' ELSE 'expert' END"""
AXIS = """CASE WHEN p_type IN ('SMALL','MEDIUM') THEN 'axis1'
    WHEN p_type IN ('LARGE','STANDARD') THEN 'axis2' ELSE 'axis3' END"""

# one pack, but as data: a literal would fold the join on it away
PART_PACK = "CASE WHEN p_size > 0 THEN 'pack1' ELSE 'pack0' END"
TEXT_PACK = "CASE WHEN doc_id >= 0 THEN 'pack1' ELSE 'pack0' END"

RESPONSES = f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice,
  n.n_name AS model, r.r_name AS tier, n.n_nationkey AS ord,
  l.l_partkey AS question_id, l.l_linenumber - 1 AS run_index, p.p_type AS dimension,
  {DIFFICULTY} AS difficulty, {AXIS} AS axis,
  (l.h2 % 50 <> 0) AS call_ok, (l.h2 % 23 <> 1) AS parse_ok,
  (l.h2 % 23 <> 1 AND (l.l_partkey % 10 = 0
     OR l.h1 < 400 + 15 * n.n_nationkey - (l.l_partkey * 37) % 200)) AS correct,
  CASE WHEN l.h2 % 97 = 3 THEN 'other-model' ELSE n.n_name END AS model_served,
  CASE WHEN l.h2 % 97 = 3 AND l.h1 % 2 = 0 THEN 2000 ELSE 10000 + l.h1 % 100 END AS cost_micro,
  l.h1 % 7 AS picked_raw, l.h1 + 100 AS duration_ms, l.h1 % 300 AS input_tokens,
  l.h2 % 500 AS output_tokens, 1 + l.h2 % 3 AS attempts, (l.h2 % 11 = 0) AS cache_hit,
  CASE WHEN l.h2 % 13 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason
FROM (SELECT *,
        (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709
          + CAST(l_linenumber AS BIGINT) * 15485863) % 1000 AS h1,
        (l_orderkey * 31 + l_suppkey * 7 + CAST(l_linenumber AS BIGINT) * 17) AS h2
      FROM lineitem) l
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey"""

# NATION_7 is left out so that some records fall outside the cohort.
COHORT = """
SELECT n_name AS model, r_name AS tier, concat('Model ', n_name) AS label,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey AS DOUBLE) END AS generation,
  n_nationkey AS ord
FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 7"""

TAXONOMY = f"""
SELECT DISTINCT {PART_PACK} AS pack, p_type AS dimension, {AXIS} AS axis, 'mc' AS format
FROM part
UNION ALL
SELECT DISTINCT {TEXT_PACK}, lang, CASE WHEN lang IN ('en','de') THEN 'axis1' ELSE 'axis2' END,
  'open' FROM documents"""

TYPES = f"""
SELECT DISTINCT {PART_PACK} AS pack, CASE p_partkey % 4 WHEN 0 THEN 'correct'
  WHEN 1 THEN 'near_miss' WHEN 2 THEN 'folk_trap' ELSE 'overreach' END AS type FROM part"""

# Metadata of all items, whatever their defects.
BANK = f"""
SELECT p_partkey AS question_id, p_type AS dimension, {DIFFICULTY} AS difficulty, {AXIS} AS axis
FROM part"""

# One defect per p_partkey % 29, the rest is valid.
ITEMS = f"""
SELECT {PART_PACK} AS pack, d, p_partkey,
  CASE WHEN d = 12 THEN 'essay' ELSE 'mc' END AS format,
  CASE WHEN d = 4 THEN 'axis0' WHEN d = 14 AND axis = 'axis1' THEN 'axis2'
       WHEN d = 14 THEN 'axis1' ELSE axis END AS axis,
  CASE WHEN d = 10 THEN 'NOWHERE' ELSE dimension END AS dimension,
  CASE WHEN d = 11 THEN 'hard' ELSE difficulty END AS difficulty,
  CASE WHEN d = 2 THEN '   short ' ELSE concat('Which ', p_name, ' is number ',
       CAST(p_partkey AS VARCHAR(20)), '?') END AS question,
  $[c0, CASE WHEN d = 1 THEN concat(' ', upper(c0)) WHEN d = 5 THEN '  ' ELSE c1 END, c2, c3]$
    AS choices,
  CAST(CASE WHEN d = 3 THEN 7 ELSE k END AS INT) AS answer_index,
  CASE WHEN d = 13 THEN NULL
       WHEN d = 15 THEN $['correct', 'near_miss']$
       ELSE $[CASE WHEN d = 8 THEN 'bogus' WHEN m = 0 OR d = 7 THEN 'correct' ELSE 'near_miss' END,
              CASE WHEN m = 1 OR d = 7 THEN 'correct' ELSE 'folk_trap' END,
              CASE WHEN m = 2 THEN 'correct' ELSE 'overreach' END,
              CASE WHEN m = 3 THEN 'correct' ELSE 'near_miss' END]$ END AS distractor_types,
  CASE WHEN d = 9 THEN '' ELSE p_brand END AS source
FROM (SELECT *, CASE WHEN d = 6 THEN (k + 1) % 4 ELSE k END AS m
  FROM (SELECT *, p_partkey % 29 AS d, {DIFFICULTY} AS difficulty, {AXIS} AS axis,
    p_type AS dimension, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey % 4 END AS k,
    concat('brand ', p_brand) AS c0, concat('type ', p_type) AS c1,
    concat('size ', CAST(p_size AS VARCHAR(20))) AS c2,
    concat('part ', CAST(p_partkey AS VARCHAR(20))) AS c3 FROM part) a) b"""

VALID = "(d IN (0, 13) OR d > 15)"   # items without a defect (13: no types, still valid)

OPEN_ITEMS = f"""
SELECT {TEXT_PACK} AS pack, doc_id, 'open' AS format,
  CASE WHEN doc_id % 17 = 3 THEN 'axis3' WHEN lang IN ('en','de') THEN 'axis1'
       ELSE 'axis2' END AS axis, lang AS dimension,
  CASE doc_id % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced'
       WHEN 3 THEN 'expert' ELSE 'basic' END AS difficulty,
  text AS prompt, concat('doc', CAST(doc_id AS VARCHAR(20))) AS question_id,
  CASE WHEN doc_id % 11 = 4 THEN $[]$ ELSE $[concat('point ', source), 'second point']$ END
    AS must_include,
  CASE WHEN doc_id % 13 = 5 THEN $[]$ ELSE $[concat('avoid ', lang)]$ END AS should_not,
  CASE WHEN doc_id % 19 = 6 THEN '' ELSE 'from principle to counsel' END AS ideal
FROM documents"""

ANSWER_CHOICES = ["the first alternative", "the second alternative", "the third alternative",
                  "the fourth alternative", "short"]


def _answer_endings() -> list[tuple[str, int, str | None]]:
    """(response ending, choices offered, expected letter), built so that the letter is known.

    A phrase announces a letter in one of several forms; the announcement may be hedged, out of
    range or taken back. Otherwise a line of its own or a repeated choice tells the letter.
    """
    leads = ["ANSWER: ", "answer - ", "My answer is ", "I select ", "Going with ", "choice "]
    forms = ["{}", "({})", "**{}**"]
    openings = ["Each part was weighed. ", "", "Some of these fall away at once.\n"]
    endings = ["", ".", ", since nothing else fits the passage."]
    out = []
    for i, lead in enumerate(leads):
        for j, form in enumerate(forms):
            letter = LETTERS[(i + 2 * j) % 4]
            out.append((openings[j] + lead + form.format(letter) + endings[(i + j) % 3],
                        4 + j % 2, letter))
        out += [(f"{lead}{LETTERS[i % 4]} or {LETTERS[4 - i % 4]}", 5, None),
                (f"{lead}{LETTERS[i % 4]}/{LETTERS[3]}", 5, None), (f"{lead}F.", 4, None),
                (f"{lead}D at first; on a second look {lead}B", 4, "B")]
    out += [(f"\n{form.format(LETTERS[j])}", 4, LETTERS[j]) for j, form in enumerate(forms)]
    out += [(f"so it has to be {c.upper()}.", 4, LETTERS[i])
            for i, c in enumerate(ANSWER_CHOICES[:4])]
    return out + [(" and ".join(ANSWER_CHOICES[1:3]), 4, None), ("Nothing here is settled.", 4, None),
                  ("", 4, None)]


ANSWERS = _answer_endings()


def _answer_case(column: int, text: bool) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if not text:
            return str(v)
        return "concat(" + ", chr(10), ".join(
            "'" + piece.replace("'", "''") + "'" for piece in v.split("\n")) + ")"
    return "CASE t " + " ".join(f"WHEN {i} THEN {lit(a[column])}"
                                for i, a in enumerate(ANSWERS)) + " END"


# The conversation comes quoted, line by line, so that only the ending can announce a letter or
# hold one on a line of its own.
ANSWER_TEXT = f"""
SELECT conv_id, turn, t, concat('> ', replace(text, chr(10), concat(chr(10), '> ')), chr(10),
    'Then. ', {_answer_case(0, True)}) AS text,
  {_answer_case(1, False)} AS n_choices, {_answer_case(2, True)} AS expected,
  (conv_id + turn) % 4 AS answer_index
FROM (SELECT *, (conv_id * 8 + turn) % {len(ANSWERS)} AS t FROM conversations) c"""

# Verdicts: three personas per order; some repeated, junk, dropped or cross-checked.
JUDGE_BASE = """
SELECT model, question_id, run_index, persona, role, o_orderkey AS seq, dimension,
  1 + (o_orderkey * 13 + 7 + persona * (o_orderkey % 3) + x) % 6 AS a,
  1 + (o_orderkey * 13 + 14 + persona * (o_orderkey % 3)) % 5 AS b,
  1 + (o_orderkey * 13 + 21 + persona * (o_orderkey % 3) + x) % 5 AS c,
  1 + (o_orderkey * 13 + 28 + persona * (o_orderkey % 3)) % 5 AS e,
  o_orderkey % 41 = 0 AS junk, o_orderkey % 43 = 1 AS absent, o_orderkey % 47 = 2 AS prose,
  CASE WHEN o_orderkey % 37 = 0 THEN 9 ELSE (o_orderkey + persona) % 4 END AS hits,
  3 + o_orderkey % 2 AS total,
  CASE WHEN o_orderkey % 31 = 0 THEN -1 ELSE (o_orderkey + persona) % 3 END AS viol
FROM (SELECT o.*, n_name AS model, o_orderkey % 200 AS question_id, o_orderkey % 3 AS run_index,
        concat('dim', CAST(o_orderkey % 200 % 4 AS VARCHAR(20))) AS dimension,
        CASE role WHEN 'primary' THEN 0 ELSE 1 END AS x
      FROM (SELECT *, $unnest('primary', 'crosscheck')$ AS role
            FROM (SELECT *, $unnest(0, 1, 2)$ AS persona FROM orders) p) o
      JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) j
WHERE o_orderkey % 19 <> persona AND (role = 'primary' OR o_orderkey % 4 = 0)"""

# The same verdicts as judge output: prose around JSON, with braces inside strings.
JUDGE_TEXT = f"""
SELECT model, question_id, run_index, persona, role AS judge_role, seq, dimension,
  true AS call_ok,
  CASE WHEN prose THEN 'I cannot score this {{sorry}} response.' ELSE concat(
    'Notes {{draft}} first: {{"accuracy": 1}} then ', '{{"accuracy": ',
    CASE WHEN junk THEN '"N/A"' WHEN seq % 29 = 0 THEN concat('"', CAST(a AS VARCHAR(9)), '"')
         ELSE CAST(a AS VARCHAR(9)) END,
    ', "voice": ', CASE WHEN absent THEN 'null' ELSE CAST(b AS VARCHAR(9)) END,
    ', "wisdom": ', CAST(c AS VARCHAR(9)), ', "distinct": ', CAST(e AS VARCHAR(9)),
    ', "must_include_hits": ',
    CASE WHEN seq % 23 = 0 THEN '"three"' ELSE CAST(hits AS VARCHAR(9)) END,
    ', "must_include_total": ', CAST(total AS VARCHAR(9)),
    ', "should_not_violations": ', CAST(viol AS VARCHAR(9)),
    ', "meta": {{"deep": ', repeat('{{"er": ', 1 + CAST(seq % 25 AS INT)), '1',
    repeat('}}', 1 + CAST(seq % 25 AS INT)), '}}, "justification": "close}} but {{open"}} done') END AS text
FROM ({JUDGE_BASE}) b"""

# Reviews of valid items: five reviewers, failures, a second pass for half of them.
REVIEW_BASE = f"""
SELECT p_partkey, k, reviewer, pass,
  (p_partkey + reviewer) % 11 = 0 OR (p_partkey % 13 = 1 AND reviewer < 3) AS failing,
  (p_partkey * 7 + reviewer) % 6 = 0 AS differs, 3 + (p_partkey + reviewer) % 3 AS clarity,
  1 + CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END AS defensible,
  CASE WHEN p_partkey % 9 = 0 AND reviewer < 2 THEN 'ambiguous'
       WHEN reviewer = 3 THEN 'none' WHEN p_partkey % 5 = 0 THEN 'trivia' END AS flag
FROM (SELECT *, $unnest(0, 1)$ AS pass FROM
  (SELECT *, $unnest(0, 1, 2, 3, 4)$ AS reviewer,
     CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey % 4 END AS k, p_partkey % 29 AS d
   FROM part) a) b
WHERE {VALID}"""

REVIEWS = f"""
SELECT p_partkey AS question_id, concat('reviewer', CAST(reviewer AS VARCHAR(9))) AS persona,
  pass = 1 AS resolicited, NOT failing OR pass = 1 AS parse_ok,
  CASE WHEN failing AND pass = 0 THEN NULL ELSE concat(
    '{{"best_answer": "',
    substring('ABCD', CAST(CASE WHEN differs THEN (k + 1) % 4 ELSE k END AS INT) + 1, 1),
    ') since", "n_defensible_options": ', CAST(defensible AS VARCHAR(9)),
    ', "clarity": ', CAST(clarity AS VARCHAR(9)), ', "flags": [',
    CASE WHEN flag IS NULL THEN '' ELSE concat('"', flag, '"') END,
    '], "realistic": ', CASE WHEN p_partkey % 7 = 2 AND reviewer < 3 THEN 'null'
                             ELSE CAST(clarity AS VARCHAR(9)) END,
    ', "rubric_fair": ', CAST(clarity + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END
                              AS VARCHAR(9)), '}}') END AS review
FROM ({REVIEW_BASE}) r
WHERE pass = 0 OR (failing AND p_partkey % 2 = 0)"""

POOL = """
SELECT doc_id, text, lang AS dimension, source AS difficulty FROM documents"""

# A call log: repeated keys, stale entries, failures with their messages.
CALLS = """
SELECT event_id, ts, concat('k', CAST(user_id AS VARCHAR(20)), '-', event_type) AS key,
  concat('model-', event_type) AS model, event_type, value, props,
  (event_id % 7 <> 0) AS call_ok,
  CASE event_id % 5 WHEN 0 THEN concat('model-', event_type, '-20250101')
    WHEN 1 THEN concat('model-', event_type, '-fast') WHEN 2 THEN NULL
    ELSE concat('model-', event_type) END AS model_served,
  CASE WHEN event_id % 7 <> 0 THEN NULL WHEN event_id % 3 = 0 THEN 'HTTP 429 rate limit'
    WHEN event_id % 3 = 1 THEN 'Served_Mismatch: requested x' ELSE 'Backend http 401' END AS error
FROM events"""

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

FIXTURES = {"responses": RESPONSES, "cohort": COHORT, "bank": BANK, "taxonomy": TAXONOMY, "types": TYPES,
            "items": ITEMS, "open_items": OPEN_ITEMS, "answer_text": ANSWER_TEXT,
            "judge_base": JUDGE_BASE, "judge_text": JUDGE_TEXT, "review_base": REVIEW_BASE,
            "reviews": REVIEWS, "pool": POOL, "calls": CALLS}


# The table whose rows a fixture expands into texts or a log; small files come in one split.
LARGE = {"responses": "lineitem", "answer_text": "conversations", "judge_base": "orders",
         "judge_text": "orders", "reviews": "part", "review_base": "part"}
VERDICT_ORDERS = 50_000   # orders whose verdicts one task expands


def _spark_sql(sql: str) -> str:
    sql = re.sub(r"\$unnest\(([^$]*)\)\$", r"explode(array(\1))", sql)
    sql = sql.replace("$[]$", "cast(array() as array<string>)")
    return re.sub(r"\$\[(.*?)\]\$", r"array(\1)", sql, flags=re.S)


def check_sql(name: str) -> str:
    """The fixture as the SQL check reads it."""
    sql = re.sub(r"\$unnest\(([^$]*)\)\$", r"unnest([\1])", FIXTURES[name])
    sql = sql.replace("$[]$", "CAST([] AS VARCHAR[])")
    return re.sub(r"\$\[(.*?)\]\$", r"[\1]", sql, flags=re.S)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _spark_sql(FIXTURES[name])
    used = [t for t in TABLES if re.search(rf"\b{t}\b(?!')", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    if "{" in re.sub("|".join(r"\{%s\}" % t for t in TABLES), "", sql):
        # literal braces are doubled for the parameter substitution
        marks = {f"{{{t}}}": f"\0{t}\0" for t in used}
        for k, v in marks.items():
            sql = sql.replace(k, v)
        sql = sql.replace("{", "{{").replace("}", "}}")
        for k, v in marks.items():
            sql = sql.replace(v, k)
    tables = {t: table(spark, sf_dir, t) for t in used if "{%s}" % t in sql}
    if LARGE.get(name) in tables:
        large = tables[LARGE[name]]
        tables[LARGE[name]] = (dealt(large, VERDICT_ORDERS, "o_custkey") if LARGE[name] == "orders"
                               else spread(large))
    return spark.sql(sql, **tables)
