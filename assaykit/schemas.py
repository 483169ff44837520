"""Explicit read schemas.  Everything is nullable: absent and null both mean *missing*."""

ITEM_MC = """format STRING, axis STRING, dimension STRING, difficulty STRING, question STRING,
    choices ARRAY<STRING>, answer_index INT, distractor_types ARRAY<STRING>, source STRING,
    notes STRING, question_id STRING"""

ITEM_OPEN = """format STRING, axis STRING, dimension STRING, difficulty STRING, prompt STRING,
    rubric STRUCT<must_include: ARRAY<STRING>, should_not: ARRAY<STRING>,
                  ideal_reasoning_pattern: STRING>, question_id STRING"""

#: superset used when MC and open rows share one file
ITEM_ANY = ITEM_MC.replace("question_id STRING", "") + """ prompt STRING,
    rubric STRUCT<must_include: ARRAY<STRING>, should_not: ARRAY<STRING>,
                  ideal_reasoning_pattern: STRING>, question_id STRING"""

COHORT = "model STRING, tier STRING, label STRING, generation DOUBLE, backend STRING, ord INT"

MC_RESPONSE = """format STRING, model STRING, tier STRING, label STRING, question_id STRING,
    dimension STRING, difficulty STRING, axis STRING, run_index INT, model_served STRING,
    served_all STRING, provider_model STRING, call_ok BOOLEAN, stop_reason STRING,
    called_at STRING, answer_index INT, parsed_letter STRING, correct BOOLEAN,
    parse_ok BOOLEAN, cost_usd DOUBLE, input_tokens BIGINT, output_tokens BIGINT,
    duration_ms BIGINT, attempts INT, cache_hit BOOLEAN, error STRING, text STRING"""

OPEN_RESPONSE = """model STRING, tier STRING, label STRING, question_id STRING, dimension STRING,
    difficulty STRING, run_index INT, call_ok BOOLEAN, model_served STRING, served_all STRING,
    provider_model STRING, stop_reason STRING, called_at STRING, error STRING, attempts INT,
    cache_hit BOOLEAN, text STRING, cost_usd DOUBLE, input_tokens BIGINT, output_tokens BIGINT"""

JUDGE_RAW = """model STRING, question_id STRING, run_index INT, persona STRING,
    judge_model STRING, judge_role STRING, call_ok BOOLEAN, parse_ok BOOLEAN,
    judge_served STRING, judge_served_all STRING, error STRING, called_at STRING,
    scores VARIANT"""

OPEN_SCORE = """model STRING, tier STRING, label STRING, question_id STRING, dimension STRING,
    difficulty STRING, run_index INT, judge_model STRING, composite_100 DOUBLE,
    dim_means MAP<STRING, DOUBLE>, must_include_coverage DOUBLE,
    mean_should_not_violations DOUBLE, n_judges INT"""

REVIEW = """question_id STRING, persona STRING, parse_ok BOOLEAN, resolicited BOOLEAN,
    review VARIANT"""

POSITION_MAP = "question_id STRING, `order` ARRAY<INT>, answer_from INT, answer_to INT"

CALL_CACHE = """key STRING, ok BOOLEAN, text STRING, model_requested STRING, model_served STRING,
    effort STRING, input_tokens BIGINT, output_tokens BIGINT, cost_usd DOUBLE,
    duration_ms BIGINT, attempts INT, error STRING, called_at STRING"""

MANIFEST = """run_id STRING, phase STRING, written_at STRING, pack STRING,
    cohort ARRAY<STRING>, run_config STRING, n_items INT, n_runs INT, judge_model STRING,
    personas ARRAY<STRING>"""
