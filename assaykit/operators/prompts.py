"""Prompt projections: templates are configuration, the rest are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import letter_at

# Defaults; a pack brings its own. What answer extraction reads is the last line's form.
MC_TEMPLATE = ("{question}\n\n{options}\n\nGive your reasons first. The last line holds the letter "
               "alone:\nANSWER: <letter>")
HARNESS_TEMPLATE = "{question}\n\n{options}\n\nLast line: ANSWER: <letter>"
OPEN_TEMPLATE = "{prompt}"


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders in one pass; text inside the data is never re-read."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[fields[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)
                      if i % 2 or p])


def render_by_pack(templates: dict[str, str], fields: dict[str, Column]) -> Column:
    """The template of each row's pack, many packs in one job."""
    return F.coalesce(*[F.when(F.col("pack") == pack, render(t, fields))
                        for pack, t in templates.items()])


def options(choices: Column) -> Column:
    """Lettered choices, one per line."""
    return F.array_join(F.transform(
        choices, lambda c, i: F.concat(letter_at(i), F.lit(". "), c)), "\n")


def bullets(points: Column) -> Column:
    """Rubric points as an indented list."""
    return F.array_join(F.transform(points, lambda p: F.concat(F.lit("  - "), p)), "\n")


def mc_prompt(template: str = MC_TEMPLATE) -> Column:
    return render(template, {"question": F.col("question"), "options": options(F.col("choices"))})


def open_prompt(template: str = OPEN_TEMPLATE) -> Column:
    return render(template, {"prompt": F.col("prompt")})


def judge_prompt(template: str) -> Column:
    """Needs prompt, rubric, text (the response) and persona_text."""
    r = F.col("rubric")
    return render(template, {
        "persona": F.col("persona_text"), "prompt": F.col("prompt"),
        "must": bullets(r["must_include"]), "avoid": bullets(r["should_not"]),
        "ideal": r["ideal_reasoning_pattern"], "response": F.col("text")})


def mc_review_prompt(template: str) -> Column:
    """Blind: the key is not among the fields a template can reach."""
    return render(template, {
        "dimension": F.col("dimension"), "difficulty": F.col("difficulty"),
        "question": F.col("question"), "options": options(F.col("choices"))})


def open_review_prompt(template: str) -> Column:
    r = F.col("rubric")
    return render(template, {
        "dimension": F.col("dimension"), "difficulty": F.col("difficulty"),
        "prompt": F.col("prompt"), "must": F.array_join(r["must_include"], "; "),
        "avoid": F.array_join(r["should_not"], "; "), "ideal": r["ideal_reasoning_pattern"]})


def authoring_prompt(template: str) -> Column:
    """Needs the cell columns of ``bank.quota_plan`` plus axis and description."""
    return render(template, {
        "count": F.col("count").cast("string"), "dimension": F.col("dimension"),
        "description": F.col("description"), "axis": F.col("axis"),
        "difficulty": F.col("difficulty"), "subtopics": F.array_join("subtopics", "; ")})


def harness_dataset(items: DataFrame) -> DataFrame:
    """Items as prompt text and target letter for an external harness."""
    return items.select("question_id", mc_prompt(HARNESS_TEMPLATE).alias("doc_text"),
                        letter_at(F.col("answer_index")).alias("target"))
