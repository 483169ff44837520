"""Row validation of test items: every rule is a column, errors come as an array."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import DIFFICULTIES, strip

# Length limits of the item schema.
MIN_STEM, MIN_PROMPT = 10, 20
MIN_CHOICES, MAX_CHOICES = 3, 6

# Columns that a table of one format need not have.
OPTIONAL = {"question": "string", "choices": "array<string>", "answer_index": "int",
            "distractor_types": "array<string>", "source": "string", "prompt": "string",
            "rubric": "struct<must_include:array<string>,should_not:array<string>,"
                      "ideal_reasoning_pattern:string>"}


ERRORS = "array<struct<code:string,field:string,detail:string>>"


def vocabulary(taxonomy: DataFrame, types: DataFrame) -> dict[str, Column]:
    """What each pack allows, as constant maps by pack: ``axes``, ``kinds`` and ``dimensions`` (of
    each dimension its axis and formats).

    ``taxonomy``: pack, dimension, axis, format.  ``types``: pack, type.  Both are configuration,
    so they are read once and items look them up without a join.
    """
    axes, kinds, dims = defaultdict(set), defaultdict(set), defaultdict(dict)
    for r in taxonomy.select("pack", "dimension", "axis", "format").distinct().collect():
        axes[r.pack].add(r.axis)
        own = dims[r.pack].setdefault(r.dimension, {"axis": r.axis, "formats": []})
        own["axis"] = max(own["axis"], r.axis)
        own["formats"].append(r.format)
    for r in types.select("pack", "type").distinct().collect():
        kinds[r.pack].add(r.type)

    def constant(table: dict, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")

    pack = F.col("pack")
    return {
        "axes": F.try_element_at(constant({k: sorted(v) for k, v in axes.items()}, "array<string>"), pack),
        "kinds": F.try_element_at(constant({k: sorted(v) for k, v in kinds.items()}, "array<string>"), pack),
        "dimension": F.try_element_at(F.try_element_at(constant(
            dims, "map<string,struct<axis:string,formats:array<string>>>"), pack), F.col("dimension"))}


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _unless(ok: Column, code: str, field: str, detail: Column | None = None) -> Column:
    """An error when ``ok`` is false or unknown."""
    shown = F.lit(None) if detail is None else detail
    return F.when(~_holds(ok), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"),
                                        shown.cast("string").alias("detail")))


def _vocabulary_errors(fmt: str, allowed: dict[str, Column]) -> list[Column]:
    """Values that the pack does not list, and an axis other than the dimension's own."""
    dimension = allowed["dimension"]
    own = dimension["axis"]
    return [
        _unless(F.col("difficulty").isin(*DIFFICULTIES), "unlisted", "difficulty", F.col("difficulty")),
        _unless(F.array_contains(dimension["formats"], fmt), "unlisted", "dimension", F.col("dimension")),
        _unless(F.array_contains(allowed["axes"], F.col("axis")), "unlisted", "axis", F.col("axis")),
        _unless(own.isNull() | F.col("axis").eqNullSafe(own), "foreign", "axis", own)]


def _type_errors(n: Column, at_key: Column, kinds: Column) -> Column:
    """The first thing wrong with the types of the choices; without types nothing is."""
    types = F.col("distractor_types")
    correct = F.size(F.filter(types, lambda t: t.eqNullSafe("correct")))
    listed = F.forall(types, lambda t: _holds(F.array_contains(kinds, t)))
    found = F.coalesce(
        _unless(F.size(types) == n, "length", "distractor_types", F.size(types)),
        _unless(listed, "unlisted", "distractor_types"),
        _unless(correct == 1, "keys", "distractor_types", correct),
        _unless(at_key, "off_key", "distractor_types"))
    return F.when(types.isNotNull(), found)


def choice_errors(allowed: dict[str, Column]) -> Column:
    """Errors of an MC item."""
    n, key = F.size("choices"), F.col("answer_index")
    usable = _holds(n.between(MIN_CHOICES, MAX_CHOICES))
    plain = F.transform("choices", lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))
    reachable = _holds((key >= 0) & (key < n))
    at_key = ~reachable | (F.try_element_at("distractor_types", (key + 1).cast("int")) == "correct")
    within = [  # looked at only when there is a list to look at
        _unless(reachable, "range", "answer_index", key),
        _unless(~F.array_contains(plain, ""), "blank", "choices"),
        _unless(F.size(F.array_distinct(plain)) == n, "repeat", "choices"),
        _type_errors(n, at_key, allowed["kinds"])]
    return F.array_compact(F.array(
        *_vocabulary_errors("mc", allowed),
        _unless(F.length(strip(F.col("question"))) >= MIN_STEM, "short", "question"),
        _unless(F.length("source") > 0, "absent", "source"),
        _unless(usable, "length", "choices", n),
        *[F.when(usable, e) for e in within]))


def open_errors(allowed: dict[str, Column]) -> Column:
    """Errors of an open item."""
    rubric = F.col("rubric")
    filled = {"must_include": F.size(rubric["must_include"]) > 0,
              "should_not": F.size(rubric["should_not"]) > 0,
              "ideal_reasoning_pattern": F.length(rubric["ideal_reasoning_pattern"]) > 0}
    return F.array_compact(F.array(
        *_vocabulary_errors("open", allowed),
        _unless(F.length(strip(F.col("prompt"))) >= MIN_PROMPT, "short", "prompt"),
        _unless(rubric.isNotNull(), "absent", "rubric"),
        *[F.when(rubric.isNotNull(), _unless(ok, "absent", f"rubric.{name}"))
          for name, ok in filled.items()]))


def validate_items(items: DataFrame, taxonomy: DataFrame, types: DataFrame) -> DataFrame:
    """Adds ``errors``: an array of (code, field, detail), empty for a valid item.

    Codes: ``unlisted`` (a value the pack does not allow), ``foreign`` (an axis other than the
    dimension's, which is the detail), ``short``, ``absent``, ``length`` (of a list), ``blank`` and
    ``repeat`` (choices), ``range`` (the key), ``keys`` (not one correct type) and ``off_key`` (it is
    elsewhere). Items of all packs and both formats go in one pass, without a join.
    """
    allowed = vocabulary(taxonomy, types)
    errors = (F.when(F.col("format") == "mc", choice_errors(allowed))
               .when(F.col("format") == "open", open_errors(allowed))
               .otherwise(F.array(_unless(F.lit(False), "unlisted", "format", F.col("format")))))
    absent = {c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in items.columns}
    return (items.withColumns(absent).withColumn("errors", errors.cast(ERRORS)).drop(*absent)
            if absent else items.withColumn("errors", errors.cast(ERRORS)))


def shown(errors: str = "errors") -> Column:
    """Errors as one line of text."""
    return F.array_join(F.transform(errors, lambda e: F.concat_ws(" ", e["code"], e["field"], e["detail"])), "; ")


def fill_from_cell(parsed: DataFrame, json_column: str,
                   fields: tuple[str, ...] = ("format", "axis", "dimension", "difficulty")
                   ) -> DataFrame:
    """Fill *absent* fields from the authoring cell's ``cell_<field>`` columns.

    A key that is present with a null value stays null and fails validation.
    """
    keys = F.json_object_keys(json_column)
    return parsed.withColumns({
        f: F.when(F.array_contains(keys, f), F.col(f)).otherwise(F.col(f"cell_{f}"))
        for f in fields}).drop(*[f"cell_{f}" for f in fields])
