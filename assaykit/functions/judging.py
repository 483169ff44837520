"""Judge and reviewer payloads: JSON salvage from prose and numeric sanitising."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.session import computed_once

PATTERN_DEPTH = 32      # nesting that the pattern follows; it hands on what is deeper
LOW, HIGH = 1.0, 5.0    # fixed values: the rating scale

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _pattern(strings: bool) -> str:
    """Possessive pattern: group 1 is one balanced ``{...}``; empty where an object does not
    close within ``PATTERN_DEPTH``, which also ends the search."""
    plain, other = ('[^{}"]*+', [_STRING]) if strings else ("[^{}]*+", [])

    def closed(*inner: str) -> str:
        return rf"\{{{plain}(?:(?:{'|'.join(inner)}){plain})*+\}}" if inner else rf"\{{{plain}\}}"

    body = reduce(lambda inner, _: closed(*other, inner), range(PATTERN_DEPTH - 1), closed(*other))
    return rf"(?s)({body})|\{{.*"


_PATTERNS = {strings: _pattern(strings) for strings in (True, False)}
_TOKENS = {True: re.compile(r'[{}]|"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)', re.S), False: re.compile("[{}]")}


def spans(text: str, strings: bool = True) -> list[str]:
    """Top-level balanced ``{...}`` of any depth, in order.

    Braces and whole strings are the only tokens; the depth is their running sum and an object
    ends where it returns to 0. One that never closes swallows the rest and is none.
    """
    out, at = [], text.find("{")
    while at >= 0:
        depth, end = 0, -1
        for token in _TOKENS[strings].finditer(text, at):
            first = text[token.start()]
            depth += 1 if first == "{" else -1 if first == "}" else 0
            if depth == 0:
                end = token.end()
                break
        if end < 0:
            break
        out.append(text[at:end])
        at = text.find("{", end)
    return out


def _scanner(strings: bool):
    @F.pandas_udf("array<string>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else spans(t, strings))

    return scan


def with_objects(df: DataFrame, text: Column, into: str, strings: bool = True) -> DataFrame:
    """Adds the top-level balanced ``{...}`` spans of a text, in order, null for a null text.

    The pattern finds them where no object nests deeper than it follows. A rest that does not
    match and opens no more braces than that never closes and is none. Other texts go to the
    token scan, which has the same meaning of an object; the rest pass it by as nulls. Braces
    inside strings of an object do not count, unless ``strings`` is off.
    """
    def opened(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit("{"), F.lit("")))

    # evaluated once, the text too: it may cost as much as the search
    held = df.select("*", computed_once(text).alias("_text"))
    found = held.select("*", computed_once(
        F.regexp_extract_all("_text", F.lit(_PATTERNS[strings]), F.lit(1))).alias("_found"))
    ends = F.try_element_at("_found", F.lit(-1)) == ""
    deep = opened(F.col("_text")) - opened(F.array_join("_found", "")) > PATTERN_DEPTH
    scanned = _scanner(strings)(F.when(ends & deep, F.col("_text")))
    closed = F.when(ends, F.slice("_found", 1, F.size("_found") - 1)).otherwise(F.col("_found"))
    return found.withColumn(into, F.coalesce(scanned, closed)).drop("_text", "_found")


def with_last_object(df: DataFrame, text: Column, into: str,
                     required: list[str] | None = None) -> DataFrame:
    """Adds the last span that parses as a JSON object and holds all ``required`` keys, as a
    VARIANT; null without one. Keys must be present; their values may be null. Spans are parsed
    from the last one on until one is found, each once."""
    def usable(v: Column) -> Column:
        # a JSON null is a value here, a missing key is none
        has = [F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in required or []]
        return reduce(lambda a, b: a & b, has, v.isNotNull())

    def parsed(span: Column) -> Column:
        one = F.transform(F.array(span), lambda s: F.try_parse_json(s))
        return F.try_element_at(F.filter(one, usable), F.lit(1))

    last = F.aggregate(F.reverse("_spans"), F.lit(None).cast("variant"),
                       lambda found, span: F.when(found.isNotNull(), found).otherwise(parsed(span)))
    return (with_objects(df, text, "_spans")
            .select("*", computed_once(last).alias(into)).drop("_spans"))


def number(payload: Column, key: str) -> Column:
    """A numeric field of a VARIANT; numeric strings count, anything else is missing.

    NaN is treated as missing.
    """
    v = F.try_variant_get(payload, f"$.{key}", "double")
    return F.when(~F.isnan(v), v)


def with_numbers(df: DataFrame, payload: Column, names: dict[str, str]) -> DataFrame:
    """Adds numeric fields of a VARIANT (column name to key), each read once; see ``number``."""
    read = F.struct(*[F.try_variant_get(payload, f"$.{k}", "double").alias(c)
                      for c, k in names.items()])
    held = df.select("*", F.inline(F.array(read)))
    return held.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def clamped(v: Column) -> Column:
    """A number clamped to the rating scale."""
    return F.when(v.isNotNull(), F.greatest(F.lit(LOW), F.least(F.lit(HIGH), v)))


def counts(v: Column) -> Column:
    """A number as a count; negative ones are missing, never zero."""
    return F.when(v >= 0, v)


def rating(payload: Column, key: str) -> Column:
    """A judge rating clamped to the scale."""
    return clamped(number(payload, key))


def tally(payload: Column, key: str) -> Column:
    """A non-negative count; negative or unreadable counts are missing, never zero."""
    return counts(number(payload, key))


def strict_number(payload: Column, key: str) -> Column:
    """A field that already is a JSON number; used where strings do not count."""
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|TINYINT|SMALLINT|BOOLEAN)"),
                  F.try_variant_get(payload, f"$.{key}", "double"))
