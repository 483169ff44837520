"""Answer-letter extraction from free response text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions.text import LETTERS, LINE_BREAK, SPACE, letter_at, letters_of, strip

# The phrase patterns that announce an answer, in order of authority.
CANDIDATE = r"(?<![A-Za-z0-9])\(?\*{0,2}([A-H])\*{0,2}\)?(?![A-Za-z0-9])"
HEDGE = rf"{SPACE}*(?:[oO][rR]|/){SPACE}*\(?\*{{0,2}}(?:[A-H]|[b-h])(?![A-Za-z0-9])"
EXPLICIT = rf"answer{SPACE}*[:\-]?{SPACE}*"
STATEMENT = (
    rf"(?:(?:correct|best|final){SPACE}+answer{SPACE}+is"
    rf"|the{SPACE}+answer{SPACE}+(?:is|appears{SPACE}+to{SPACE}+be|would{SPACE}+be|should{SPACE}+be)"
    rf"|my{SPACE}+answer{SPACE}+is|i{SPACE}+(?:would{SPACE}+)?choose|i{SPACE}+select"
    rf"|i{SPACE}+(?:would{SPACE}+)?pick|i'd{SPACE}+(?:choose|pick|go{SPACE}+with)"
    rf"|going{SPACE}+with){SPACE}*")
MENTION = rf"(?:option|choice){SPACE}*"
HARNESS = rf"ANSWER:{SPACE}*\(?([A-H])"
LINE_EDGE = r"[.:)*( ]"
TAIL_CHARS = 400       # the restated-choice rule looks at the closing characters only
MIN_CHOICE_CHARS = 8   # shorter choice texts are too common to count as a restatement


def _announced(text: Column, lead: str, valid: Column) -> Column:
    """Last valid letter after ``lead``; null when it is immediately hedged.

    Group 2 is captured inside a lookahead, so the hedge never consumes text that the
    next match needs.
    """
    pattern = F.lit(f"(?i:{lead}{CANDIDATE})(?=({HEDGE})?)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("letter"),
                         F.regexp_extract_all(text, pattern, F.lit(2)).alias("hedge"))
    usable = F.filter(pairs, lambda p: F.contains(valid, F.upper(p["letter"])))
    last = F.try_element_at(usable, F.lit(-1))
    return F.when(last["hedge"] == "", F.upper(last["letter"]))


def _own_line(text: Column, valid: Column) -> Column:
    """A bare letter on its own line, nearest to the end."""
    lines = F.transform(
        F.split(text, LINE_BREAK),
        lambda s: F.upper(F.regexp_replace(strip(s), rf"\A{LINE_EDGE}+|{LINE_EDGE}+\z", "")))
    return F.try_element_at(
        F.filter(lines, lambda s: (F.length(s) == 1) & F.contains(valid, s)), F.lit(-1))


def _restated(text: Column, choices: Column, tail_chars: int | None) -> Column:
    """The single choice whose full text is repeated at the end of the response."""
    tail = F.lower(text if tail_chars is None else F.right(text, F.lit(tail_chars)))
    hits = F.filter(
        F.transform(choices, lambda c, i: F.when(
            (F.length(strip(c)) >= MIN_CHOICE_CHARS) & F.contains(tail, F.lower(strip(c))), i)),
        lambda i: i.isNotNull())
    return F.when(F.size(hits) == 1, letter_at(F.try_element_at(hits, F.lit(1))))


def answer_letter(text: Column, n_choices: Column, choices: Column | None = None,
                  tail_chars: int | None = TAIL_CHARS) -> Column:
    """The letter a response settles on, or null when it does not settle on one.

    A repeated choice counts within the last ``tail_chars`` characters (None: anywhere).
    """
    body = strip(text)
    valid = letters_of(n_choices)
    rules = [_announced(body, EXPLICIT, valid), _announced(body, STATEMENT, valid),
             _announced(body, MENTION, valid), _own_line(body, valid)]
    if choices is not None:
        rules.append(_restated(body, choices, tail_chars))
    return F.when(F.length(text) > 0, F.coalesce(*rules))


def letter_matches_key(letter: Column, answer_index: Column) -> Column:
    """Correctness; an unparsed response is wrong, not missing."""
    return F.coalesce(F.instr(F.lit(LETTERS), letter) - 1 == answer_index, F.lit(False))


def harness_letter(text: Column) -> Column:
    """The stricter extraction used by the generative harness task: last ``ANSWER: X``."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(HARNESS), F.lit(1)), F.lit(-1))


def exact_match(letter: Column, target: Column) -> Column:
    """1.0 where two answers agree without case and punctuation; no answer agrees with none."""
    def plain(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"\p{Punct}", ""))

    return F.coalesce((plain(letter) == plain(target)).cast("double"), F.lit(0.0))
