"""Expressions over call metadata: served model, error class, work keys, effort, seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The effort ladder.
EFFORTS = ("low", "medium", "high", "xhigh", "max")

DATED = r"^-[0-9]{8}$"  # fixed value: the snapshot-date suffix of a model id


def served_ok(requested: Column, served: Column) -> Column:
    """True unless the serving model is provably another one.

    Unknown is accepted; an alias and its dated snapshot are the same model either way
    round; every other suffix is a different model.
    """
    def dated(longer: Column, base: Column) -> Column:
        return F.startswith(longer, base) & F.substr(longer, F.length(base) + 1).rlike(DATED)

    return (served.isNull() | (served == "") | (served == requested)
            | dated(served, requested) | dated(requested, served))


def any_served_ok(requested: Column, served_all: Column) -> Column:
    """True when the requested model is among the comma-separated serving models."""
    names = F.filter(F.split(F.coalesce(served_all, F.lit("")), ","), lambda s: s != "")
    return F.exists(names, lambda s: served_ok(requested, s))


def dominant_model(usage: Column) -> Column:
    """Key of a usage map with the largest (output tokens, cost); the first key on a tie.

    ``usage`` is MAP<STRING, STRUCT<outputTokens BIGINT, costUSD DOUBLE>>.
    """
    weighed = F.transform(F.map_entries(usage), lambda e, at: F.struct(
        F.coalesce(e["value"]["outputTokens"], F.lit(0).cast("bigint")).alias("tokens"),
        F.coalesce(e["value"]["costUSD"], F.lit(0.0)).alias("cost"),
        (-at).alias("first"), e["key"].alias("model")))
    return F.array_max(weighed)["model"]


def all_models(usage: Column) -> Column:
    """Comma-joined usage keys, only when more than one model took part."""
    return F.when(F.size(usage) > 1, F.array_join(F.map_keys(usage), ","))


def is_permanent(error: Column, markers: list[str]) -> Column:
    """Whether an error holds one of the markers of what no retry can heal, in any case.

    Markers are configuration of the backends in use. A missing error is not permanent.
    """
    pattern = "|".join(rf"\Q{m.lower()}\E" for m in markers)
    return F.coalesce(F.lower(error).rlike(pattern), F.lit(False)) if markers else F.lit(False)


def work_key(backend: Column, model: Column, system: Column, prompt: Column,
             effort: Column, run_index: Column) -> Column:
    """Content address of one call."""
    payload = F.struct(backend.alias("b"), effort.alias("e"), model.alias("m"),
                       prompt.alias("p"), run_index.cast("int").alias("r"), system.alias("s"))
    return F.sha2(F.to_json(payload), 256)


def next_effort(effort: Column) -> Column:
    """One rung up the effort ladder, capped; an unknown effort counts as the second rung."""
    ladder = F.array(*[F.lit(e) for e in EFFORTS])
    found = F.array_position(ladder, effort)
    position = F.when(F.coalesce(found, F.lit(0)) > 0, found).otherwise(F.lit(2))
    return F.try_element_at(ladder, F.least(position + 1, F.lit(len(EFFORTS))).cast("int"))


def child_seed(base: int, *labels: Column) -> Column:
    """Seed derived from labels: the first 8 digest bytes, modulo 2**63."""
    label = F.concat_ws(":", F.lit(str(base)), *labels)
    top = F.conv(F.substring(F.sha2(label, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (top % F.lit(str(2**63)).cast("decimal(20,0)")).cast("bigint")


def draw_hash(seed: int, *keys: Column) -> Column:
    """Order-free random key of a row: depends on the seed and the row's key alone."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)
