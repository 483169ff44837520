"""Last and first record per key, by one BIGINT sequence per source.

A sequence and fixed-width values keep aggregation buffers mutable, so these are hash aggregations
that combine before the shuffle. Rows with text are fetched by their winners' sequence numbers
instead of travelling through buffers. A sequence number stands for one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def packed(*parts: tuple[Column, int]) -> Column:
    """Non-negative integers of so many bits each as one BIGINT that sorts like the tuple.

    A value that does not fit stops the job.
    """
    if sum(bits for _, bits in parts) > 63:
        raise ValueError("a sequence holds 63 bits")
    out = F.lit(0).cast("bigint")
    for value, bits in parts:
        fits = F.when((value >= 0) & (value < 1 << bits), value.cast("bigint")).otherwise(
            F.raise_error(F.lit(f"sequence part exceeds {bits} bits")).cast("bigint"))
        out = out * (1 << bits) + fits
    return out


def last_values(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per key, the fixed-width columns of the row with the largest ``seq``.

    Other columns go. Rows without a sequence number do not count.
    """
    values = [f.name for f in df.schema if isinstance(f.dataType, FIXED)
              and f.name not in (*keys, seq)]
    return df.groupBy(*keys).agg(*[F.max_by(c, seq).alias(c) for c in values])


def rows_of(df: DataFrame, winners: DataFrame, seq: str) -> DataFrame:
    """The complete rows whose ``seq`` is in ``winners``."""
    return df.join(winners.select(seq), seq, "left_semi").select(*df.columns)


def first_rows(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The complete row with the smallest ``seq`` of every ``key``."""
    return rows_of(df, df.groupBy(key.alias("_key")).agg(F.min(seq).alias(seq)), seq)


def last_rows(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The complete row with the largest ``seq`` of every ``key``."""
    return rows_of(df, df.groupBy(key.alias("_key")).agg(F.max(seq).alias(seq)), seq)
