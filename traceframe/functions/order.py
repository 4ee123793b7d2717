"""Order and time of an event.

Order is the first of file index, global sequence, clocks and sequence that is
present; time looks at the clocks only and falls back to the order, so a file
index never widens a time window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_KEYS = ("file_index", "global_seq", "mono_time_us", "wall_time_us", "ts", "seq")
TIME_KEYS = ("mono_time_us", "wall_time_us", "ts")
ORDER_FIELDS = ("file_index", "global_seq", "session_seq", "mono_time_us", "wall_time_us", "ts")


def _first_present(df: DataFrame, keys) -> list[Column]:
    return [F.col(k).cast("double") for k in keys if k in df.columns]


def event_order(df: DataFrame) -> Column:
    return F.coalesce(*_first_present(df, ORDER_KEYS), F.lit(0.0))


def event_time(df: DataFrame) -> Column:
    """The first clock that a row has, else its order, so a row without a clock keeps a place."""
    return F.coalesce(*_first_present(df, TIME_KEYS), event_order(df))


def with_order(df: DataFrame) -> DataFrame:
    """Add ``event_order`` and ``event_time_us`` from whichever columns exist."""
    return df.withColumn("event_order", event_order(df)).withColumn("event_time_us", event_time(df))
