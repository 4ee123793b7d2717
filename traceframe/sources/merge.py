"""Merging injected observations into native traces on one clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.operators.ordered import dense_index, interval_sums

# Fixed value: wall clocks at or below this are not epoch microseconds.
MIN_WALL_US = 1e12


def clock_offsets(native: DataFrame) -> DataFrame:
    """Upper median of (mono - wall) per trace.

    Offsets are counted per distinct value and ranked by a running count, so one
    large trace is never sorted in one task.
    """
    diffs = native.where(
        F.col("mono_time_us").isNotNull() & (F.col("wall_time_us") > MIN_WALL_US)
    ).select("trace_id", (F.col("mono_time_us") - F.col("wall_time_us")).cast("double").alias("d"), F.lit(1).cast("bigint").alias("n"))
    values = diffs.select("trace_id", "d").distinct().select(
        "trace_id", F.lit(float("-inf")).alias("lo"), F.col("d").alias("hi")
    )
    ranked = interval_sums(diffs, "d", values, "lo", "hi", ["trace_id"], ["n"], distinct=True)
    sizes = diffs.groupBy("trace_id").agg(F.sum("n").alias("total"))
    middle = F.floor(F.col("total") / 2) + 1
    return (
        ranked.join(sizes, "trace_id").where(F.col("n") >= middle)
        .groupBy("trace_id").agg(F.min("hi").alias("offset_us"))
    )


def align_clock(native: DataFrame, injected: DataFrame) -> DataFrame:
    """Injected rows that have a wall clock, moved onto the native monotonic clock.

    A trace without a usable native pair yields no rows.
    """
    timed = injected.where(F.col("wall_time_us").isNotNull())
    return timed.join(clock_offsets(native), "trace_id").withColumn(
        "mono_time_us", F.col("wall_time_us") + F.col("offset_us")
    )


def append_injected(native: DataFrame, injected: DataFrame, schema_version: int = 1) -> DataFrame:
    """Native rows followed by the aligned injected rows as a session of their own."""
    if schema_version not in (1, 2):
        raise ValueError(f"unsupported schema version: {schema_version}")
    aligned = dense_index(align_clock(native, injected), ["trace_id"], ["file_index"], "seq", start=1)
    last = native.groupBy("trace_id").agg(
        F.max("global_seq").alias("_last_global"), F.max("file_index").alias("_last_index")
    )
    # Fixed format of the synthetic session name.
    session = F.concat(F.lit("inject:"), F.substring(F.sha2(F.encode("trace_id", "UTF-8"), 256), 1, 16))
    have = set(aligned.columns)
    pick = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    phase = F.coalesce(
        F.nullif(pick("phase", "string"), F.lit("")), F.nullif(pick("t", "string"), F.lit("")), F.lit("call")
    )
    rows = aligned.join(last, "trace_id").withColumns(
        {
            "schema_version": F.lit(schema_version).cast("bigint"),
            "session_id": session,
            "session_seq": F.col("seq"),
            "event_id": F.concat(session, F.lit(":"), F.col("seq").cast("string")),
            "phase": phase,
            "t": phase,
            "ts": F.col("wall_time_us").cast("double"),
            # Continued only when the native producer numbers its events.
            "global_seq": F.col("_last_global") + F.col("seq"),
            "file_index": F.col("_last_index") + F.col("seq"),
            "pid": F.coalesce(pick("pid", "bigint"), F.lit(0)),
            "tid": F.coalesce(pick("tid", "bigint"), F.lit(0)),
            "frame_url": F.coalesce(pick("frame_url", "string"), F.lit("")),
            "origin": F.coalesce(pick("origin", "string"), F.lit("")),
            "truncated": F.coalesce(pick("truncated", "boolean"), F.lit(False)),
        }
    )
    if schema_version == 2:
        rows = rows.withColumns(
            {
                "call_id": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("string"),
                "depth": F.lit(0).cast("bigint"), "causality_kind": F.lit("external"),
                "duration_us": F.lit(None).cast("bigint"),
            }
        )
    rows = rows.drop("offset_us", "_last_global", "_last_index")
    return native.unionByName(rows, allowMissingColumns=True)
