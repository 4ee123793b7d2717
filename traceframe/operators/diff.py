"""Comparing runs: API counts, token fields, material sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.functions import text


def run_diff(events: DataFrame, item: str = "api", run: str = "run_id") -> DataFrame:
    """Per item: lowest and highest count over the runs (0 where absent), constant or not."""
    runs = events.select(run).distinct().agg(F.count(F.lit(1))).scalar()
    counted = events.groupBy(run, item).agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy(item).agg(
        F.count(F.lit(1)).alias("runs_seen"), F.min("n").alias("_low"), F.max("n").alias("max_count")
    )
    everywhere = F.col("runs_seen") == runs
    low = F.when(everywhere, F.col("_low")).otherwise(F.lit(0))
    return out.select(
        item, "runs_seen", low.cast("bigint").alias("min_count"), "max_count",
        (everywhere & (F.col("_low") == F.col("max_count"))).alias("constant"), everywhere.alias("shared"),
    )


def run_ranges(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Lowest and highest number of operations of a run."""
    sizes = events.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_ops"), F.max("n").alias("max_ops"), F.count(F.lit(1)).alias("runs"))


def field_diff(tokens: DataFrame, sep: str, group: str = "group_id", run: str = "run_id") -> DataFrame:
    """Per token field over the runs of a group: same, largest Hamming distance, lengths.

    Tokens missing in some run, or without the delimiter in some run, drop out;
    fields are compared up to the shortest split. Each value is compared with the one
    of the first run, found by an aggregate, so no group is gathered.
    """
    runs = tokens.select(group, run).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("_runs"))
    parts = tokens.withColumn("_f", text.token_fields(F.col("value"), sep))
    common = parts.groupBy(group, "token").agg(
        F.count(F.lit(1)).alias("_seen"), F.count_if(F.col("_f").isNull()).alias("_plain"),
        F.min(F.size("_f")).alias("_short"),
    ).join(runs, group).where("_seen = _runs AND _plain = 0").select(group, "token", "_short")
    rows = parts.join(common, [group, "token"]).select(group, "token", run, "_short", F.explode("_f").alias("f"))
    rows = rows.where(F.col("f.i") < F.col("_short")).select(
        group, "token", run, F.col("f.i").cast("bigint").alias("i"), F.col("f.value").alias("value")
    )
    first = rows.groupBy(group, "token", "i").agg(F.min_by("value", run).alias("first_value"))
    compared = rows.join(first, [group, "token", "i"])
    out = compared.groupBy(group, "token", "i").agg(
        F.bool_and(F.col("value") == F.col("first_value")).alias("same"),
        F.max(text.hamming(F.col("value"), F.col("first_value"))).alias("_distance"),
        F.min(F.length("value")).cast("bigint").alias("min_len"), F.max(F.length("value")).cast("bigint").alias("max_len"),
    )
    distance = F.when(~F.col("same") & (F.col("min_len") == F.col("max_len")), F.col("_distance"))
    return out.select(group, "token", "i", "same", distance.alias("hamming"), "min_len", "max_len")


def set_diff(rows: DataFrame, value: str, run: str, before, after) -> DataFrame:
    """Distinct values added, removed and shared between two runs."""
    seen = rows.where(F.col(run).isin(before, after)).groupBy(value).agg(
        F.bool_or(F.col(run) == before).alias("a"), F.bool_or(F.col(run) == after).alias("b")
    )
    return seen.agg(
        F.count_if(F.col("b") & ~F.col("a")).alias("added"), F.count_if(F.col("a") & ~F.col("b")).alias("removed"),
        F.count_if(F.col("a") & F.col("b")).alias("shared"),
    )
