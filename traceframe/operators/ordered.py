"""Ordered operators that survive one hot key.

A plain ``PARTITION BY session ORDER BY t`` puts a whole session into one task.
Here the order axis is first cut into slices holding about equal row counts
(quantiles of the order column, a bounded list of numbers), windows run inside
(key, slice), and what crosses a slice border is carried by a summary of one row
per (key, slice). Results are exact whatever the cuts are: the cuts only decide
how the work is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


@dataclass(frozen=True)
class Slices:
    """Cut points of one numeric axis."""

    bounds: tuple[float, ...]

    @classmethod
    def of(cls, df: DataFrame, column: str, count: int | None = None) -> "Slices":
        """Quantiles of ``column``: one aggregation over a single pruned column.

        Inputs of every size are cut alike: into ``count`` slices, or as many as the session has
        shuffle partitions, which is what a cluster sizes to its rows.
        """
        if count is None:
            count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if count == 1:
            return cls(())
        probs = [i / count for i in range(1, count)]
        axis = df.select(F.col(column).cast("double").alias("_axis"))
        values = axis.approxQuantile("_axis", probs, 1.0 / (2 * count))
        return cls(tuple(sorted(set(values))))

    def assign(self, df: DataFrame, column: str | Column) -> DataFrame:
        col = F.col(column) if isinstance(column, str) else column
        if not self.bounds:
            return df.withColumn(SLICE, F.lit(0))
        splits = [float("-inf"), *self.bounds, float("inf")]
        staged = df.withColumn("_axis", col.cast("double"))
        cut = Bucketizer(splits=splits, inputCol="_axis", outputCol="_bucket").transform(staged)
        return cut.withColumn(SLICE, F.col("_bucket").cast("int")).drop("_axis", "_bucket")


def _carry_join(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of the per-(key, slice) summary; keys may be NULL."""
    renamed = carried.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(SLICE).alias("_k_slice"),
        *[c for c in carried.columns if c not in (*keys, SLICE)],
    )
    cond = F.col(SLICE) == F.col("_k_slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(renamed, cond, "left").drop("_k_slice", *[f"_k_{k}" for k in keys])


def interval_sums(
    points: DataFrame,
    time: str,
    intervals: DataFrame,
    lo: str,
    hi: str,
    keys: list[str],
    measures: list[str],
    payload: list[str] | None = None,
    slices: Slices | None = None,
    distinct: bool = False,
) -> DataFrame:
    """For each distinct (keys, lo, hi): sum of every measure over points with
    ``lo <= time <= hi``.

    Points are combined per instant before anything is ordered, each interval turns
    into two probes, and a prefix sum answers both, so no row is compared with any
    other row. ``payload`` columns must be determined by (keys, lo, hi); ``distinct``
    says that no interval is repeated, which saves one shuffle.
    """
    payload = payload or []
    if slices is None:
        axis_rows = points.select(F.col(time).cast("double").alias("_t"))
        axis_rows = axis_rows.unionAll(intervals.select(F.col(hi).cast("double").alias("_t")))
        slices = Slices.of(axis_rows, "_t")
    instants = points.groupBy(*keys, F.col(time).cast("double").alias("_t")).agg(
        *[F.sum(m).alias(f"_m_{m}") for m in measures]
    )
    zero = [F.lit(0).cast(dict(instants.dtypes)[f"_m_{m}"]).alias(f"_m_{m}") for m in measures]
    who = F.struct(
        F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi"),
        *[F.col(c) for c in payload],
    )
    probes = intervals.select(*keys, who.alias("_who")).select(
        *keys,
        "_who",
        F.explode(
            F.array(
                F.struct(F.col("_who.lo").alias("t"), F.lit(0).alias("tag")),
                F.struct(F.col("_who.hi").alias("t"), F.lit(2).alias("tag")),
            )
        ).alias("_probe"),
    ).select(*keys, F.col("_probe.t").alias("_t"), F.col("_probe.tag").alias("_tag"), "_who", *zero)
    who_type = dict(probes.dtypes)["_who"]
    if not distinct:
        probes = probes.dropDuplicates([*keys, "_t", "_tag", "_who"])
    axis = instants.select(
        *keys, "_t", F.lit(1).alias("_tag"), F.lit(None).cast(who_type).alias("_who"),
        *[f"_m_{m}" for m in measures],
    ).unionByName(probes)
    axis = slices.assign(axis, "_t")

    inside = Window.partitionBy(*keys, SLICE).orderBy("_t", "_tag").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = axis.select(
        *keys, SLICE, "_tag", "_who",
        *[F.sum(f"_m_{m}").over(inside).alias(f"_p_{m}") for m in measures],
    ).where(F.col("_tag") != 1)
    sign = F.when(F.col("_tag") == 2, F.lit(1)).otherwise(F.lit(-1))
    if slices.bounds:
        running = _with_offsets(running, axis, keys, measures)
    else:
        running = running.select("*", *[F.lit(0).alias(f"_o_{m}") for m in measures])
    out = running.groupBy(*keys, "_who").agg(
        *[F.sum(sign * (F.col(f"_p_{m}") + F.col(f"_o_{m}"))).alias(m) for m in measures]
    )
    return out.select(
        *keys, F.col("_who.lo").alias(lo), F.col("_who.hi").alias(hi),
        *[F.col(f"_who.{c}").alias(c) for c in payload], *measures,
    )


def _with_offsets(running: DataFrame, axis: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Add what the earlier slices of the same key sum up to."""
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = axis.groupBy(*keys, SLICE).agg(*[F.sum(f"_m_{m}").alias(f"_s_{m}") for m in measures])
    offsets = totals.select(
        *keys, SLICE, *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    return _carry_join(running, offsets, keys)


def _neighbour(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], prefix: str,
    forward: bool, slices: Slices | None,
) -> DataFrame:
    if slices is None:
        slices = Slices.of(df, order[0])
    rows = slices.assign(df, order[0])
    value = F.struct(*[F.col(v) for v in values])
    rank = F.struct(*[F.col(c) for c in order])
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    step = F.lead if forward else F.lag
    rows = rows.withColumn("_near", step(value).over(inside))
    if not slices.bounds:
        return rows.select(
            *df.columns, *[F.col("_near").getField(v).alias(f"{prefix}{v}") for v in values]
        )
    across = Window.partitionBy(*keys).orderBy(SLICE)
    edge = F.min_by(value, rank) if forward else F.max_by(value, rank)
    edges = slices.assign(df, order[0]).groupBy(*keys, SLICE).agg(edge.alias("_edge"))
    carried = edges.select(*keys, SLICE, step("_edge").over(across).alias("_carried"))
    joined = _carry_join(rows, carried, keys)
    near = F.coalesce(F.col("_near"), F.col("_carried"))
    return joined.select(
        *[c for c in df.columns], *[near.getField(v).alias(f"{prefix}{v}") for v in values]
    )


def with_previous(df, keys, order, values, prefix="prev_", slices=None) -> DataFrame:
    """The values of the preceding row of each key (LAG)."""
    return _neighbour(df, keys, order, values, prefix, False, slices)


def with_next(df, keys, order, values, prefix="next_", slices=None) -> DataFrame:
    """The values of the following row of each key (LEAD)."""
    return _neighbour(df, keys, order, values, prefix, True, slices)


def dense_index(
    df: DataFrame, keys: list[str], order: list[str], name: str = "dense_index",
    start: int = 0, slices: Slices | None = None,
) -> DataFrame:
    """Consecutive numbers per key in the given order (ROW_NUMBER - 1 + start)."""
    if slices is None:
        slices = Slices.of(df, order[0])
    rows = slices.assign(df, order[0])
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(inside))
    if not slices.bounds:
        return rows.select(*df.columns, (F.col("_rn") - 1 + start).cast("bigint").alias(name))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = slices.assign(df, order[0]).groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *keys, SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    numbered = _carry_join(rows, offsets, keys)
    number = (F.col("_rn") - 1 + F.col("_offset") + start).cast("bigint")
    return numbered.select(*df.columns, number.alias(name))
