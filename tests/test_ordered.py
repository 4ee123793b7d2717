"""Ordered operators agree with a plain window whatever the cuts are."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from traceframe.operators.ordered import Slices, dense_index, interval_sums, with_next, with_previous

CUTS = [(), (5.0,), (2.0, 2.5, 7.0, 30.0), tuple(float(x) for x in range(0, 60, 3))]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    # One key holds most rows; instants repeat.
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", rng.randrange(50), i, rng.randrange(1, 6)) for i in range(400)]
    return spark.createDataFrame(rows, "k STRING, t BIGINT, i BIGINT, w BIGINT").repartition(4).cache()


@pytest.mark.parametrize("cuts", CUTS)
def test_interval_sums_equals_join(spark, points, cuts):
    spans = points.select("k", (F.col("t") - 7).alias("lo"), F.col("t").alias("hi"))
    got = interval_sums(points, "t", spans, "lo", "hi", ["k"], ["w"], slices=Slices(cuts))
    a, b = points.alias("a"), spans.distinct().alias("b")
    want = b.join(a, (F.col("a.k") == F.col("b.k")) & F.col("a.t").between(F.col("b.lo"), F.col("b.hi"))).groupBy(
        "b.k", "b.lo", "b.hi"
    ).agg(F.sum("a.w"))
    assert sorted(map(tuple, got.collect())) == sorted((k, float(lo), float(hi), w) for k, lo, hi, w in want.collect())


@pytest.mark.parametrize("cuts", CUTS)
def test_neighbours_and_numbers(spark, points, cuts):
    w = Window.partitionBy("k").orderBy("t", "i")
    want = points.select(
        "i", F.lag("w").over(w).alias("p"), F.lead("w").over(w).alias("n"), (F.row_number().over(w) - 1).alias("d")
    )
    s = Slices(cuts)
    got = with_previous(points, ["k"], ["t", "i"], ["w"], slices=s)
    got = with_next(got, ["k"], ["t", "i"], ["w"], slices=s)
    got = dense_index(got, ["k"], ["t", "i"], "d", slices=s).select("i", "prev_w", "next_w", "d")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_slices_spread_rows(points):
    s = Slices.of(points, "t", 4)
    sizes = [r["count"] for r in s.assign(points, "t").groupBy("_slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200
