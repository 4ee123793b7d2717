"""Quality rules whose cutoffs carry a guarantee on false rejections.

A rule rejects a document whose measure is above a cutoff. Within each stratum (by default: the language) labelled good
documents are split in two by a hash of their id. The first half proposes: level by level, from lenient to strict,
every rule's cutoff is the measure that a growing share of good documents exceeds. The second half decides: at each
level it counts the good documents that any rule rejects, and an exact binomial test asks whether the share of false
rejections may still be above ``risk``. Levels are nested and tested in order until one fails, which keeps the error of
a stratum at its share of ``error``; strata share ``error`` evenly (Bonferroni). So with probability ``1 - error`` no
stratum rejects more than ``risk`` of its good documents. A stratum with too few labels for any level rejects nothing.

Documents that fail the base rules are rejected whatever the method says and are no part of the guarantee.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.llm.common import as_bytes, in_slices, stored

SYMBOLS = b"#*$%&|<>"
#: White space, and the bytes that continue a character in UTF-8: what is left counts the characters of words.
NOT_COUNTED = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])
MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Share of good documents that one rule may exceed, from lenient to strict.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen = count()
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(seen)) for w in words), np.int64, n)
    kinds = len(numbers)
    # Numbers of pairs are ranks, so no product outgrows 64 bits, whatever the text's length.
    _, pairs = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)
    _, windows, times = np.unique(pairs[:-1] * kinds + codes[2:], return_inverse=True, return_counts=True)
    again = times[windows] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def measure(raw: bytes) -> tuple[int, ...]:
    """The counts named in ``MEASURED`` of one text."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(raw.translate(None, NOT_COUNTED)), symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measures(docs: DataFrame, stratum: Column) -> DataFrame:
    """doc_id, stratum and the counts of every row's whole text; a null text counts as empty, a null stratum as ''."""

    def run(batches):
        for part in in_slices(batches):
            found = np.array([measure(x) for x in as_bytes(part.column(2))], np.int64).reshape(-1, len(MEASURED))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c) for c in found.T)], names=["doc_id", "stratum", *MEASURED])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in MEASURED))


def rules() -> dict[str, Column]:
    """The measure of each rule: higher is worse; whole thousandths, so that equal texts and near ones share values."""
    mean = (1000 * F.col("word_chars") / F.greatest("n_words", F.lit(1))).cast("long")
    return {
        "long_words": mean,
        "short_words": -mean,
        "symbols": (1000 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).cast("long"),
        "dup_lines": (1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).cast("long"),
        "repeats": (1000 * F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))).cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def good_documents(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Measured rows that labels call good, that pass the base rules, with ``proposes``: the half they belong to.

    Ids whose labels contradict each other, and null ids and labels, are left out.
    """
    agreed = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = 1 and high = 1").select("doc_id")
    )
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return measured.where(~base_failed()).join(agreed, "doc_id").withColumn("proposes", half)


def proposals(good: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """stratum and, for each rule, the cutoffs of all levels, from the proposing half.

    Values are counted first, so what a window orders is one row per distinct value.
    """
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), value.alias("value")) for name, value in rules().items()]))
    counted = good.where("proposes").select("stratum", values.alias("m")).groupBy("stratum", "m.rule", "m.value").agg(F.count("*").alias("n"))
    key = Window.partitionBy("stratum", "rule")
    above = F.sum("n").over(key.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    # The smallest value that a share of at most the level exceeds.
    ranked = counted.select("stratum", "rule", "value", F.coalesce(above, F.lit(0)).alias("above"), F.sum("n").over(key).alias("all"))
    cutoffs = F.array(*[F.min(F.when(F.col("above") <= level * F.col("all"), F.col("value"))) for level in levels])
    return ranked.groupBy("stratum", "rule").agg(cutoffs.alias("cutoffs")).groupBy("stratum").pivot("rule", sorted(rules())).agg(F.first("cutoffs"))


def first_level(levels: int) -> Column:
    """The most lenient level at which a rule rejects the row; ``levels`` if none does. Needs the columns of ``proposals``."""

    def passed(name: str, value: Column) -> Column:
        return F.size(F.filter(F.col(name), lambda cutoff: value <= cutoff))

    return F.least(*[passed(name, value) for name, value in rules().items()], F.lit(levels))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), exactly: the regularised incomplete beta function I(1 - p; n - k, k + 1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def certified(counts: list[int], risk: float, error: float) -> int:
    """How many levels, in order, are shown to reject at most ``risk`` of good documents.

    ``counts[j]`` are the deciding documents that level j is the first to reject; the last entry those no level rejects.
    """
    n, rejected = sum(counts), 0
    for level, here in enumerate(counts[:-1]):
        rejected += here
        # Were the true share above the risk, so few rejections would be seen with at most this probability.
        if not n or binomial_tail(n, rejected, risk) > error:
            return level
    return len(counts) - 1


def choose(good: DataFrame, risk: float = 0.02, error: float = 0.05, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """stratum, cutoffs of each rule, the number of certified levels, and the labelled documents that decided.

    The driver sees, for each stratum, one row of cutoffs and one count per level, whatever the input's size.
    """
    spark = good.sparkSession
    proposed = stored(proposals(good, levels), "cutoffs")
    decided = good.where(~F.col("proposes")).join(proposed, "stratum").groupBy("stratum", first_level(len(levels)).alias("level")).count().collect()
    counts: dict[str, list[int]] = {}
    for row in decided:
        counts.setdefault(row.stratum, [0] * (len(levels) + 1))[row.level] = row["count"]
    names = sorted(rules())
    rows = [
        (r.stratum, certified(counts[r.stratum], risk, error / len(counts)), sum(counts[r.stratum]), *[r[n] for n in names])
        for r in proposed.collect() if r.stratum in counts
    ]
    return spark.createDataFrame(rows, "stratum string, certified int, deciding long, " + ", ".join(f"{n} array<long>" for n in names))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05, levels: tuple[float, ...] = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, stratum and rejecting_level (null: none).

    Null text: empty, so base_failed. Null stratum: ''. Strata without labels keep what passes the base rules. Null and
    repeated ids keep a row each. An empty table gives an empty one. Other columns are not read. Texts are read once; the
    counts go through a stored table. The table of cutoffs has a row per stratum, so the planner broadcasts it by its size.
    """
    measured = stored(measures(docs, F.col(stratum)), "measures")
    chosen = choose(good_documents(measured, labels), risk, error, levels)
    level = F.when(F.col("certified").isNotNull(), first_level(len(levels)))
    rejected = F.coalesce(level < F.col("certified"), F.lit(False))
    return measured.join(chosen, "stratum", "left").select(
        "doc_id", *MEASURED, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), "stratum", F.when(rejected, level).alias("rejecting_level"),
    )
