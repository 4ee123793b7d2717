"""Audit of filters that are applied one after another, kept up to date file by file.

Five filters, A to E, each fail some documents. Which one removes a document depends on their order, so what is kept is
one counter for each part and *mask* (the set of filters that a document fails) and each kind of label: all 120 orders
are read off those counters. A to D look at one text. E fails a document whose text a smaller id has too, anywhere in
the table, so a mask may change when a later file brings a smaller id.

The documents' files are read as available-now micro-batches of a stream. State is keyed by the text's SHA-256 (texts
share state rows by buckets of it) and holds its smallest id so far with the masks of the rows that have it. A row with
a larger id fails E at once. A smaller id takes the place, and the rows that held it are retracted: their counter loses
them without E and gains them with E.
Each batch appends its changes, summed within tasks, to a table of the shared folder; the checkpoint beside it makes each
file count exactly once, also after a lost executor or a restart. The counters are the sums of those changes.

A text that a third of all rows share is summed within each task before it reaches its state.
"""

from __future__ import annotations

import hashlib
import json
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import as_bytes, in_slices, new_folder, stored

FILTERS = "ABCDE"
REPEATED = 16
UPPER, SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes that continue a character in UTF-8.
CONTINUING = bytes(range(0x80, 0xC0))

#: What a counter is kept for.
CELL = ["part", "mask", "good", "toxic"]
#: Rows kept apart while a task sums; a larger table is summed up in between.
SUM_AT = 200_000


def mask_of(raw: bytes) -> int:
    """The filters A to D that a text fails, as bits 1, 2, 4, 8."""
    words = raw.split()
    characters = len(raw.translate(None, CONTINUING))
    few = len(words) < 100
    same = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, UPPER))) > 10 * characters
    signs = len(raw.translate(None, SIGNS)) < len(raw)
    return few + 2 * same + 4 * loud + 8 * signs


def masked(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, mask (A to D) and key (SHA-256 of the text) of every row; null texts are empty, a null part is ''."""

    def run(batches):
        for slice_ in in_slices(batches):
            raw = as_bytes(slice_.column(2))
            yield pa.RecordBatch.from_arrays(
                [slice_.column(0), slice_.column(1), pa.array(map(mask_of, raw), pa.int32()), pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())],
                names=["doc_id", "part", "mask", "key"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, key binary")


def labels_by_id(labels: DataFrame) -> DataFrame:
    """One row per id: good and toxic as 0 or 1, 1 if any of its labels says so."""
    flag = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long")).agg(flag("quality"), flag("toxic")).withColumnRenamed("quality", "good")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with good and toxic. Rows without an id meet no label and are dealt over all tasks by their text."""
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(0)
    left, right = rows.withColumn("spread", spread), labels.withColumn("spread", F.lit(0).cast("long"))
    joined = left.join(right, ["doc_id", "spread"], "left")
    return joined.select("doc_id", "part", "mask", "key", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def summed(batches, keys: list[str], fold):
    """Sums within a task: rows of equal keys become one, and memory stays bounded by ``SUM_AT`` rows and one batch."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SUM_AT:
            table = fold(pa.Table.from_batches(held), keys)
            held, rows = table.to_batches(), table.num_rows
            if rows >= SUM_AT // 2:
                yield from held
                held, rows = [], 0
    if held:
        yield from fold(pa.Table.from_batches(held), keys).to_batches()


def smallest_ids(table: pa.Table, keys: list[str]) -> pa.Table:
    """For each key: the smallest id, how many rows have it, and how many rows there are."""
    lows = table.group_by(keys, use_threads=False).aggregate([("least", "min"), ("rows", "sum")])
    holding = table.drop_columns(["rows"]).join(lows, keys, use_threads=False)
    holding = holding.filter(pc.equal(holding["least"], holding["least_min"]))
    one = holding.group_by(keys, use_threads=False).aggregate([("least", "min"), ("at_least", "sum"), ("rows_sum", "min")])
    return one.rename_columns([*keys, "least", "at_least", "rows"]).select(table.schema.names).cast(table.schema)


def arrivals(rows: DataFrame) -> DataFrame:
    """Rows of equal text, part, mask and labels of a task as one: least id, rows that have it, rows.

    Rows without an id are summed apart: no id is smaller than another there.
    """
    one = F.lit(1).cast("long")
    ones = rows.select(
        "key", *CELL, F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("least"), one.alias("at_least"), one.alias("rows"),
    )
    return ones.mapInArrow(lambda batches: summed(batches, ["key", *CELL, "no_id"], smallest_ids), ones.schema)


STATE = "texts binary"
CHANGES = "part string, mask int, good int, toxic int, change long"
HELD = pa.schema([("key", pa.binary()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()), ("toxic", pa.int32()), ("least", pa.int64()), ("at_least", pa.int64())])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def update(bucket, frames, state):
    """The changes of the counters that new rows of a bucket's texts bring.

    The state holds, for each text of the bucket, the rows that have its smallest id so far: (key, part, mask, good, toxic,
    the id, how many rows). They are retracted when a smaller id arrives.
    """
    new = pa.concat_tables([pa.Table.from_pandas(f, preserve_index=False) for f in frames])
    alone = new.filter(new["no_id"])
    new = new.filter(pc.invert(new["no_id"]))
    held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else HELD.empty_table()
    n_held = held.num_rows
    both = pa.concat_tables([held, new.select(HELD.names).cast(HELD)]).combine_chunks()
    codes = both["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    least, at_least = both["least"].to_numpy(), both["at_least"].to_numpy()
    lowest = np.full(codes.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, codes, least)
    holds = least == lowest[codes]
    rows = np.concatenate([at_least[:n_held], new["rows"].to_numpy()])
    counted = np.concatenate([at_least[:n_held], np.zeros(new.num_rows, np.int64)])
    first = np.where(holds, at_least, 0)
    # What is counted so far were first rows only: the rest of a row fails E.
    mask = both["mask"].to_numpy()
    cells = [pa.Table.from_arrays([t["part"], pa.array(m, pa.int32()), t["good"].cast(pa.int32()), t["toxic"].cast(pa.int32()), pa.array(by, pa.int64())], names=[*CELL, "change"])
             for t, m, by in ((both, mask, first - counted), (both, mask | REPEATED, rows - first), (alone, alone["mask"].to_numpy(), alone["rows"].to_numpy()))]
    if both.num_rows:
        kept = both.filter(pa.array(holds)).group_by([c for c in HELD.names if c != "at_least"], use_threads=False).aggregate([("at_least", "sum")])
        state.update((packed(kept.rename_columns([*[c for c in HELD.names if c != "at_least"], "at_least"]).select(HELD.names).cast(HELD)),))
    changes = total_changes(pa.concat_tables(cells), CELL)
    yield changes.filter(pc.not_equal(changes["change"], 0)).to_pandas()


def total_changes(table: pa.Table, keys: list[str]) -> pa.Table:
    return table.group_by(keys, use_threads=False).aggregate([("change", "sum")]).rename_columns([*keys, "change"]).select(table.schema.names).cast(table.schema)


def counter_changes(docs: DataFrame, labels: DataFrame, part: str, buckets: int) -> DataFrame:
    """A stream of changes of the counters from a stream of documents."""
    arrived = arrivals(with_labels(masked(docs, part), labels)).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    moved = arrived.groupBy("bucket").applyInPandasWithState(update, CHANGES, STATE, "append", "NoTimeout")
    return moved.mapInArrow(lambda batches: summed(batches, CELL, total_changes), CHANGES)


def counters(spark: SparkSession, path: str, labels: DataFrame, part: str = "lang", batches: int = 4, texts: int = 2000) -> DataFrame:
    """part, mask, good, toxic, n over all files of a Parquet folder (or one file), in about ``batches`` micro-batches.

    About ``texts`` texts share a state row, so its size does not grow with the input and the cost of a call of Python is shared.
    """
    path = path.rstrip("/")
    whole = spark.read.parquet(path)
    files = len(whole.inputFiles())
    # A pattern that only this path matches: a stream's source may be a single file only where it is found by a pattern.
    pattern = f"{path[:-1]}[{path[-1]}]"
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", max(1, math.ceil(files / batches))).parquet(pattern)
    folder = new_folder(spark, "filter-audit")
    writer = counter_changes(source, stored(labels_by_id(labels), "audit-labels"), part, max(1, math.ceil(whole.count() / texts))).writeStream.format("parquet").outputMode("append")
    stream = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/changes")
    stream.awaitTermination()
    changes = spark.read.schema(CHANGES).parquet(f"{folder}/changes")
    return changes.groupBy(*CELL).agg(F.sum("change").alias("n")).where("n <> 0")


def steps() -> list[dict]:
    """Every order and step, with the bit of its filter and the bits of the filters before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [
        {"filter_order": "".join(order), "step": k + 1, "own": bit[f], "before": sum(bit[x] for x in order[:k])}
        for order in permutations(FILTERS) for k, f in enumerate(order)
    ]


def order_report(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step: a row per part, order and step, zeros included.

    A part has at most 128 counters, each read by the 600 steps, however many documents it holds.
    """
    # One text literal: 2,400 single ones take ten seconds to send to Spark.
    plan = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    each = counted.select("*", F.explode(plan).alias("s")).select(*CELL, "n", "s.*")
    mask, own = F.col("mask"), F.col("own")
    fails, fresh = mask.bitwiseAND(own) != 0, mask.bitwiseAND(F.col("before")) == 0

    def total(keep, value=F.col("n")):
        return F.sum(F.when(keep, value).otherwise(0))

    # A document that fails k filters falls to each of them in 120 / k of the orders.
    share = F.col("n") * (F.lit(120) / F.bit_count("mask")).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(fresh & ~fails).alias("kept"),
        total(fails & fresh).alias("removed"),
        total(fails & ~fresh).alias("redundant"),
        total(mask == own).alias("unique_fails"),
        total(fails & fresh & (F.col("good") == 1)).alias("good_lost"),
        total(fails & fresh & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, part: str = "lang", batches: int = 4, texts: int = 2000) -> DataFrame:
    """The report over all documents of the Parquet files at ``path``; see ``order_report``.

    Null texts are empty and identical to each other; a null part is ''. Equal ids are not smaller than each other, so
    of the rows that have a text's smallest id none fails E. A row without an id is compared with none and never
    fails E. Repeated rows count each. Several labels of an id: any 1 counts. No documents: no rows. Other columns,
    of documents or labels, are not read.
    """
    return order_report(counters(spark, path, labels, part, batches, texts))
