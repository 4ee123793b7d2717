"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents long, so their Jaccard similarity is near zero however much of an
item a document holds. The search therefore works on containment. Items are partitioned by size
(powers of two of the shingle count). An item with n distinct shingles is contained to a share of at least t in
a document only if the document lacks at most n - ceil(t n) of them; so of the item's smallest n - ceil(t n) + 1 values under
one hash permutation (its bottom-k MinHash sketch, k set by its size) the document must hold at least one. Each
shingle of a document is looked up among the sorted sketch values of a partition, so k needs no slack, no item is
missed, and a document costs its own length times the log of the benchmark's. A document with fewer
shingles than a partition's least need is not probed against it. Candidates are then verified by counting
the item's shingles in the document's full set.

Tasks make the items' sets, which are stored; they are sent to the tasks of the documents in blocks of bounded size.
Each block passes over the documents once, as one map without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import U64, hashed, in_slices, shingles, stored, word_hashes

WORDS = re.compile(rb"[0-9a-z_\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits, underscores and any characters beyond ASCII."""
    return WORDS.findall((text or "").lower().encode())


class Block:
    """Items of one broadcast: sketches to probe, sets to verify, by shingle width."""

    def __init__(self, items: list[tuple[int | None, np.ndarray, int]], threshold: float):
        self.widths = sorted({width for _, _, width in items})
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, s, _ in items]
        self.need = np.array([math.ceil(threshold * len(s) - 1e-9) for s in self.sets], dtype=np.int64)
        self.parts = []
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (_, s, width) in enumerate(items):
            groups.setdefault((width, len(s).bit_length()), []).append(k)
        for (width, _), members in sorted(groups.items()):
            # Sets are sorted by hash, so the sketch is a prefix.
            sketches = [self.sets[k][: len(self.sets[k]) - int(self.need[k]) + 1] for k in members]
            values, owners = np.concatenate(sketches), np.repeat(members, [len(s) for s in sketches])
            order = np.argsort(values, kind="stable")
            # Owners of the k-th value: owners[starts[k] : starts[k + 1]].
            distinct, starts = np.unique(values[order], return_index=True)
            self.parts.append((width, int(self.need[members].min()), distinct, np.append(starts, len(values)), owners[order]))

    def search(self, hashes: np.ndarray) -> list[tuple[int | None, int, int]]:
        """(item, shingles of the item, of which in the document) for every item contained enough."""
        found: list[tuple[int, int, int]] = []
        sets = {w: np.unique(shingles(hashes, w)) for w in self.widths if len(hashes) >= w}
        for width, least, values, starts, owners in self.parts:
            own = sets.get(width)
            if own is None or len(own) < least:
                continue
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            hits = at[values[at] == own].tolist()
            for k in {k for i in hits for k in owners[starts[i] : starts[i + 1]].tolist()}:
                item = self.sets[k]
                if len(own) < self.need[k]:
                    continue
                at = np.searchsorted(own, item)
                shared = int((own[np.minimum(at, len(own) - 1)] == item).sum())
                if shared >= self.need[k]:
                    found.append((self.ids[k], len(item), shared))
        return found


def item_sets(items: DataFrame, item_id: str, width: int) -> DataFrame:
    """item (may be null), width, set (distinct shingle hashes, sorted, 8 bytes each) for every item with words, stored.

    An item of fewer words than the width is one shingle of its own length.
    """

    def build(batches):
        cache = word_hashes()
        for batch in in_slices(batches):
            found = [hashed(words_of(text), cache) for text in batch.column(1).to_pylist()]
            rows = [i for i, hashes in enumerate(found) if len(hashes)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int32())), pa.array([min(width, len(found[i])) for i in rows], pa.int32()),
                    pa.array([np.unique(shingles(found[i], width)).tobytes() for i in rows], pa.binary()),
                ],
                names=["item", "width", "set"],
            )

    named = items.select(F.col(item_id).cast("long").alias("item"), "text")
    return stored(named.mapInArrow(build, "item long, width int, set binary"), "items")


def item_blocks(sets: DataFrame, limit: int) -> Iterator[list[tuple[int | None, np.ndarray, int]]]:
    """Items in blocks of at most ``limit`` shingles (or one item); the driver holds a block and one partition."""
    block, held = [], 0
    for row in sets.toLocalIterator():
        own = np.frombuffer(row["set"], dtype=U64)
        if block and held + len(own) > limit:
            yield block
            block, held = [], 0
        block.append((row["item"], own, row["width"]))
        held += len(own)
    if block:
        yield block


def search_blocks(sets: DataFrame, threshold: float, block: int) -> Iterator:
    """A broadcast for each block of items."""
    for part in item_blocks(sets, block):
        yield sets.sparkSession.sparkContext.broadcast(Block(part, threshold))


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, item_id: str = "item_id", block: int = 4_000_000
) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment for every pair at or above the threshold.

    A document with null or empty text holds nothing; a null doc_id is kept as null; repeated rows give their
    pairs each. Items with null id or no words match nothing; items that repeat an id match apart. A text of
    fewer words than an item's shingle cannot hold it. Other columns are not read. With no items the result
    is empty. ``block`` bounds a broadcast, in shingles (8 bytes each).
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, item_shingles long, shared long"
    out = None
    sets = item_sets(items.where(F.col(item_id).cast("long").isNotNull()), item_id, width)
    for shared_block in search_blocks(sets, threshold, block):

        def search(batches, shared_block=shared_block):
            cache = word_hashes()
            for batch in in_slices(batches):
                rows, at = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    hits = shared_block.value.search(hashed(words_of(text), cache))
                    rows += hits
                    at += [i] * len(hits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int32())), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]],
                    names=["doc_id", "item_id", "item_shingles", "shared"],
                )

        pairs = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, item_id: str = "item_id", block: int = 4_000_000) -> DataFrame:
    """The rows that hold no item to the threshold, with the same columns; decided row by row, without a join.

    Null and empty texts hold nothing and stay. Items count whatever their id, null too. Blocks of items filter one after another.
    """
    at = docs.columns.index("text")
    for shared_block in search_blocks(item_sets(items, item_id, width), threshold, block):

        def clean(batches, shared_block=shared_block):
            cache = word_hashes()
            for batch in in_slices(batches):
                keep = [not shared_block.value.search(hashed(words_of(t), cache)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
