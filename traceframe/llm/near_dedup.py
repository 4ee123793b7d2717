"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

Under each hash permutation of a document's shingles both the smallest and the largest value are kept, so P
permutations give 2P signature values: half the hash evaluations, and because the two ends of a permutation
are negatively correlated, an unbiased estimate of lower variance. The values are banded; documents that
share a band are candidates.

Exact copies are one class from the start (same shingle set). Then, over classes only:

1. in each shared bucket every member is confirmed against one pivot, the least member (linear in the bucket);
2. buckets whose members are still in several components are compared in full, in blocks: matrix
   products of shingle incidence give all intersections of two blocks, and a task emits only links that
   join components. Buckets with the same members are compared once; a large bucket becomes many tasks of bounded size.

So no link between candidates is lost, no pair within a group is emitted, and the sets are sent for
candidates only. Groups are the connected components of the confirmed links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import U64, as_bytes, hashed, in_slices, mixed, shingles, stored, texts, word_hashes
from traceframe.llm.components import components


def shingle_set(raw: bytes, width: int, cache) -> np.ndarray:
    """Sorted distinct shingle hashes; words are runs between ASCII white space, with A-Z lower-cased."""
    return np.unique(shingles(hashed(raw.lower().split(), cache), width))


class MinMax:
    """Banded min-max signatures: the values of one permutation lie in different bands where rows allow."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.count = bands, rows, -(-bands * rows // 2)
        self.factor = rng.integers(0, 1 << 63, self.count, dtype=U64) * U64(2) + U64(1)
        self.shift = rng.integers(0, 1 << 63, self.count, dtype=U64)
        self.salt = mixed(np.arange(1, bands + 1, dtype=U64))

    def ends(self, values: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(self.count, np.iinfo(U64).max, dtype=U64)
        high = np.zeros(self.count, dtype=U64)
        for start in range(0, len(values), block):
            part = values[None, start : start + block] * self.factor[:, None]
            part += self.shift[:, None]
            np.minimum(low, part.min(axis=1), out=low)
            np.maximum(high, part.max(axis=1), out=high)
        return low, high

    def __call__(self, values: np.ndarray) -> np.ndarray:
        low, high = self.ends(values)
        table = np.concatenate([low, high])[: self.bands * self.rows].reshape(self.rows, self.bands)
        out = self.salt.copy()
        for row in table:
            out = mixed(out ^ row)
        return out.view(np.int64)


def signed(docs: DataFrame, width: int, signer: MinMax) -> DataFrame:
    """doc_id, n_shingles, set_key (hash of the whole set; null when empty), bands."""
    kind = dict(docs.dtypes)["doc_id"]

    def sign(batches):
        cache = word_hashes()
        for part in in_slices(batches):
            counts, keys, bands = [], [], []
            for raw in as_bytes(part.column(1)):
                own = shingle_set(raw, width, cache)
                counts.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                bands.append(signer(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    return texts(docs, "doc_id").mapInArrow(sign, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


def sets_of(rows: DataFrame, width: int) -> DataFrame:
    """(node, set) of (node, text): the sorted hashes as bytes."""

    def make(batches):
        cache = word_hashes()
        for part in in_slices(batches):
            sets = [shingle_set(raw, width, cache).tobytes() for raw in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return rows.select("node", "text").mapInArrow(make, "node long, set binary")


def alike(shared, a, b, percent: int):
    """percent/100 or more of the union is shared, in whole numbers."""
    return 100 * shared >= percent * (a + b - shared)


def confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of pairs (a, b, set_a, set_b) that hold on the full sets."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep.append(bool(alike(int((large[at] == small).sum()), len(x), len(y), percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def joining_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows ``first`` and rows ``second`` that join different labels, at most one per join."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    # A shingle that one set alone holds adds to no intersection.
    column = np.cumsum(counts > 1) - 1
    common = counts[inverse] > 1
    row, at = row[common], column[inverse[common]]
    shared = np.zeros((len(first), len(second)), dtype=np.float32)
    places = {k: i for i, k in enumerate(first.tolist())}, {k: i for i, k in enumerate(second.tolist())}
    where = [np.array([p.get(k, -1) for k in range(len(sets))]) for p in places]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        inside = (at >= start) & (at < start + 4096)
        matrices = []
        for index, size in zip(where, (len(first), len(second))):
            own = index[row[inside]]
            m = np.zeros((size, 4096), dtype=np.float32)
            m[own[own >= 0], at[inside][own >= 0] - start] = 1
            matrices.append(m)
        shared += matrices[0] @ matrices[1].T
    a, b = sizes[first][:, None], sizes[second][None, :]
    hit = alike(shared.astype(np.int64), a, b, percent) & (labels[first][:, None] != labels[second][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(hit)):
        x, y = find(int(labels[first[i]])), find(int(labels[second[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(nodes[first[i]]), int(nodes[second[j]])))
    return out


def residual_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that join different components within a bucket; ``members`` is (band, bucket, node)."""
    tagged = members.join(labels, "node", "left").select("band", "bucket", "node", F.coalesce("component", "node").alias("label"))
    mark = F.xxhash64("node")
    open_ = tagged.groupBy("band", "bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"),
        F.sum(mark.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(mark).alias("xor"),
    ).where("low != high")
    # Buckets with the same members are one; the number of blocks keeps a task at two blocks.
    named = open_.select("band", "bucket", F.xxhash64("size", "sum", "xor").alias("group"), F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = tagged.join(named, ["band", "bucket"]).select("group", "blocks", "node", "label").distinct()
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    # A task of blocks i and j compares i with j; the task (i, i) compares the block with itself.
    filled = rows.join(sets, "node")

    def compare(key, pdf):
        found = []
        if pdf["label"].nunique() > 1:
            nodes, labels_ = pdf["node"].to_numpy(), pdf["label"].to_numpy()
            values = [np.frombuffer(s, dtype=U64) for s in pdf["set"]]
            mine = (pdf["own"] == key[1]).to_numpy()
            first = np.flatnonzero(mine)
            second = first if key[1] == key[2] else np.flatnonzero(~mine)
            if len(first) and len(second):
                found = joining_links(nodes, labels_, values, first, second, percent)
        import pandas as pd

        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return filled.groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")


def near_groups(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 30, rows: int = 4, seed: int = 3, block: int = 768
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    A null or empty text has an empty set and is linked with nothing. Rows that repeat a doc_id are one document
    with several texts: whatever any of them is linked with. A row with a null id is linked with nothing, has a
    null component_id and is kept. Other columns are not read; an empty table gives no rows. A pair at the
    threshold s shares no band with probability (1 - s^rows)^bands: below 2e-7 for the defaults.
    """
    signer = MinMax(bands, rows, seed)
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = stored(signed(ids, width, signer), "signed")
    named = marked.where("doc_id is not null and set_key is not null")
    classes = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")

    entries = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("band", "bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot != last").drop("last")
    members = stored(entries.join(shared, ["band", "bucket"]), "members")

    chosen = members.select("node").distinct()
    sets = stored(sets_of(texts(ids, "doc_id").withColumnRenamed("doc_id", "node").join(chosen, "node", "left_semi"), width), "sets")
    sets = sets.where(F.length("set") > 0)

    pairs = members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"
    )
    # A document with several texts belongs to several classes: they are one node each way.
    classed = named.join(classes.select("set_key", "node"), "set_key").select("doc_id", "n_shingles", "node")
    classed = stored(classed, "classed")
    several = classed.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    several = classed.join(several, "doc_id").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    links = stored(confirm(pairs, percent).unionByName(several), "confirmed")
    more = residual_links(members.select("band", "bucket", "node").distinct(), components(links), sets, percent, block)
    final = components(links.unionByName(more))

    found = classed.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    rest = marked.where("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is kept, one for each id and text; rows without id all stay. Same columns.

    Rows that repeat an id are one document and stay or go together; of those with equal texts one stays.
    """
    kept = groups.where("kept and doc_id is not null").select("doc_id").distinct()
    free = "_".join(["text_hash", *docs.columns])
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    named = named.select("*", F.xxhash64("text").alias(free)).dropDuplicates(["doc_id", free])
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
