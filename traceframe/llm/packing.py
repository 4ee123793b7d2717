"""Packing of token documents into fixed-length sequences.

Each document is cut at multiples of the sequence length. Full pieces are sequences of their own;
the rest of each document is packed by first-fit decreasing, with a tournament tree over the free
room of the open bins, run independently in randomised groups of a bounded size. Only (id, length,
checksum) rows travel; the tokens are read once, where the texts are.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import as_bytes, in_slices, stored, texts
from traceframe.llm.tokens import worker_ids

PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("row", pa.int64())])


def first_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the order given, each into the first bin that holds it.

    The tree's leaves are the free room of the bins; an inner node is the larger of its children,
    so the first fitting bin is found by going down to the left wherever the left maximum suffices.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for item, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[item], offsets[item] = node - leaves, room - tree[node]
        tree[node] -= length
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left > right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int) -> DataFrame:
    """One row per piece of each document: start, length, checksum of its ids, the document's tokens."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        encode, end, row = worker_ids(tokenizer), struct.pack("<I", end_id), 0
        for part in in_slices(batches):
            at, columns = [], [[] for _ in PIECES]
            for i, ids in enumerate(encode(as_bytes(part.column(1)))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, room):
                    piece = ids[4 * start : 4 * (start + room)]
                    at.append(i)
                    for column, value in zip(columns, (start, len(piece) // 4, zlib.crc32(piece), total, row)):
                        column.append(value)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, f.type) for c, f in zip(columns, PIECES)]],
                names=["doc_id", *PIECES.names],
            )

    return texts(docs, "doc_id").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, row long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, room: int = 2048, group: int = 8192, seed: int = 11) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    Full pieces keep the sequence to themselves. A rest goes to one of ceil(rows / group) groups by
    a hash of its id, checksum and place in its task, so copies and repeated rows spread too, and is
    packed there. ``sequence_id`` is group * 2^32 + number in the group, or for full pieces 2^62 plus
    a running number; it is unique, not dense. A null text is empty: it holds the end id
    alone. An empty table gives no row; other columns are not read. No document is cut but at
    multiples of ``room``.
    """
    kind = dict(docs.dtypes)["doc_id"]
    groups = max(1, -(-docs.count() // group))
    salt = F.xxhash64(F.lit(seed), "doc_id", "ids_crc32", "row", F.spark_partition_id())
    # Stored, since full pieces and rests are read apart: texts are encoded once.
    pieces = stored(document_pieces(docs, tokenizer, end_id, room).withColumn("_group", F.pmod(salt, F.lit(groups))), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "ids_crc32", "row"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit(pdf["length"].to_numpy(), room)
        return pdf[names].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    full = pieces.where(F.col("length") == room).select(
        *names, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rest = pieces.where(F.col("length") < room).groupBy("_group").applyInPandas(place, schema)
    return rest.unionByName(full)
