"""Which texts contain which needles, without comparing every pair.

Texts and needles are bytes, cut into windows; window lengths are powers of two, and a needle belongs to the longest
that fits it. A window's fingerprint covers its bytes and the equality columns. Windows are made and counted inside the
tasks, as Arrow batches: fingerprints of all windows of the texts are counted in a fixed number of slots, and a needle is
filed under the one of its windows whose slot is rarest. A bit map of the filed fingerprints, sized by their number within
fixed bounds, lets only windows that may be filed leave their text: as a fingerprint and a position, never with the text.
Those that meet a needle are compared with the text at that very place, and a text travels once. Fingerprints that stay
common are salted by their count, so a letter that all texts hold is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceframe.session import stored

# Window lengths in bytes; a needle uses the longest one that fits it.
SIZES = (1, 2, 4, 8, 16, 32)
# Windows whose fingerprints are made at a time, wherever texts begin and end.
BLOCK = 1 << 20
# Slots in which windows are counted, a power of two.
SLOTS = 1 << 18
# Words of 64 bits in the map of filed fingerprints: at least, at most, and bits for each of them.
LEAST_WORDS, MOST_WORDS, BITS_EACH = 1 << 10, 1 << 21, 32
# Windows of a slot for which a needle is filed once more.
SALT_AT = 100_000

U64 = np.uint64
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1 << 63, size=256, dtype=np.uint64) * U64(2) + U64(1)


def _prints(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, sizes: int = sum(SIZES)) -> Iterator[tuple]:
    """(size, row, place in the row, fingerprint) of all windows of these sizes of the rows' bytes, as arrays, block after block.

    ``data`` holds the rows one after another; ``sizes`` is a sum of window lengths. A window twice as long is made of its two halves.
    """
    for start in range(int(offsets[0]), int(offsets[-1]), BLOCK):
        end = min(start + BLOCK, int(offsets[-1]))
        first, last = np.searchsorted(offsets, [start, end - 1], "right") - 1
        borders = offsets[first : last + 2]
        inside = np.minimum(borders[1:], end) - np.maximum(borders[:-1], start)
        row = np.repeat(np.arange(first, last + 1), inside)
        at = np.arange(start, end)
        left = offsets[row + 1] - at
        place, key = at - offsets[row], keys[row]
        print_ = _BYTES[data[start : min(end + SIZES[-1] - 1, int(offsets[-1]))]]
        for size in SIZES:
            if size > 1:
                half = size // 2
                print_ = print_[:-half] * U64(0x9E3779B97F4A7C15) + (print_[half:] ^ (print_[half:] >> U64(29)))
                print_ ^= print_ >> U64(32)
            if not len(print_) or size > sizes:
                break
            if not sizes & size:
                continue
            whole = np.flatnonzero(left[: len(print_)] >= size)
            found = (print_[whole] ^ key[whole]) * U64(0xD6E8FEB86659FD93)
            found ^= found >> U64(32)
            found *= U64(0xBF58476D1CE4E5B9)
            found ^= found >> U64(29)
            yield size, row[whole], place[whole], found


def _windows(batch: pa.RecordBatch, sizes: int) -> Iterator[tuple]:
    """Windows of a batch whose last two columns are the hash of the equality columns and the bytes."""
    cells = batch.column(batch.num_columns - 1)
    wide = cells.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(cells) or offsets[-1] == offsets[0]:
        return iter(())
    keys = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).view(np.uint64)
    return _prints(np.frombuffer(wide.buffers()[2], np.uint8), offsets, keys, sizes)


def _slots(prints: np.ndarray) -> np.ndarray:
    return (prints & U64(SLOTS - 1)).astype(np.int64)


def _beside(batch: pa.RecordBatch, kept: int, rows: np.ndarray, *columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The first ``kept`` columns of the given rows, with further columns."""
    taken = pa.RecordBatch.from_arrays(batch.columns[:kept], names=names[:kept]).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(c) for c in columns]], names=names)


def _asked_sizes(asked: DataFrame) -> int:
    """The sum of the window lengths that needles use: those of other lengths are not made."""
    own = F.lit(SIZES[0])
    for size in SIZES[1:]:
        own = F.when(F.octet_length("_data") >= size, size).otherwise(own)
    return asked.agg(F.bit_or(own)).first()[0] or 0


def _slot_counts(whole: DataFrame, sizes: int) -> np.ndarray:
    """Windows of these sizes of the texts by slot: one row per slot from every task, and as many numbers as there are slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, _, prints in _windows(batch, sizes):
                total += np.bincount(_slots(prints), minlength=SLOTS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["slot", "n"])

    rows = whole.select("_key", "_data").mapInArrow(count, "slot BIGINT, n BIGINT").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _filed(asked: DataFrame, counts, sizes: int) -> DataFrame:
    """Each needle with its rarest window: _size, _print, _offset and the count of its slot."""
    kept = len(asked.columns) - 2
    names = [*asked.columns[:kept], "_needle", "_size", "_print", "_offset", "_count"]
    tail = [("_needle", T.BinaryType()), ("_size", T.IntegerType()), ("_print", T.LongType()), ("_offset", T.LongType()), ("_count", T.LongType())]
    schema = T.StructType([*asked.schema.fields[:kept], *[T.StructField(n, t) for n, t in tail]])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pa.compute.binary_length(batch.column(kept + 1)).to_numpy(zero_copy_only=False)
            own = np.array(SIZES)[np.searchsorted(SIZES, lengths, "right") - 1]
            count = np.full(batch.num_rows, np.iinfo(np.int64).max)
            prints, offset = np.zeros(batch.num_rows, U64), np.zeros(batch.num_rows, np.int64)
            for size, row, place, found in _windows(batch, sizes):
                mine = np.flatnonzero(own[row] == size)
                if not len(mine):
                    continue
                row, place, found = row[mine], place[mine], found[mine]
                often = counts.value[_slots(found)]
                order = np.lexsort((place, often, row))
                order = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                order = order[often[order] < count[row[order]]]
                best = row[order]
                count[best], prints[best], offset[best] = often[order], found[order], place[order]
            yield _beside(
                pa.RecordBatch.from_arrays([*batch.columns[:kept], batch.column(kept + 1)], names=names[: kept + 1]), kept + 1,
                np.arange(batch.num_rows), own.astype(np.int32), prints.view(np.int64), offset, count, names=names,
            )

    return asked.mapInArrow(file, schema)


def _word(words: int) -> Column:
    return F.shiftrightunsigned("_print", 18).bitwiseAND(F.lit(words - 1))


def _bits(prints: np.ndarray) -> np.ndarray:
    """The two bits that stand for a fingerprint in its word."""
    return (U64(1) << (prints >> U64(58))) | (U64(1) << ((prints >> U64(52)) & U64(63)))


def _marks(filed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps of filed fingerprints, of whole needles, of which one place in a text is enough, and of parts of needles."""
    words = LEAST_WORDS
    wanted = filed.count() * BITS_EACH // 64
    while words < min(wanted, MOST_WORDS):
        words *= 2
    exact = F.octet_length("_needle") == F.col("_size")
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(_print, 58) AS INT)) | shiftleft(1L, cast(shiftrightunsigned(_print, 52) & 63 AS INT))")
    rows = filed.groupBy(_word(words).alias("word")).agg(
        F.bit_or(F.when(exact, bit).otherwise(F.lit(0).cast("bigint"))).alias("wholes"),
        F.bit_or(F.when(~exact, bit).otherwise(F.lit(0).cast("bigint"))).alias("parts"),
    ).toArrow()
    maps = []
    for name in ("wholes", "parts"):
        marks = np.zeros(words, np.uint64)
        marks[rows.column("word").to_numpy()] = rows.column(name).to_numpy().view(np.uint64)
        maps.append(marks)
    return tuple(maps)


def _met(whole: DataFrame, counts, marks, sizes: int) -> DataFrame:
    """Windows of the texts that may be filed: _size, _print, the count of their slot and _place, -1 for whole needles."""
    kept = len(whole.columns) - 2
    names = [*whole.columns[:kept], "_size", "_print", "_count", "_place"]
    tail = [("_size", T.IntegerType()), ("_print", T.LongType()), ("_count", T.LongType()), ("_place", T.LongType())]
    schema = T.StructType([*whole.schema.fields[:kept], *[T.StructField(n, t) for n, t in tail]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wholes, parts = marks.value
        mask = U64(len(wholes) - 1)
        for batch in batches:
            for size, row, place, prints in _windows(batch, sizes):
                word, bits = ((prints >> U64(18)) & mask).astype(np.int64), _bits(prints)
                some = np.flatnonzero(wholes[word] & bits == bits)
                if len(some):
                    # A text says once that it holds such a window.
                    order = some[np.lexsort((prints[some], row[some]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (np.diff(row[order]) != 0) | (prints[order][1:] != prints[order][:-1])
                    some = order[new]
                many = np.flatnonzero(parts[word] & bits == bits)
                hits = np.concatenate([some, many])
                if len(hits):
                    where = np.concatenate([np.full(len(some), -1, np.int64), place[many]])
                    yield _beside(
                        batch, kept, row[hits], np.full(len(hits), size, np.int32), prints[hits].view(np.int64),
                        counts.value[_slots(prints[hits])], where, names=names,
                    )

    return whole.mapInArrow(search, schema)


def containment_pairs(
    texts: DataFrame, needles: DataFrame, keys: list[str], text: str = "text", needle: str = "needle",
    text_id: str = "text_id", needle_id: str = "needle_id",
) -> DataFrame:
    """Distinct (keys, text_id, needle_id) with the needle inside the text, exact.

    ``keys`` are further equality columns; empty needles match nothing. The filed needles are stored when this is
    called; texts are then read again when the result is.
    """
    context = texts.sparkSession.sparkContext
    same_keys = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")

    def bytes_of(df: DataFrame, value: str, name: str) -> DataFrame:
        return df.where(F.length(value) > 0).select(*keys, name, same_keys.alias("_key"), F.encode(F.col(value), "UTF-8").alias("_data"))

    whole, asked = bytes_of(texts, text, text_id), bytes_of(needles, needle, needle_id)
    sizes = _asked_sizes(asked)
    counts = context.broadcast(_slot_counts(whole, sizes))
    # Stored, so that what follows is planned without the counting behind it.
    filed = stored(_filed(asked, counts, sizes), "needles")
    met = _met(whole, counts, context.broadcast(_marks(filed)), sizes)
    salts = F.floor(F.col("_count") / SALT_AT)
    met = met.withColumn("_salt", F.pmod(F.xxhash64(text_id), salts + 1)).drop("_count")
    exact = F.octet_length("_needle") == F.col("_size")
    filed = filed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts))).drop("_count")
    # Sizes of windows and texts are not known to the planner, so nothing here is gathered for a broadcast.
    found = met.join(filed.hint("merge"), [*keys, "_size", "_print", "_salt"]).where(exact == (F.col("_place") == -1))
    near = found.select(*keys, text_id, needle_id, "_needle", F.when(~exact, F.col("_place") - F.col("_offset") + 1).alias("_start"))
    # Equal fingerprints are not yet equal bytes: the text has the last word.
    same = F.when(F.col("_start").isNull(), F.contains("_data", F.col("_needle"))).otherwise(
        (F.col("_start") > 0) & (F.substr(F.col("_data"), F.col("_start").cast("int"), F.octet_length("_needle")) == F.col("_needle"))
    )
    return near.join(whole.drop("_key").hint("merge"), [*keys, text_id]).where(same).select(*keys, text_id, needle_id).distinct()
