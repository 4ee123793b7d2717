"""Alignment of two tokenizers: which tokens cover the same text, and how common each pair of ids is.

Each text is encoded twice. Offsets in bytes at which tokens of both end cut it into groups; tokens of a group are linked.
Inside a task everything is Arrow: lists are flattened with parent indices, cumulative sums of token lengths give
token ends (documents lie one after another, so an end names its document too), a hash join on those ends finds the
common ones, another joins the tokens of each group, and ``Table.group_by`` counts. What a document links is written
once to the shared folder. Partial counts of id pairs, from whole tasks, are merged by Spark into how many documents hold
a pair; the most frequent pairs, a fixed number, are sent to all tasks and looked up where documents are, and only
rarer pairs are shuffled to their counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import ChainMap
from functools import lru_cache
from itertools import chain, filterfalse, islice
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceframe.llm.common import as_bytes, in_slices, stored, texts
from traceframe.llm.token_counts import byte_alphabet
from traceframe.llm.tokens import KEEP_BYTES, TEXT_LATIN, TEXT_PLAIN, Pretokens, vocabulary_file

#: How the piece file writes a blank.
BLANK = "▁"
BLANK_BYTES = BLANK.encode()
#: Pairs whose counts are sent to every task: 17 bytes each.
FREQUENT = 1 << 16
#: Linked pairs that a task holds at once; a document with more is taken in rounds over its ids.
PAIRS_AT_ONCE = 4_000_000
#: Parts of texts whose ids a worker keeps, for each file.
CACHED = 250_000
#: Pairs of a task that are summed up in between.
COUNT_AT = 4_000_000


class Encoder:
    """Ids of texts, from a cache of what their parts become, and what each id stands for, in bytes."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(pieces, pa.binary())
        self.lengths = pc.binary_length(self.bytes)
        self.names = pa.array([str(i) for i in range(len(pieces))])

    def __call__(self, raw: list[bytes]) -> pa.ListArray:
        """``raw``: a blank and the text, for each text."""
        ids = self.encode(raw)
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}i", *ids)


@lru_cache(maxsize=2)
def byte_level(path: str) -> Encoder:
    """A byte-level file applied to a blank and the text; its special strings are plain text."""
    parts = Pretokens(path, TEXT_PLAIN, TEXT_LATIN, False, packed, limit=CACHED)
    parts.library.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    back = byte_alphabet()
    pieces = [b""] * (max(file["model"]["vocab"].values()) + 1)
    for entry, i in file["model"]["vocab"].items():
        pieces[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    for added in file.get("added_tokens", ()):
        pieces += [b""] * (added["id"] + 1 - len(pieces))
        pieces[added["id"]] = added["content"].encode()
    return Encoder(lambda raw: parts.values(raw, b"".join), pieces)


#: Blanks and what follows them. No entry has a blank behind another character, so no merge crosses these parts.
BLANKS_AND_WORD = re.compile(rb" +[^ ]*")


@lru_cache(maxsize=2)
def piece_level(path: str) -> Encoder:
    """A SentencePiece file, which puts a blank before the text itself.

    Texts are looked up by parts where the file's entries allow it, and where they hold none of the characters that
    stand for blanks in it; other texts go to the library whole.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    pieces = [bytes([int(x[3:5], 16)]) if library.is_byte(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)]
    by_parts = not any(BLANK in x.lstrip(BLANK) for x in names)
    # The library adds no blank to an empty text, so a single blank at the end is its own case.
    known = {b" ": packed([library.piece_to_id(BLANK)])}

    def encode(raw: list[bytes]) -> list[bytes]:
        lists = [[x] if not by_parts or BLANK_BYTES in x else BLANKS_AND_WORD.findall(x) for x in raw]
        if len(known) > CACHED:
            # What was met first is what is met most; the later half goes.
            for part in list(islice(known, CACHED // 2, None)):
                del known[part]
        missing = set()
        for parts in lists:
            missing.update(filterfalse(known.__contains__, parts))
        missing, long = list(missing), {}
        for part, ids in zip(missing, library.encode([x[1:].decode() for x in missing], num_threads=1)):
            (known if len(part) <= KEEP_BYTES else long)[part] = packed(ids)
        table = ChainMap(long, known) if long else known
        return [b"".join(map(table.__getitem__, parts)) for parts in lists]

    return Encoder(encode, pieces)


def joined(ids: pa.ListArray, encoder: Encoder) -> pa.Array:
    """The bytes of each list's tokens together."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, encoder.bytes.take(ids.values)), b"")


def ends(ids: pa.ListArray, encoder: Encoder) -> pa.Table:
    """id, text and end of every token, in order; texts lie one after another, so ends rise throughout."""
    lengths = encoder.lengths.take(ids.values).cast(pa.int64())
    places = pa.array(np.arange(len(ids.values)))
    return pa.table({"id": ids.values, "text": pc.list_parent_indices(ids), "end": pc.cumulative_sum(lengths), "place": places})


def grouped(a: pa.Table, b: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Both tables with ``group``: the number of common ends before the token's own end."""
    # Tokens without bytes end where another does; the last one at an end closes its group.
    last = [t.select(["end", "place"]).filter(pa.array(np.diff(t["end"].to_numpy(), append=-1) != 0)) for t in (a, b)]
    common = last[0].join(last[1], "end", join_type="inner", right_suffix="_b", use_threads=False)
    out = []
    for table, column in ((a, "place"), (b, "place_b")):
        closes = np.zeros(table.num_rows, np.int64)
        closes[common[column].to_numpy()] = 1
        out.append(table.append_column("group", pa.array(np.cumsum(closes) - closes)))
    return out[0], out[1]


def digests(a: pa.Table, b: pa.Table, encoders: tuple[Encoder, Encoder], n_texts: int, groups_of: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups, written as ids: a1,a2|b1;a3|b2."""
    sides = []
    for table, encoder in ((a, encoders[0]), (b, encoders[1])):
        group = table["group"].to_numpy()
        starts = np.searchsorted(group, np.arange(groups_of.sum() + 1)).astype(np.int32)
        names = encoder.names.take(table["id"].combine_chunks())
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), names), ","))
    written = pc.binary_join_element_wise(*sides, "|")
    offsets = np.concatenate([[0], np.cumsum(groups_of)]).astype(np.int32)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), written), ";")
    return [hashlib.sha256(x).hexdigest() for x in as_bytes(whole)]


def linked(a: pa.Table, b: pa.Table) -> pa.Table:
    """text, pair (both ids in one number) and how many links it has there; both tables hold whole groups of ``b``.

    Groups of one token on each side are their link. Ids of other groups are counted before they meet, so a
    group costs its different pairs and not all its links.
    """
    groups = [t["group"].to_numpy() for t in (a, b)]
    n = 1 + max((int(g[-1]) for g in groups if len(g)), default=-1)
    sizes = [np.bincount(g, minlength=n) for g in groups]
    plain = (sizes[0] == 1) & (sizes[1] == 1)
    single = [t.filter(pa.array(plain[g])) for t, g in zip((a, b), groups)]
    sides = [t.filter(pa.array(~plain[g])).group_by(["text", "group", "id"], use_threads=False).aggregate([("id", "count")]) for t, g in zip((a, b), groups)]
    met = sides[0].join(sides[1].drop_columns(["text"]), "group", join_type="inner", right_suffix="_b", use_threads=False)
    pair = lambda x, y: pc.add(pc.shift_left(x.cast(pa.int64()), 32), y.cast(pa.int64()))
    table = pa.concat_tables([
        pa.table({"text": single[0]["text"], "pair": pair(single[0]["id"], single[1]["id"]), "links": pa.array(np.ones(single[0].num_rows, np.int64))}),
        pa.table({"text": met["text"], "pair": pair(met["id"], met["id_b"]), "links": pc.multiply(met["id_count"], met["id_count_b"])}),
    ])
    return table.group_by(["text", "pair"], use_threads=False).aggregate([("links", "sum")]).rename_columns(["text", "pair", "links"]).sort_by("text")


def rounds(a: pa.Table, b: pa.Table, limit: int):
    """Parts of ``a`` that meet ``b`` in about ``limit`` pairs each; a pair of a text is in one part only."""
    sizes = [np.bincount(t["group"].to_numpy()) for t in (a, b)]
    total = int(sizes[0].astype(np.int64) @ sizes[1].astype(np.int64)) if a.num_rows else 0
    parts = -(-total // limit)
    for part in range(parts):
        yield a if parts == 1 else a.filter(pa.array(a["id"].to_numpy() % parts == part))


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PIECES = "row long, doc_id {kind}, first boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def align_texts(found: list[bytes], encoders: tuple[Encoder, Encoder], limit: int = PAIRS_AT_ONCE):
    """Yields (counts of each text, digests), then for every part a table of text, pair and links."""
    raw = [b" " + x for x in found]
    wanted = pa.array(raw, pa.large_binary())
    ids = [encoder(raw) for encoder in encoders]
    same = np.array([bool(x) for x in found], bool)
    for one, encoder in zip(ids, encoders):
        same &= pc.equal(joined(one, encoder).cast(pa.large_binary()), wanted).to_numpy(zero_copy_only=False)
    ids = [one.filter(pa.array(same)) for one in ids]
    a, b = grouped(*[ends(one, encoder) for one, encoder in zip(ids, encoders)])
    n = int(same.sum())
    sizes = [pc.list_value_length(one).to_numpy() for one in ids]
    last = np.cumsum(sizes[0]) - 1
    seen = a["group"].to_numpy()[last] + 1 if n else np.zeros(0, np.int64)
    groups = np.diff(seen, prepend=0)
    width = [np.bincount(t["group"].to_numpy(), minlength=int(seen[-1]) if n else 0).astype(np.int64) for t in (a, b)]
    links = np.add.reduceat(width[0] * width[1], seen - groups) if n else np.zeros(0, np.int64)
    counts = np.zeros((4, len(found)), np.int64)
    for row, values in zip(counts, (sizes[0], sizes[1], groups, links)):
        row[same] = values
    shas = np.full(len(found), "", object)
    shas[same] = digests(a, b, encoders, n, groups) if n else []
    yield counts, shas
    places = pa.array(np.flatnonzero(same))
    for part in rounds(a, b, limit):
        table = linked(part, b)
        yield table.set_column(0, "text", places.take(table["text"].combine_chunks()))


def aligned(docs: DataFrame, byte_file: str, piece_file: str, limit: int = PAIRS_AT_ONCE) -> DataFrame:
    """What each document links, as pieces: the first piece of a row has its counts, each some of its pairs."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        encoders = byte_level(byte_file), piece_level(piece_file)
        for part in in_slices(batches, limit=1 << 20):
            found = as_bytes(part.column(2))
            steps = align_texts(found, encoders, limit)
            counts, shas = next(steps)
            first, n = True, part.num_rows
            for table in chain(steps, [None]):
                if table is None and not first:
                    break
                starts = np.searchsorted(table["text"].to_numpy(), np.arange(n + 1)).astype(np.int32) if table is not None else np.zeros(n + 1, np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(starts), table[c].combine_chunks() if table is not None else pa.array([], pa.int64())) for c in ("pair", "links")]
                batch = pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([first] * n), *(pa.array(c) for c in counts), pa.array(shas, pa.string()), *lists],
                    names=["row", "doc_id", "first", *COUNTS, "groups_sha256", "pairs", "links"],
                )
                yield batch if first else batch.filter(pc.greater(pc.list_value_length(lists[0]), 0))
                first = False

    rows = texts(docs, "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, PIECES.format(kind=kind))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """pair, documents (how many hold it) and best (no pair of its first id has more), from partial counts of tasks."""

    def fold(tables):
        table = pa.concat_tables(tables)
        return table.group_by("pair", use_threads=False).aggregate([("documents", "sum")]).rename_columns(["pair", "documents"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            flat = batch.column(0).flatten()
            held.append(fold([pa.table({"pair": flat, "documents": pa.array(np.ones(len(flat), np.int64))})]))
            rows += held[-1].num_rows
            if rows > COUNT_AT:
                held = [fold(held)]
                rows = held[0].num_rows
                if rows > COUNT_AT // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from fold(held).to_batches()

    partial = pieces.select("pairs").mapInArrow(run, "pair long, documents long")
    merged = partial.groupBy("pair").agg(F.sum("documents").alias("documents"))
    most = F.max("documents").over(Window.partitionBy(F.shiftright("pair", 32)))
    return merged.withColumn("best", F.col("documents") == most)


def looked_up(pieces: DataFrame, frequent: DataFrame) -> DataFrame:
    """row, and the sums over the pairs that the frequent table has; the others stay as lists."""
    rows = frequent.collect()
    order = np.argsort(np.array([r.pair for r in rows], np.int64))
    table = pieces.sparkSession.sparkContext.broadcast(
        tuple(np.array([r[c] for r in rows], np.int64)[order] for c in ("pair", "documents", "best"))
    )

    def run(batches):
        pairs, documents, best = table.value
        for batch in batches:
            lists, links = batch.column(1), batch.column(2).flatten().to_numpy()
            flat, parent = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            sums = []
            for values in (best, documents):
                # Whole numbers up to 2^53 are exact in the sums of bincount; a document's own are far below.
                weights = links[known] * values[at[known]]
                sums.append(np.bincount(parent[known], weights, batch.num_rows).astype(np.int64))
            starts = np.concatenate([[0], np.cumsum(np.bincount(parent[~known], minlength=batch.num_rows))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x[~known])) for x in (flat, links)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), *rest], names=["row", "n_best", "count_sum", "pairs", "links"])

    return pieces.select("row", "pairs", "links").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, links array<long>")


def token_links(docs: DataFrame, byte_file: str, piece_file: str, frequent: int = FREQUENT, limit: int = PAIRS_AT_ONCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens do not give the bytes of a blank and the text, have no tokens: zeros
    and ''. Repeated rows count as documents each; null and repeated ids keep a row each. An empty table gives an empty one.
    Other columns are not read. Texts are encoded once, in slices of about a megabyte, or one text.
    """
    pieces = stored(aligned(docs, byte_file, piece_file, limit), "aligned")
    counted = stored(pair_counts(pieces), "pair-counts")
    found = stored(looked_up(pieces, counted.orderBy(F.desc("documents"), "pair").limit(frequent)), "looked-up")
    rare = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", "p.pairs", "p.links")
    rare = rare.join(counted, F.col("pairs") == F.col("pair")).select(
        "row", (F.col("links") * F.col("best").cast("long")).alias("n_best"), (F.col("links") * F.col("documents")).alias("count_sum"),
    )
    sums = found.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return pieces.where("first").join(sums, "row").select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def default_tokenizers() -> tuple[str, str]:
    return vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model")
