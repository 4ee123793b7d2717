"""Token counts, token files and packing against the library itself."""

import struct
import zlib

import pytest
from pyspark.sql import Row

from traceframe.llm import packing, token_counts, token_files
from traceframe.llm.tokens import load

TEXTS = [
    None, "", " ", "\n\n", "a", "Hello,  World's  don't\n\n x", "trail \n", "tab\tand nbsp   wide", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>",
    "Éèau ßtraße İstanbul ΟΔΟΣ ﬁne été café", "日本語のテキスト です", "reed*** THTHES!! 12345 6 x1y2 'tis 'S we'LL", "x" * 3000 + " " + "ab " * 1000,
    "\x1c\x1d odd \x85 controls ​ zero", "😀😀 emoji 👍🏽!", "a" * 65 + " " + "b" * 200 + "  c",
]


def frame(spark, texts=TEXTS, extra=True):
    rows = [Row(doc_id=i, text=t, start="clash", n_tokens=None, part="p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens string, part string").repartition(3)


def test_counts_equal_the_library(spark):
    path = token_counts.default_tokenizer()
    library = load(path)
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark), path, limit=20, cache=7).collect()}
    for i, text in enumerate(TEXTS):
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((text or "").encode()), want > 20), text


def expected_ids(end):
    library = load(token_files.default_tokenizer())
    return [[*library.encode(t or "", add_special_tokens=False).ids, end] for t in TEXTS]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_files_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/tok"
    manifest = token_files.write_token_files(frame(spark), token_files.default_tokenizer(), 2, folder, frame_ids=16)
    got = {r.doc_id: r for r in token_files.read_token_files(manifest, folder).collect()}
    start = 0
    for i, ids in enumerate(expected_ids(2)):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    some = token_files.read_token_files(manifest, folder, [5, 11, 99]).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in some) == sorted((i, got[i].ids_crc32) for i in (5, 11))


def test_reader_opens_only_the_frames_it_needs_and_checks_them(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "x.tok")
    with open(path, "wb") as out:
        writer = token_files.FrameWriter(out, frame_ids=4)
        for i in range(10):
            writer.add(i, packed([i] * 3))
        writer.close()
    with fs.LocalFileSystem().open_input_file(path) as f:
        reader = token_files.FrameReader(f)
        assert len(reader.frames) == 10
        assert dict(reader.find([7])) == {7: packed([7] * 3)}
    import zstandard

    raw = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(packed([i] * 3) for i in range(10))
    spoiled = bytearray(raw)
    spoiled[int(reader.frames[3]["offset"]) + 6] ^= 255
    open(path, "wb").write(bytes(spoiled))
    with fs.LocalFileSystem().open_input_file(path) as f:
        reader = token_files.FrameReader(f)
        assert reader.document(2) == packed([2] * 3)
        with pytest.raises(Exception):
            reader.document(3)


@pytest.mark.parametrize("rows", [[], [(None, "null id"), (3, "twice"), (3, "twice"), (3, "other")]])
def test_files_of_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.token_files(docs, token_files.default_tokenizer(), 2).collect()
    assert sorted(r.doc_id is None for r in got) == sorted(i is None for i, _ in rows)
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_pieces_rebuild_every_document(spark):
    room = 64
    got = packing.pack(frame(spark), token_files.default_tokenizer(), 1, room=room, group=4).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, ids in enumerate(expected_ids(1)):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            piece = ids[r.start : r.start + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(packed(piece)) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room


def test_first_fit_equals_a_plain_scan():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 200):
        lengths = np.sort(rng.integers(1, 65, n))[::-1]
        bins, offsets = packing.first_fit(lengths, 64)
        free = []
        for length, b, o in zip(lengths, bins, offsets):
            at = next((i for i, room in enumerate(free) if room >= length), len(free))
            if at == len(free):
                free.append(64)
            assert (b, o) == (at, 64 - free[at])
            free[at] -= length


def test_packing_of_odd_tables(spark):
    path = token_files.default_tokenizer()
    assert packing.pack(frame(spark, []), path, 1).collect() == []
    docs = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = packing.pack(docs, path, 1).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 3), (1, 3)]
