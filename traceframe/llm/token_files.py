"""Token ids in a seekable binary format, and the reader that opens single frames of it.

A file is a row of independent Zstandard frames, then a table and a footer:

    frame*   one Zstandard frame of the ids (unsigned 32-bit, little-endian) of some whole documents
    table    a Zstandard skippable frame (magic 0x184D2A5E, length) that holds per document
             int64 doc_id, uint32 has_id, uint32 frame, uint32 first id in the frame, uint32 ids, and per frame
             uint64 offset, uint32 compressed bytes, uint32 ids, uint32 crc32 of the ids
    footer   the last 24 bytes of that skippable frame: uint64 offset of the table's data,
             uint32 documents, uint32 frames, uint32 crc32 of the table, uint32 magic 0x54464652

so any Zstandard tool still decompresses the whole file, and a reader seeks to the footer, then to
the frames that it needs, and checks each frame before use. A document longer than a frame has
a frame of its own. Files are written by tasks under a name that only a finished task publishes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import as_bytes, in_slices, new_folder, texts
from traceframe.llm.tokens import vocabulary_file, worker_ids

SKIPPABLE, MAGIC, FOOTER = 0x184D2A5E, 0x54464652, struct.Struct("<QIIII")
DOCUMENT = np.dtype([("doc_id", "<i8"), ("has_id", "<u4"), ("frame", "<u4"), ("first", "<u4"), ("count", "<u4")])
FRAME = np.dtype([("offset", "<u8"), ("size", "<u4"), ("count", "<u4"), ("crc", "<u4")])
MANIFEST = "part int, path string, documents long, tokens long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FrameWriter:
    """Writes documents in the order given."""

    def __init__(self, out, frame_ids: int = 1 << 18, level: int = 3):
        import zstandard

        self.out, self.frame_ids, self.at = out, frame_ids, 0
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.documents, self.frames, self.open, self.held = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.held and self.held + n > self.frame_ids:
            self.flush()
        self.documents.append((doc_id or 0, doc_id is not None, len(self.frames), self.held, n))
        self.open.append(ids)
        self.held += n

    def flush(self) -> None:
        raw = b"".join(self.open)
        packed = self.pack(raw)
        self.out.write(packed)
        self.frames.append((self.at, len(packed), self.held, zlib.crc32(raw)))
        self.at += len(packed)
        self.open, self.held = [], 0

    def close(self) -> None:
        if self.open:
            self.flush()
        body = np.array(self.documents, dtype=DOCUMENT).tobytes() + np.array(self.frames, dtype=FRAME).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(body) + FOOTER.size))
        self.out.write(body)
        self.out.write(FOOTER.pack(self.at + 8, len(self.documents), len(self.frames), zlib.crc32(body), MAGIC))


class FrameReader:
    """Reads single documents of an open seekable file; decompresses the frames that hold them only."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        end = source.size()
        tail = self._bytes(end - FOOTER.size, FOOTER.size)
        at, documents, frames, crc, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a token file")
        body = self._bytes(at, end - FOOTER.size - at)
        if zlib.crc32(body) != crc:
            raise ValueError("the seek table is damaged")
        cut = documents * DOCUMENT.itemsize
        self.documents = np.frombuffer(body[:cut], dtype=DOCUMENT)
        self.frames = np.frombuffer(body[cut:], dtype=FRAME)
        if len(self.frames) != frames:
            raise ValueError("the seek table is damaged")
        self.last, self.ids = -1, b""

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return bytes(self.source.read(size))

    def frame(self, k: int) -> bytes:
        if k != self.last:
            f = self.frames[k]
            ids = self.unpack(self._bytes(int(f["offset"]), int(f["size"])), max_output_size=max(1, 4 * int(f["count"])))
            if zlib.crc32(ids) != int(f["crc"]) or len(ids) != 4 * int(f["count"]):
                raise ValueError(f"frame {k} is damaged")
            self.last, self.ids = k, ids
        return self.ids

    def document(self, i: int) -> bytes:
        d = self.documents[i]
        return self.frame(int(d["frame"]))[4 * int(d["first"]) : 4 * (int(d["first"]) + int(d["count"]))]

    def find(self, wanted: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """Every document whose id is wanted, in file order."""
        hit = np.isin(self.documents["doc_id"], np.fromiter(wanted, dtype=np.int64)) & (self.documents["has_id"] == 1)
        for i in np.flatnonzero(hit):
            yield int(self.documents["doc_id"][i]), self.document(int(i))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, frame_ids: int = 1 << 18) -> DataFrame:
    """Encodes whole texts and writes one file per range of ids; returns the manifest in order of ids.

    Rows are dealt by range of (doc_id, hash of text), so files and the rows in them ascend by id; null
    ids come first, and rows with the same id lie in the order of that hash. A null text is empty: it
    holds the end id alone. Other columns are not read. An empty table gives no file. The manifest
    has a row per file; the driver holds those rows only.
    """
    spark = docs.sparkSession

    def write(batches):
        encode, part, writer, count, tokens = worker_ids(tokenizer), None, None, 0, 0
        target, where = open_folder(folder)
        end = struct.pack("<I", end_id)
        for piece in in_slices(batches):
            if writer is None:
                part = piece.column(2)[0].as_py()
                temporary = f"{where}/.{part:06d}-{uuid.uuid4().hex}"
                out = target.open_output_stream(temporary)
                writer = FrameWriter(out, frame_ids)
            for doc_id, ids in zip(piece.column(0).to_pylist(), encode(as_bytes(piece.column(1)))):
                writer.add(doc_id, ids + end)
                count, tokens = count + 1, tokens + len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            # A second attempt of the task makes the same bytes under the same name.
            target.move(temporary, f"{where}/{part:06d}.tok")
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": f"{part:06d}.tok", "documents": count, "tokens": tokens}],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]),
            )

    target, where = open_folder(folder)
    target.create_dir(where, recursive=True)
    tie = F.xxhash64("text")
    dealt = (
        texts(docs, "doc_id").withColumn("tie", tie)
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    )
    manifest = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(write, MANIFEST).collect()
    return spark.createDataFrame(sorted(manifest), MANIFEST)


def read_token_files(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids_path for every stored document, or for the ids asked for.

    ``start`` is the number of ids in all documents before it: the files before this one, from the
    manifest, and the documents before it in the file.
    """
    spark: SparkSession = manifest.sparkSession
    files, before = [], 0
    for row in sorted(manifest.collect()):
        files.append((row.path, before))
        before += row.tokens
    wanted = None if doc_ids is None else [int(x) for x in doc_ids]
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("frame", pa.int32())])

    def read(batches):
        source, where = open_folder(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with source.open_input_file(f"{where}/{path}") as f:
                    reader = FrameReader(f)
                    docs = reader.documents
                    starts = base + np.concatenate([[0], np.cumsum(docs["count"], dtype=np.int64)])[:-1] if len(docs) else []
                    keep = range(len(docs)) if wanted is None else np.flatnonzero(np.isin(docs["doc_id"], wanted) & (docs["has_id"] == 1))
                    rows = [
                        (int(docs["doc_id"][i]) if docs["has_id"][i] else None, int(starts[i]), int(docs["count"][i]), zlib.crc32(reader.document(int(i))), int(docs["frame"][i]))
                        for i in keep
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(out)], schema=out)

    frame = spark.createDataFrame(files, "path string, base long")
    frame = frame.repartition(max(1, len(files)), "path") if files else frame
    return frame.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, frame int")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, frame_ids: int = 1 << 18) -> DataFrame:
    """Writes the files to a new folder of the shared storage and reads them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder, frame_ids), folder)


def default_tokenizer() -> str:
    return vocabulary_file("word_bpe_49k.json")
