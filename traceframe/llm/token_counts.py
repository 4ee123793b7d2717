"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the pre-tokens that the tokenizer file itself holds as single
entries, found by reading the file: byte-pair merges are learnt in order of frequency, so these are
the frequent ones, and the file bounds the table (50,257 entries here). It is broadcast. Tier two is
a bounded cache in each worker; what neither holds is encoded by the library in batches. Texts are
never exploded and no pre-token is shuffled: the whole plan is one scan and one map.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import as_bytes, in_slices, texts
from traceframe.llm.tokens import vocabulary_file, worker_lengths


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def frequent_pretokens(path: str) -> dict[bytes, int]:
    """Pre-tokens that are one vocabulary entry, with length 1."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    back, out = byte_alphabet(), {}
    for entry in entries:
        raw = bytes(back[c] for c in entry)
        body = raw[1:] if raw[:1] == b" " else raw
        # One run of ASCII letters, or one of digits, after at most one space: always a single pre-token.
        if body.isalpha() or body.isdigit():
            out[raw] = 1
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, cache: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null text counts as empty (0 tokens); rows with a null or repeated id keep a row each; other
    columns are not read. Special strings inside a text become their one id, as the library does.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_pretokens(tokenizer))

    def count(batches):
        lengths = worker_lengths(tokenizer, frequent.value, cache)
        for part in in_slices(batches):
            raw = as_bytes(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(lengths(raw), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = texts(docs, "doc_id").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def default_tokenizer() -> str:
    return vocabulary_file("byte_bpe_50k.json")
