"""Predicates on leaf rows: does a value carry observed material?

Each recursive test becomes a test of one leaf plus the keys above it, so a whole
value has the property exactly when one of its leaves does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceframe.functions import text

# Argument keys that describe a call without carrying material.
METADATA_KEYS = (
    "algorithm", "body_type", "count", "end", "has_body", "index", "little_endian", "method",
    "network_correlation_key", "position", "radix", "shape", "start", "status", "type",
)
METADATA_SUFFIXES = ("_id", "_length", "_offset", "_size")
VALUE_REF_KEYS = (
    "value_ref", "normalized_value_ref", "serialized_ref", "result_ref", "result_value_refs",
    "href_ref", "search_ref", "url_ref", "body_ref",
)


def hidden_key(key: Column) -> Column:
    return text.is_preview_key(key) | text.is_redaction_key(key)


def may_be_hidden(path: Column) -> Column:
    """False only if no key of the path is hidden; cheaper than asking every key."""
    return F.contains(path, F.lit("preview")) | F.contains(path, F.lit("redacted"))


def metadata_key(key: Column) -> Column:
    out = key.isin(*METADATA_KEYS)
    for suffix in METADATA_SUFFIXES:
        out = out | key.endswith(suffix)
    return out


def leaf_material(kind: Column, value: Column) -> Column:
    string_ok = (F.trim(value) != "") & ~text.is_redacted(value)
    return F.when(kind == "string", string_ok).otherwise(~kind.isin("null", "empty"))


def leaf_raw(kind: Column, value: Column) -> Column:
    string_ok = ~text.is_redacted(value) & ~text.is_summary_ref(value) & ~text.is_opaque_ref(value)
    return F.when(kind == "string", string_ok).otherwise(~kind.isin("null", "empty"))


def leaf_stable(kind: Column, value: Column) -> Column:
    return leaf_material(kind, value) & ~((kind == "string") & text.is_summary_ref(value))


def has_material(keys: Column, kind: Column, value: Column) -> Column:
    return leaf_material(kind, value) & ~F.exists(keys, hidden_key)


def has_raw_material(keys: Column, kind: Column, value: Column) -> Column:
    return leaf_raw(kind, value) & ~F.exists(keys, hidden_key)


def _split_at_ref(keys: Column) -> tuple[Column, Column, Column]:
    """(has a reference key, keys above the first one, keys below it)."""
    flags = F.transform(keys, text.is_ref_key)
    at = F.array_position(flags, True).cast("int")
    above = F.when(at > 0, F.slice(keys, F.lit(1), at - 1)).otherwise(keys)
    below = F.when(at > 0, F.slice(keys, at + 1, F.size(keys))).otherwise(F.array().cast("array<string>"))
    return at > 0, above, below


def has_argument_material(keys: Column, kind: Column, value: Column) -> Column:
    """Material outside metadata; below a reference key only stable references count."""
    ref, above, _ = _split_at_ref(keys)
    banned = F.exists(above, lambda k: hidden_key(k) | metadata_key(k))
    return ~banned & F.when(ref, leaf_stable(kind, value)).otherwise(leaf_material(kind, value))


def has_reference(keys: Column, kind: Column, value: Column) -> Column:
    ref, _, below = _split_at_ref(keys)
    under = leaf_material(kind, value) & ~F.exists(below, hidden_key)
    bare = (kind == "string") & text.lookup.starts_with_any(value, text.ANY_REF_PREFIXES)
    return F.when(ref, under).otherwise(bare)


def raw_siblings(ref_key: Column) -> Column:
    """Names under which the raw value of a reference key may stand beside it."""
    base = lambda n: F.substr(ref_key, F.lit(1), F.length(ref_key) - n)

    def named(stem: Column, suffixes) -> Column:
        return F.array(*[F.concat(stem, F.lit(s)) for s in suffixes])

    single = named(base(4), ("", "_value", "_text", "_string", "_hex", "_bytes"))
    return (
        F.when(ref_key == "ref", F.array(*[F.lit(x) for x in ("value", "result", "source", "body", "body_hex")]))
        .when(ref_key.endswith("_refs"), named(base(5), ("", "s", "_values", "_hex", "_hexes")))
        .when(ref_key == "result_ref", F.concat(single, F.array(F.lit("serialized"))))
        .otherwise(single)
    )
