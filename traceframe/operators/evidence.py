"""What is known about an anchor request: strings seen before it, phases, pairing.

All operators work on many anchors at once; ``anchor_id`` is part of every key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions import lookup, text
from traceframe.operators.containment import containment_pairs
from traceframe.session import stored

# Shortest string of a timeline, and characters of a preview.
TIMELINE_MIN_LEN = 12
PREVIEW = 80


def deduped_strings(strings: DataFrame, min_len: int = TIMELINE_MIN_LEN) -> DataFrame:
    """One row per (anchor, value fingerprint, api): count, first offset, first row.

    ``strings`` has anchor_id, file_index, d_ms, api, category, key, value, function,
    script. Keys that name the origin of a call are left out.
    """
    kept = strings.where(~F.col("key").isin(*lookup.PROVENANCE_KEYS) & (F.length("value") >= min_len))
    first = F.struct("file_index", "key", "category", "function", "script", "value")
    return kept.withColumn("value_sha", text.sha8(F.col("value"))).groupBy("anchor_id", "value_sha", "api").agg(
        F.count(F.lit(1)).alias("count"), F.min("d_ms").alias("d_ms"), F.min(first).alias("f")
    ).select(
        "anchor_id", "value_sha", "api", "count", "d_ms", F.col("f.file_index").alias("file_index"),
        F.col("f.key").alias("key"), F.col("f.category").alias("category"), F.col("f.function").alias("function"),
        F.substring_index(F.col("f.script"), "/", -1).alias("script"), F.col("f.value").alias("value"),
    )


def field_matches(values: DataFrame, fields: DataFrame) -> DataFrame:
    """Best-kind matches of each (anchor, value) with the fields of its anchor.

    equal beats value_substring (value inside field) beats field_substring (field
    inside value). Rows: anchor_id, value_sha, kind, label, field_len.
    """
    digest = lambda c: F.unhex(F.sha2(F.encode(F.col(c), "UTF-8"), 256))
    distinct = values.select("anchor_id", "value_sha", "value").dropDuplicates(["anchor_id", "value_sha"])
    usable = fields.where(F.length("field_value") > 0).withColumn("_field", digest("field_value"))
    # Each distinct field text has a number. Pairs travel as numbers; labels and lengths meet them last, the texts never.
    parts = usable.select("anchor_id", "_field", "field_value").dropDuplicates(["anchor_id", "_field"])
    parts = stored(parts.withColumn("_number", F.monotonically_increasing_id()), "fields")
    known = parts.select("anchor_id", "_field", "_number").hint("merge")
    labels = usable.select("anchor_id", "_field", "label", F.length("field_value").alias("field_len"))
    labels = labels.join(known, ["anchor_id", "_field"]).drop("_field")
    whole = distinct.withColumn("_field", digest("value"))
    equal = whole.select("anchor_id", "value_sha", "_field").join(known, ["anchor_id", "_field"]).drop("_field")
    # Only what has no better match is searched further.
    rest = stored(whole.join(known, ["anchor_id", "_field"], "left_anti").drop("_field"), "values")
    inside = containment_pairs(parts, rest, ["anchor_id"], "field_value", "value", "_number", "value_sha")
    inside = stored(inside, "inside")
    last = rest.join(inside.select("anchor_id", "value_sha").distinct(), ["anchor_id", "value_sha"], "left_anti")
    around = containment_pairs(last, parts, ["anchor_id"], "value", "field_value", "value_sha", "_number")
    kinds = [("equal", equal), ("value_substring", inside), ("field_substring", around)]
    pairs = reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in kinds])
    return pairs.join(labels.hint("merge"), ["anchor_id", "_number"]).select("anchor_id", "value_sha", "kind", "label", "field_len")


def timeline(
    strings: DataFrame, fields: DataFrame, params: DataFrame | None = None, min_len: int = TIMELINE_MIN_LEN
):
    """(rows, matches): distinct strings of each anchor with their role and match.

    ``fields``: anchor_id, label, field_value. ``params``: anchor_id, param,
    param_index, param_value. Distinct strings and matches are stored when this is called, as both results and
    what reads them use them several times.
    """
    rows = stored(deduped_strings(strings, min_len), "strings")
    matches = stored(field_matches(rows, fields), "matches")
    order = F.struct("field_len", "label")
    per_value = matches.groupBy("anchor_id", "value_sha").agg(
        F.first("kind").alias("token_match_kind"), F.min_by("label", order).alias("appears_in_token_field"),
        F.count(F.lit(1)).alias("match_count"),
    )
    out = rows.join(per_value, ["anchor_id", "value_sha"], "left")
    if params is not None:
        first = params.where("param_value <> ''").groupBy("anchor_id", F.col("param_value").alias("value")).agg(
            F.min_by("param", "param_index").alias("equals_query_param")
        )
        out = out.join(first, ["anchor_id", "value"], "left")
    else:
        out = out.withColumn("equals_query_param", F.lit(None).cast("string"))
    is_input = lookup.starts_with_any(F.col("api"), lookup.INPUT_ROLE_APIS) | F.col("key").isin(
        "subject", "input", "data", "text"
    )
    role = F.when(F.col("token_match_kind").isNotNull(), "output").when(is_input, "input").otherwise("intermediate")
    out = out.withColumn("role", role).withColumn("value_len", F.length("value").cast("bigint")).withColumn(
        "value_preview", F.substring("value", 1, PREVIEW)
    ).withColumn("match_count", F.coalesce("match_count", F.lit(0)).cast("bigint"))
    return out, matches


def is_input_row(api: Column, preview: Column) -> Column:
    """Plain text handed to a digest or cipher; value references do not count."""
    named = lookup.starts_with_any(api, lookup.INPUT_APIS) & ~api.endswith(".ret")
    refs = ("string_ref:", "object:", "number:", "bytes_", "handler_arg:", "json:")
    echo = F.contains(preview, F.lit('"category":"inject"'))
    return named & (preview != "") & ~lookup.starts_with_any(preview, refs) & ~echo


def pairing(rows: DataFrame, matches: DataFrame, leaf_fields: DataFrame) -> DataFrame:
    """Evidence of each leaf field: direct, composite, context_only or unpaired."""
    seen = matches.join(
        rows.select("anchor_id", "value_sha", "api", "category", "d_ms"), ["anchor_id", "value_sha"]
    )
    per_field = seen.groupBy("anchor_id", "label").agg(
        F.bool_or(F.col("kind") == "equal").alias("_equal"),
        F.bool_or(F.col("kind") == "value_substring").alias("_part"),
        F.count(F.lit(1)).alias("material_events"), F.min("d_ms").alias("first_d_ms"),
        F.array_sort(F.collect_set("kind")).alias("match_kinds"),
        F.slice(F.array_sort(F.collect_set("api")), 1, 8).alias("apis"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )
    out = leaf_fields.join(per_field, ["anchor_id", "label"], "left")
    evidence = (
        F.when(F.col("_equal"), "direct").when(F.col("_part"), "composite")
        .when(F.col("material_events") > 0, "context_only").otherwise("unpaired")
    )
    return out.withColumn("evidence", evidence).withColumn("length", F.length("field_value").cast("bigint")).withColumn(
        "material_events", F.coalesce("material_events", F.lit(0)).cast("bigint")
    ).drop("_equal", "_part")


def pairing_summary(paired: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("evidence") == kind)
    out = paired.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("fields_total"), n("direct").alias("direct_fields"),
        n("composite").alias("composite_fields"), n("context_only").alias("context_only_fields"),
    )
    both = F.col("direct_fields") + F.col("composite_fields")
    return out.withColumn("fields_paired", both).withColumn(
        "pairing_rate", F.bround(both / F.col("fields_total"), 3)
    )


def leaf_fields(tokens: DataFrame, sep: str | None) -> DataFrame:
    """Smallest fields of each token: its delimited parts, or the token itself."""
    if not sep:
        return tokens.select("anchor_id", F.col("token").alias("label"), F.col("value").alias("field_value"))
    parts = text.token_fields(F.col("value"), sep)
    whole = F.array(F.struct(F.col("token").alias("label"), F.col("value").alias("field_value")))
    named = F.transform(
        parts, lambda f: F.struct(F.concat(F.col("token"), F.lit("."), f["name"]).alias("label"), f["value"].alias("field_value"))
    )
    return tokens.select("anchor_id", F.explode(F.coalesce(named, whole)).alias("f")).select("anchor_id", "f.*")


def phases(ops: DataFrame, emit: DataFrame | None = None, key: str = "anchor_id") -> DataFrame:
    """Operations clustered by function-name pattern: span, count, first names.

    ``emit`` (key, emit_d_ms) appends the moment a full token was first visible. The
    names are reduced to eight per phase before they are gathered.
    """
    tagged = ops.withColumn("phase", text.phase_name(F.coalesce("function", F.lit("")))).where("phase IS NOT NULL")
    spans = tagged.groupBy(key, "phase").agg(
        F.min("d_ms").alias("start_ms"), F.max("d_ms").alias("end_ms"), F.count(F.lit(1)).alias("ops")
    )
    from traceframe.operators.profile import top_k

    names = top_k(tagged.select(key, "phase", "function").distinct(), [key, "phase"], 8, F.asc("function"))
    names = names.groupBy(key, "phase").agg(F.array_sort(F.collect_list("function")).alias("functions"))
    out = spans.join(names, [key, "phase"])
    if emit is not None:
        tail = emit.where("emit_d_ms IS NOT NULL").select(
            key, F.lit("emit").alias("phase"), F.col("emit_d_ms").alias("start_ms"), F.lit(0.0).alias("end_ms"),
            F.lit(0).cast("bigint").alias("ops"), F.array().cast("array<string>").alias("functions"),
        )
        out = out.unionByName(tail)
    return out


def env_reads(ops: DataFrame, key: str = "anchor_id") -> DataFrame:
    """Environment values read before each anchor: count and first offset per API."""
    return ops.where("category = 'fingerprint'").groupBy(key, "api").agg(
        F.count(F.lit(1)).alias("count"), F.min("d_ms").alias("first_d_ms")
    )


def truncation_stats(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose captured text or hex is shorter than their declared size.

    Columns ``len``/``value`` for text and ``byte_length``/``hex`` for bytes.
    """
    as_text = F.col("len").isNotNull() & F.col("value").isNotNull()
    as_bytes = ~as_text & F.col("byte_length").isNotNull() & F.col("hex").isNotNull()
    short = (as_text & (F.col("len") > F.length("value"))) | (as_bytes & (F.col("byte_length") * 2 > F.length("hex")))
    return inputs.groupBy(*keys).agg(
        F.count_if(short).alias("truncated_events"),
        F.coalesce(F.max(F.when(as_text, F.col("len"))), F.lit(0)).cast("bigint").alias("max_input_len"),
    )


def token_visibility(strings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Earliest offset of a string that contains each token (NULL when none does).

    ``strings``: anchor_id, d_ms, value (any length >= 8); ``tokens``: anchor_id,
    token, value. Equal strings are searched once, at their earliest offset.
    """
    distinct = strings.groupBy("anchor_id", "value").agg(F.min("d_ms").alias("d_ms")).withColumn(
        "text_id", F.sha2(F.encode("value", "UTF-8"), 256)
    )
    named = tokens.select("anchor_id", F.col("token").alias("needle_id"), F.col("value").alias("needle"))
    pairs = containment_pairs(distinct.withColumnRenamed("value", "text"), named, ["anchor_id"])
    first = pairs.join(distinct.select("anchor_id", "text_id", "d_ms"), ["anchor_id", "text_id"]).groupBy(
        "anchor_id", F.col("needle_id").alias("token")
    ).agg(F.min("d_ms").alias("earliest_d_ms"))
    return tokens.select("anchor_id", "token").join(first, ["anchor_id", "token"], "left")


def with_full_value(rows: DataFrame, strings: DataFrame) -> DataFrame:
    """Put the first full string of each fingerprint, of any length, back beside its preview."""
    full = strings.where(F.length("value") >= TIMELINE_MIN_LEN).withColumn(
        "value_sha", text.sha8(F.col("value"))
    ).groupBy("anchor_id", "value_sha").agg(F.min(F.struct("file_index", "value")).alias("f"))
    full = full.select("anchor_id", "value_sha", F.col("f.value").alias("full_value"))
    joined = rows.drop("full_value").join(full, ["anchor_id", "value_sha"], "left")
    return joined.withColumn("full_value", F.coalesce("full_value", "value_preview"))
