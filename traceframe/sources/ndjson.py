"""Newline-delimited JSON traces: reading, repair, quarantine, typed projection.

Line order is minted without a shuffle: a text split starts at a known byte and its
rows are consecutive inside one task, so (split start, row number in the task) sorts
a file. ``file_index`` packs both into one BIGINT; it is ordered and unique, not
dense. ``ordered.dense_index`` numbers rows where a message needs an ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys before which a lost comma is put back.
REPAIR_KEYS = (
    "result", "error", "args", "stack", "frame_url", "origin", "truncated", "global_seq",
    "result_length", "result_ref", "replace_ref", "input_ref",
)
_REPAIR = '""(' + "|".join(REPAIR_KEYS) + ')":'

_FRAMES = "array<struct<function:string,url:string,script:string,line:int,column:int>>"


def repair_line(line: Column) -> Column:
    return F.regexp_replace(line, _REPAIR, '","$1":')


def number_lines(lines: DataFrame, name: str = "file_index") -> DataFrame:
    """Ordered, unique line key per file (see the module text)."""
    in_task = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    key = F.shiftleft(F.shiftright(F.col("block_start"), 12), 31) + in_task
    return lines.withColumn("_row", F.monotonically_increasing_id()).withColumn(name, key).drop("_row")


def _text_lines(spark: SparkSession, path, stream: bool = False, **options) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).options(**options)
    raw = reader.text(path)
    lines = raw.select(
        F.trim("value").alias("line"),
        F.col("_metadata.file_path").alias("trace_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    return lines.where(F.col("line") != "")


def parse_lines(lines: DataFrame, repair: bool) -> DataFrame:
    """Add ``event`` (VARIANT or NULL), ``json`` (the text it was read from) and ``status``: ok, repaired, malformed, not_object.

    ``line`` stays as it was read.
    """
    event = F.try_parse_json("line")
    if repair:
        event = F.coalesce(event, F.try_parse_json(repair_line(F.col("line"))))
    # The generator parses a line once; without it the planner may write the parse
    # again into each of the many columns read from it.
    parsed = lines.select("*", F.explode(F.array(event)).alias("event"))
    if repair:
        plain = F.try_parse_json("line").isNotNull()
        text = F.when(F.col("_plain") | F.col("event").isNull(), F.col("line")).otherwise(repair_line(F.col("line")))
        parsed = parsed.withColumn("_plain", plain).withColumn("json", text)
    else:
        parsed = parsed.withColumn("json", F.col("line"))
    is_object = F.schema_of_variant("event").startswith("OBJECT")
    status = F.when(F.col("event").isNull(), "malformed").when(~is_object, "not_object")
    if repair:
        status = status.when(~F.col("_plain"), "repaired")
    return parsed.withColumn("status", status.otherwise("ok")).drop("_plain")


def scan_ndjson(spark: SparkSession, path, mode: str = "strict", repair: bool | None = None):
    """Read traces; ``trace_id`` is the file.

    ``strict``: a malformed or non-object line fails every query over the events, a count
    too, and an empty input fails at once; returns the events. ``bad_lines`` names the
    line numbers. ``quarantine``: returns (events, rejects), where rejects holds the malformed
    lines as they were read; non-objects are dropped.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    repair = (mode == "quarantine") if repair is None else repair
    parsed = parse_lines(number_lines(_text_lines(spark, path)), repair)
    if mode == "strict":
        where = F.concat(F.col("status"), F.lit(" line in "), F.col("trace_id"), F.lit(": "), F.col("line"))
        bad = F.col("status").isin("malformed", "not_object")
        # A filter, since a column that nothing reads would be pruned and its failure with it.
        checked = parsed.where(F.when(bad, F.raise_error(where).cast("boolean")).otherwise(F.lit(True)))
        if checked.isEmpty():
            raise ValueError(f"no events found in {path}")
        return typed_events(checked)
    rejects = parsed.where("status = 'malformed'").select("trace_id", "file_index", "line")
    return typed_events(parsed.where("status IN ('ok', 'repaired')")), rejects


def bad_lines(spark: SparkSession, path) -> DataFrame:
    """trace_id, line_number (from 1, blank lines counted), status and line of every line that a strict scan refuses.

    Rows are numbered inside their split; only one row per split is summed over a file.
    """
    raw = spark.read.text(path).select(
        F.trim("value").alias("line"), F.col("_metadata.file_path").alias("trace_id"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("_row"),
    )
    blocks = raw.groupBy("trace_id", "block_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy("trace_id").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(order), F.lit(0)))
    bad = parse_lines(raw.where("line <> ''"), repair=False).where("status <> 'ok'")
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return bad.join(blocks, ["trace_id", "block_start"]).select("trace_id", number.alias("line_number"), "status", "line")


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("event", path, "variant")), F.lit(""))


def _typed(path: str, to: str, *kinds: str) -> Column:
    """Value at a path when its JSON type is one of ``kinds``; a boolean is no number."""
    kind = _kind(path)
    match = kind.isin(*[k for k in kinds if k != "DECIMAL"])
    if "DECIMAL" in kinds:
        match = match | kind.startswith("DECIMAL")
    return F.when(match, F.try_variant_get("event", path, to))


def typed_events(parsed: DataFrame) -> DataFrame:
    """Columns the operators read, beside the VARIANT parts kept for the rest."""
    text = lambda name: _typed(f"$.{name}", "string", "STRING").alias(name)
    number = lambda name: _typed(f"$.{name}", "double", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL").alias(name)
    whole = lambda name: _typed(f"$.{name}", "bigint", "BIGINT").alias(name)
    part = lambda name: F.try_variant_get("event", f"$.{name}", "variant").alias(name)
    arg0 = F.try_variant_get("event", "$.args[0]", "variant")
    arg0 = F.when(F.schema_of_variant(arg0).startswith("OBJECT"), arg0)
    cols = [
        "trace_id", "file_index", whole("schema_version"), text("event_id"), text("session_id"),
        whole("seq"), whole("session_seq"), whole("global_seq"), text("t"), text("phase"),
        text("category"), text("api"), number("wall_time_us"), number("mono_time_us"), number("ts"),
        whole("pid"), whole("tid"), text("frame_url"), text("origin"),
        _typed("$.truncated", "boolean", "BOOLEAN").alias("truncated"),
        part("truncation"), part("result"), part("error"), part("args"), arg0.alias("arg0"),
        F.try_variant_get("event", "$.stack", _FRAMES).alias("stack"),
        text("call_id"), text("parent_id"), whole("depth"), text("causality_kind"), whole("duration_us"),
        F.json_object_keys("json").alias("keys"), F.col("json").alias("raw"),
    ]
    return parsed.select(*cols)


def arg_text(name: str) -> Column:
    """String argument ``name`` of the first argument object."""
    return F.try_variant_get("arg0", f"$.{name}", "string")


def arg_number(name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get("arg0", f"$.{name}", "variant"))
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get("arg0", f"$.{name}", "double"))
