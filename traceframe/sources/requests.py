"""Requests, time-window scans and compute events out of a typed trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions import lookup

_HEADERS = "array<struct<name:string,value:string>>"


def _arg(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("arg0", f"$.{path}", kind)


def _present(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def decode_body(text: Column, hexed: Column) -> Column:
    """Body text, else the hex body as UTF-8; invalid bytes are dropped."""
    raw = F.try_to_binary(hexed, F.lit("hex")).cast("string")
    dropped = F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))
    return _present(text, F.when(F.is_valid_utf8(raw), raw).otherwise(dropped))


def requests(events: DataFrame) -> DataFrame:
    """HTTP requests and WebSocket sends; a frame payload counts as a body."""
    rows = events.where(F.col("api").isin("BrowserNetwork.request", "WebSocket.send"))
    socket = F.col("api") == "WebSocket.send"
    payload = _present(_arg("data"), _arg("message"), _arg("payload"))
    body = decode_body(_arg("upload_body.body_text"), _arg("upload_body.body_hex"))
    return rows.select(
        "trace_id", "session_id", "file_index", "mono_time_us", "api",
        F.coalesce(_arg("url"), F.lit("")).alias("url"),
        F.coalesce(_arg("method"), F.lit("")).alias("method"),
        F.when(~socket, _arg("headers", _HEADERS)).alias("headers"),
        F.when(socket, payload).otherwise(body).alias("body"),
    )


def window_scan(events: DataFrame, lo: float, hi: float):
    """(operations, network rows, long strings) with a monotonic time in [lo, hi].

    The range is a filter on one column, so it prunes row groups when the trace is
    stored as Parquet sorted by time.
    """
    inside = events.where(F.col("mono_time_us").between(lo, hi))
    network = inside.where("category = 'network'")
    ops = inside.where("coalesce(category, '') <> 'network' AND arg0 IS NOT NULL")
    return ops, network, argument_strings(ops, 8)


def argument_strings(ops: DataFrame, min_len: int, *keep: str) -> DataFrame:
    """String members of the first argument, one row each."""
    members = F.map_entries(F.try_variant_get("arg0", "$", "map<string,variant>"))
    rows = ops.select("trace_id", "file_index", "mono_time_us", *keep, F.explode(members).alias("m"))
    is_text = F.schema_of_variant(F.col("m.value")) == "STRING"
    named = rows.where(is_text).select(
        "trace_id", "file_index", "mono_time_us", *keep, F.col("m.key").alias("key"),
        F.try_variant_get(F.col("m.value"), "$", "string").alias("value"),
    )
    return named.where(F.length("value") >= min_len)


def compute_events(events: DataFrame, groups=lookup.DEFAULT_COMPUTE) -> DataFrame:
    """Times of the computing operations of the named groups."""
    hits = events.where(lookup.is_compute(F.col("api"), groups) & F.col("mono_time_us").isNotNull())
    return hits.select("trace_id", "file_index", "mono_time_us")


# Fixed value: shortest string that can be the input of a digest or cipher.
MATERIAL_MIN_LEN = 24


def material_events(events: DataFrame) -> DataFrame:
    """Times of injected events that carry a long string."""
    injected = events.where("category = 'inject' AND arg0 IS NOT NULL AND mono_time_us IS NOT NULL")
    found = argument_strings(injected, MATERIAL_MIN_LEN)
    return found.select("trace_id", "file_index", "mono_time_us").distinct()
