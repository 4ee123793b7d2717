"""One row per trace with the headline numbers, conclusions and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.functions import lookup, nested
from traceframe.operators import carriers, causal, profile
from traceframe.session import stored


def trace_summary(events: DataFrame, window_us: int, markers: tuple[str, ...] = (), generic: bool = True) -> DataFrame:
    """``events``: trace_id, session_id, file_index, seq, mono_time_us, api, and ``raw_args``
    (JSON text of the arguments) when markers are given. Causal columns are used when present.
    """
    api = F.col("api")
    rows = lookup.with_family(events)
    indirect = api.isin("Reflect.apply", "Function.prototype.call", "Function.prototype.apply")
    counts = rows.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("session_id").alias("session_count"),
        F.count_if(F.col("family").isNotNull()).alias("family_event_count"),
        F.count_if(lookup.is_runtime_signal(api)).alias("runtime_signal_count"),
        F.count_if(indirect).alias("indirect_call_count"),
    )
    out = counts
    if generic:
        focus = profile.focus_by_trace(profile.focus_by_session(events, window_us))
        inside = profile.window_events(events, focus, window_us)
        dispatch = lookup.with_family(inside).groupBy("trace_id").agg(
            F.count_if(F.col("family") == "dynamic_dispatch").alias("focus_dispatch_count")
        )
        out = out.join(focus, "trace_id", "left").join(dispatch, "trace_id", "left")
    if markers:
        keep = ["trace_id", "file_index", "api"]
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains("text", F.lit(m))
        from traceframe.functions.text import extract_urls

        # One walk serves both counts: the leaves that have a marker or may hold a URL are stored.
        leaf = nested.string_leaves(events, "raw_args", keep).where(~nested.is_source_path(F.col("keys")))
        leaf = stored(leaf.where(hit | F.contains("text", F.lit("http"))).select(*keep, "text"), "marked-leaves")
        urls = leaf.select(*keep, F.explode(extract_urls(F.col("text"))).alias("u"))
        signed = carriers.signed_urls(urls, "u", list(markers), keep)
        order = F.min("file_index")
        out = out.join(leaf.where(hit).groupBy("trace_id").agg(
            F.count(F.lit(1)).alias("marker_occurrence_count"),
            F.min(F.when(api.isin(*lookup.URL_ASSEMBLY_APIS), F.col("file_index"))).alias("first_assembly_index"),
        ), "trace_id", "left").join(signed.groupBy("trace_id").agg(
            F.count(F.lit(1)).alias("signed_url_count"), order.alias("first_signed_index"),
            F.count_if(api.isin(*lookup.NETWORK_APIS)).alias("network_signed_url_count"),
            F.min(F.when(api.isin(*lookup.NETWORK_APIS), F.col("file_index"))).alias("first_network_index"),
        ), "trace_id", "left")
    if {"schema_version", "call_id", "causality_kind"} <= set(events.columns):
        out = out.join(causal.causality_summary(events).drop("events"), "trace_id", "left")
    has = set(out.columns)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in has else F.lit(0)
    conclusions = [
        ("assembled_before_network", (n("first_assembly_index") <= F.col("first_network_index")) if "first_network_index" in has else F.lit(False)),
        ("signed_url_reached_network", n("network_signed_url_count") > 0),
        ("indirect_dispatch_seen", n("indirect_call_count") > 0),
        ("families_seen_without_marker", F.lit(generic) & (n("family_event_count") > 0)),
        ("dispatch_in_focus_window", F.lit(generic) & (n("focus_dispatch_count") > 0)),
        ("no_signed_url", F.lit(not generic and bool(markers)) & (n("signed_url_count") == 0)),
    ]
    gaps = [
        ("no_targets_configured", F.lit(not generic and not markers)),
        ("no_network_request_with_target", F.lit(not generic and bool(markers)) & (n("network_signed_url_count") == 0)),
        ("no_assembly_with_target", F.lit(not generic and bool(markers)) & (F.col("first_assembly_index").isNull() if "first_assembly_index" in has else F.lit(True))),
        ("no_runtime_signals", n("runtime_signal_count") == 0),
        ("no_family_events", F.lit(generic) & (n("family_event_count") == 0)),
        ("no_focus", F.lit(generic) & (F.col("focus_index").isNull() if "focus_index" in has else F.lit(False))),
    ]
    listed = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))
    return out.withColumn("conclusions", listed(conclusions)).withColumn("gaps", listed(gaps))
