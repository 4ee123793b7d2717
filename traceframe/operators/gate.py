"""The capture gate: does a trace already hold a request worth analysing?

Everything follows from one small table, distinct endpoints with counts, so batch and
streaming share the rules and differ only in how that table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions import text
from traceframe.operators.profile import top_k

# --- fixed values -----------------------------------------------------------
TAIL_APIS = ("BrowserNetwork.request", "Request.constructor", "fetch", "XMLHttpRequest.open", "XMLHttpRequest.send")
REJECT_CLASSES = ("document_request", "static_resource", "telemetry_endpoint")
SHOWN_ENDPOINTS = 8
SHOWN_EXAMPLES = 3
# --- end of fixed values ----------------------------------------------------


def event_url() -> Column:
    """URL of a typed event: url, href, request_url or request.url of its argument."""
    arg = lambda p: F.nullif(F.try_variant_get("arg0", f"$.{p}", "string"), F.lit(""))
    return F.coalesce(arg("url"), arg("href"), arg("request_url"), arg("request.url"), F.lit(""))


def network_rows(events: DataFrame) -> DataFrame:
    """Network events of a typed trace with the columns the gate reads."""
    arg = lambda p: F.try_variant_get("arg0", f"$.{p}", "string")
    rows = events.where((F.col("category") == "network") & F.col("api").isin(*TAIL_APIS))
    return rows.select(
        "trace_id", "file_index", "category", "api", event_url().alias("url"),
        F.coalesce(arg("request_destination"), arg("destination")).alias("destination"), arg("resource_type").alias("resource_type"),
    )


def classified(rows: DataFrame) -> DataFrame:
    optional = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    kept = rows.where((F.col("category") == "network") & F.col("api").isin(*TAIL_APIS) & (F.col("url") != ""))
    klass = text.resource_class(F.col("url"), F.col("api"), optional("destination"), optional("resource_type"))
    return kept.withColumn("resource_class", klass).withColumn("endpoint", text.canonical_endpoint(F.col("url"))).withColumn(
        "actionable", (F.col("resource_class") == "") & (F.col("api") == "BrowserNetwork.request")
    )


def endpoint_counts(rows: DataFrame) -> DataFrame:
    """Distinct endpoints per trace and class; the only state a live gate keeps."""
    return classified(rows).groupBy("trace_id", "resource_class", "actionable", "endpoint").agg(
        F.count(F.lit(1)).alias("events"), F.min("file_index").alias("first_index")
    )


def rejected_endpoints(counts: DataFrame, shown_examples: int = SHOWN_EXAMPLES) -> DataFrame:
    """Per rejected class: endpoints, events and the first examples."""
    rejected = counts.where("resource_class <> ''").groupBy("trace_id", "resource_class", "endpoint").agg(
        F.sum("events").alias("events"), F.min("first_index").alias("first_index")
    )
    sizes = rejected.groupBy("trace_id", "resource_class").agg(
        F.count(F.lit(1)).alias("endpoint_count"), F.sum("events").alias("event_count")
    )
    shown = top_k(rejected, ["trace_id", "resource_class"], shown_examples, F.asc("first_index"))
    examples = shown.groupBy("trace_id", "resource_class").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "endpoint"))), lambda x: x["endpoint"]).alias("examples")
    )
    position = F.array_position(F.array(*[F.lit(c) for c in REJECT_CLASSES]), F.col("resource_class"))
    return sizes.join(examples, ["trace_id", "resource_class"]).withColumn("position", position)


def capture_gate(counts: DataFrame, traces: DataFrame | None = None, start_url: str = "", shown_endpoints: int = SHOWN_ENDPOINTS) -> DataFrame:
    """Per trace: passed once an actionable endpoint was seen; their number, and the first of them."""
    actionable = counts.where("actionable").groupBy("trace_id", "endpoint").agg(F.min("first_index").alias("first_index"))
    shown = top_k(actionable, ["trace_id"], shown_endpoints, F.asc("first_index")).groupBy("trace_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "endpoint"))), lambda x: x["endpoint"]).alias("matched_endpoints")
    )
    seen = actionable.groupBy("trace_id").agg(F.count(F.lit(1)).alias("endpoints"))
    rejected = rejected_endpoints(counts).groupBy("trace_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "resource_class", "endpoint_count", "event_count"))),
            lambda x: F.struct(x["resource_class"].alias("resource_class"), x["endpoint_count"].alias("endpoint_count"), x["event_count"].alias("event_count")),
        ).alias("rejected")
    )
    base = (traces if traces is not None else counts).select("trace_id").distinct()
    out = base.join(shown, "trace_id", "left").join(seen, "trace_id", "left").join(rejected, "trace_id", "left")
    none = F.array().cast("array<string>")
    matched = F.coalesce("matched_endpoints", none)
    passed = F.size(matched) > 0
    fallback = F.array(text.same_origin_pattern(F.lit(start_url)), F.lit("fetch/XMLHttpRequest non-static endpoint"))
    return out.select(
        "trace_id", F.when(passed, "passed").otherwise("pending").alias("status"),
        F.coalesce("endpoints", F.lit(0)).cast("bigint").alias("observed_actionable_endpoint_count"), matched.alias("matched_endpoints"),
        F.when(passed, none).otherwise(F.array(F.lit("business_api_anchor_not_captured"))).alias("missing"),
        "rejected", F.when(passed, matched).otherwise(fallback).alias("target_endpoint_patterns"),
    )
