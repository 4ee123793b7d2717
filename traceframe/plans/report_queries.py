"""Queries of the gate, the per-trace summary, the anchor explanation and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.operators import gate
from traceframe.plans import explain as explain_plan
from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import FOCUS_WINDOW_US, V_EVENTS, V_REQUESTS, v_requests
from traceframe.plans.profile_queries import FOCUS_SQL
from traceframe.plans.quality_queries import event_lines, events_typed
from traceframe.plans.summary import trace_summary
from traceframe.plans.text_queries import REQUEST_PARTS_SQL
from traceframe.session import stored
from traceframe.sources import requests as req
from traceframe.sources.ndjson import parse_lines


@query(
    "rejected_endpoints",
    f"""WITH {V_REQUESTS}, {REQUEST_PARTS_SQL}, e AS (SELECT resource_class, endpoint, count(*) AS n, min(file_index) AS fi
  FROM classed WHERE resource_class <> '' GROUP BY resource_class, endpoint),
r AS (SELECT *, row_number() OVER (PARTITION BY resource_class ORDER BY fi) AS rn FROM e)
SELECT resource_class, count(*) AS endpoint_count, CAST(sum(n) AS BIGINT) AS event_count,
  string_agg(CASE WHEN rn <= 3 THEN endpoint END, ' ' ORDER BY rn) AS examples FROM r GROUP BY resource_class""",
)
def rejected_endpoints(spark, d):
    out = gate.rejected_endpoints(gate.endpoint_counts(v_requests(spark, d)))
    return out.select("resource_class", "endpoint_count", "event_count", F.array_join("examples", " ").alias("examples"))


@query(
    "capture_gate",
    f"""WITH {V_REQUESTS}, {REQUEST_PARTS_SQL}, a AS (SELECT endpoint, min(file_index) AS fi FROM classed WHERE resource_class = '' GROUP BY endpoint),
r AS (SELECT *, row_number() OVER (ORDER BY fi) AS rn FROM a)
SELECT CASE WHEN count(*) > 0 THEN 'passed' ELSE 'pending' END AS status, CAST(count(*) AS BIGINT) AS observed_actionable_endpoint_count,
  string_agg(CASE WHEN rn <= 8 THEN endpoint END, ' ' ORDER BY rn) AS matched_endpoints FROM r""",
)
def capture_gate(spark, d):
    out = gate.capture_gate(gate.endpoint_counts(v_requests(spark, d)))
    return out.select("status", "observed_actionable_endpoint_count", F.array_join("matched_endpoints", " ").alias("matched_endpoints"))


_HELD = {
    "assembled_before_network": "n.first_network_index >= 0", "signed_url_reached_network": "n.network_signed_url_count > 0", "indirect_dispatch_seen": "c.indirect_call_count > 0",
    "families_seen_without_marker": "c.family_event_count > 0", "dispatch_in_focus_window": "coalesce(d.focus_dispatch_count, 0) > 0",
}
_LISTED = ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in _HELD.items())


# No API of the view assembles URLs, every argument holds one signed URL, and no event is part of a call tree.
@query(
    "trace_summary",
    f"""WITH {V_EVENTS}, {FOCUS_SQL},
c AS (SELECT count(*) AS event_count, count(DISTINCT session_id) AS session_count, count(family) AS family_event_count,
    CAST(count_if(api IN ('Function.prototype.call', 'Date.now')) AS BIGINT) AS runtime_signal_count,
    CAST(count_if(api = 'Function.prototype.call') AS BIGINT) AS indirect_call_count FROM v_events),
n AS (SELECT count(*) AS signed_url_count, min(file_index) AS first_signed_index,
    CAST(count_if(api = 'BrowserNetwork.request') AS BIGINT) AS network_signed_url_count,
    min(CASE WHEN api = 'BrowserNetwork.request' THEN file_index END) AS first_network_index FROM v_events),
d AS (SELECT CAST(count_if(family = 'dynamic_dispatch') AS BIGINT) AS focus_dispatch_count FROM inside)
SELECT 'events' AS trace_id, c.*, f.session_id, f.focus_time_us, f.focus_index, f.focus_seq, f.window_score, f.window_event_count, d.focus_dispatch_count,
  n.signed_url_count AS marker_occurrence_count, CAST(NULL AS BIGINT) AS first_assembly_index, n.*, concat_ws(',', {_LISTED}) AS conclusions, '' AS gaps
FROM c, n, d, trace_focus f""",
)
def summary(spark, d):
    """Headline row of the event trace, with markers searched in the arguments."""
    # The summary reads its input many times, so the parsed columns are stored once.
    e = events_typed(spark, d).select(
        "trace_id", "session_id", "file_index", "seq", "mono_time_us", "wall_time_us", "ts", "api", "family", "weight",
        F.to_json("args").alias("raw_args"),
    )
    out = trace_summary(stored(e, "events"), FOCUS_WINDOW_US, markers=("sig",))
    return out.withColumn("conclusions", F.array_join("conclusions", ",")).withColumn("gaps", F.array_join("gaps", ","))


@query("explain_anchors")
def explain_anchors(spark, d):
    """Summary of every request with a ``sig`` parameter and the ten minutes before it."""
    # Most artefacts read the events again, so the columns that they use are stored once.
    e = events_typed(spark, d).select(
        "trace_id", "session_id", "file_index", "global_seq", "mono_time_us", "category", "api", "arg0",
    )
    e = stored(e, "events")
    tables = explain_plan.explain(e, req.requests(e), "sig", 600_000_000)
    return tables["summary"].select(
        "anchor_id", "window_ops", "signer_script", "fields_total", "pairing_rate", "dag_edges", "dag_inputs"
    )


@query(
    "scan_repair",
    """SELECT CASE WHEN event_id % 9 = 0 AND event_id % 50 <> 0 THEN 'repaired' WHEN event_id % 9 <> 0 AND event_id % 10 = 0 THEN 'malformed' ELSE 'ok' END AS status,
  count(*) AS lines FROM events GROUP BY 1""",
)
def scan_repair(spark, d):
    """Ingest with repair: every ninth line has lost a comma, every tenth is cut short."""
    lines = event_lines(spark, d)
    i = F.col("file_index")
    broken = F.when(i % 9 == 0, F.replace("line", F.lit('","origin"'), F.lit('""origin"'))).when(
        i % 10 == 0, F.expr("substr(line, 1, length(line) - 5)")
    ).otherwise(F.col("line"))
    return parse_lines(lines.withColumn("line", broken), repair=True).groupBy("status").agg(F.count(F.lit(1)).alias("lines"))
