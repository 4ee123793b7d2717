"""Queries over the event view: counts, windows, sites, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions import lookup
from traceframe.operators import profile
from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import FOCUS_WINDOW_US, V_EVENTS, family_catalogue, v_events

W = FOCUS_WINDOW_US

FOCUS_SQL = f"""
weighted AS (SELECT * FROM v_events WHERE weight > 0),
sums AS (
  SELECT trace_id, session_id, mono_time_us, file_index, seq,
    CAST(sum(weight) OVER w AS BIGINT) AS window_score,
    CAST(count(*) OVER w AS BIGINT) AS window_event_count
  FROM weighted
  WINDOW w AS (PARTITION BY session_id ORDER BY mono_time_us
    RANGE BETWEEN {W} PRECEDING AND CURRENT ROW)),
session_focus AS (
  SELECT trace_id, session_id, mono_time_us AS focus_time_us, file_index AS focus_index,
    seq AS focus_seq, window_score, window_event_count
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id
      ORDER BY window_score DESC, window_event_count DESC, mono_time_us, file_index DESC) AS rn
    FROM sums) WHERE rn = 1),
trace_focus AS (
  SELECT * FROM session_focus
  ORDER BY window_score DESC, window_event_count DESC, focus_index LIMIT 1),
inside AS (
  SELECT e.*, f.focus_time_us, f.focus_index FROM v_events e JOIN trace_focus f ON e.session_id = f.session_id
  WHERE e.mono_time_us BETWEEN f.focus_time_us - {W} AND f.focus_time_us)"""


def _focus(spark, d):
    events = v_events(spark, d)
    return events, profile.focus_by_trace(profile.focus_by_session(events, W))


def _inside(spark, d):
    events, focus = _focus(spark, d)
    return profile.window_events(events, focus, W)


@query(
    "api_counts",
    f"""WITH {V_EVENTS}
SELECT api, count, rank FROM (
  SELECT api, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, min(file_index)) AS INTEGER) AS rank
  FROM v_events GROUP BY api) WHERE rank <= 40""",
)
def api_counts(spark, d):
    return profile.api_counts(v_events(spark, d), 40).select("api", "count", "rank")


@query(
    "family_lookup",
    f"""WITH {V_EVENTS}
SELECT file_index, api, coalesce(family, '') AS family, CAST(weight AS BIGINT) AS weight FROM v_events""",
)
def family_lookup(spark, d):
    return lookup.with_family(v_events(spark, d), family_catalogue(spark)).select(
        "file_index", "api", F.coalesce("family", F.lit("")).alias("family"), "weight"
    )


@query(
    "family_counts",
    f"""WITH {V_EVENTS}
SELECT family, api, count(*) AS count, CAST(count_if(rgt IS NOT NULL) AS BIGINT) AS evidence_count
FROM v_events WHERE family IS NOT NULL GROUP BY family, api""",
)
def family_counts(spark, d):
    counts = profile.family_counts(v_events(spark, d), F.col("right").isNotNull())
    return counts.select("family", "api", "count", "evidence_count")


@query(
    "signal_counts",
    f"""WITH {V_EVENTS}
SELECT 'runtime_signal' AS signal, api, count(*) AS count FROM v_events
WHERE api IN ('Function.prototype.call', 'Date.now') GROUP BY api
UNION ALL
SELECT 'materialization', api, count(*) FROM v_events
WHERE api = 'BrowserNetwork.request' AND contains(props, '7') GROUP BY api""",
)
def signal_counts(spark, d):
    return profile.signal_counts(v_events(spark, d), F.contains("props", F.lit("7"))).select(
        "signal", "api", "count"
    )


@query(
    "focus_window",
    f"""WITH {V_EVENTS}, {FOCUS_SQL}
SELECT session_id, focus_time_us, focus_seq, window_score, window_event_count FROM session_focus""",
)
def focus_window(spark, d):
    return profile.focus_by_session(v_events(spark, d), W).select(
        "session_id", "focus_time_us", "focus_seq", "window_score", "window_event_count"
    )


@query(
    "focus_window_events",
    f"""WITH {V_EVENTS}, {FOCUS_SQL}
SELECT e.session_id, e.file_index, e.api, f.focus_time_us FROM v_events e
JOIN session_focus f ON e.session_id = f.session_id
WHERE e.mono_time_us BETWEEN f.focus_time_us - {W} AND f.focus_time_us""",
)
def focus_window_events(spark, d):
    events = v_events(spark, d)
    focus = profile.focus_by_session(events, W)
    return profile.window_events(events, focus, W).select("session_id", "file_index", "api", "focus_time_us")


@query(
    "focus_span",
    f"""WITH {V_EVENTS}, {FOCUS_SQL}
SELECT f.session_id, min(e.mono_time_us) AS window_start_us, max(f.focus_time_us) AS window_end_us
FROM session_focus f JOIN weighted e ON e.session_id = f.session_id
WHERE e.mono_time_us BETWEEN f.focus_time_us - {W} AND f.focus_time_us GROUP BY f.session_id""",
)
def focus_span(spark, d):
    events = v_events(spark, d)
    focus = profile.focus_by_session(events, W)
    return profile.focus_spans(events, focus, W).select("session_id", "window_start_us", "window_end_us")


@query(
    "focus_partial_clock",
    f"""WITH {V_EVENTS.replace("epoch_us(ts) AS mono_time_us", "epoch_us(ts) + CASE WHEN event_id % 3 = 0 THEN 7000000 ELSE 0 END AS mono_time_us")}, {FOCUS_SQL}
SELECT f.session_id, f.focus_time_us, f.focus_seq, f.window_score, f.window_event_count, min(e.mono_time_us) AS window_start_us
FROM session_focus f JOIN weighted e ON e.session_id = f.session_id
WHERE e.mono_time_us BETWEEN f.focus_time_us - {W} AND f.focus_time_us GROUP BY ALL""",
)
def focus_partial_clock(spark, d):
    """Each third event has no monotonic clock, only a wall clock that is seven seconds ahead."""
    e = v_events(spark, d)
    without = F.col("file_index") % 3 == 0
    e = e.withColumn("wall_time_us", F.col("mono_time_us") + 7_000_000).withColumn("mono_time_us", F.when(~without, F.col("mono_time_us")))
    spans = profile.focus_spans(e, profile.focus_by_session(e, W), W)
    return spans.select("session_id", "focus_time_us", "focus_seq", "window_score", "window_event_count", "window_start_us")


ROLE_SQL = """CASE WHEN list_contains(families, 'dynamic_dispatch') THEN 'dispatcher_candidate'
    WHEN list_contains(families, 'anti_debug_timing') THEN 'anti_debug_candidate'
    WHEN list_contains(families, 'byte_buffer') THEN 'state_table_candidate'
    WHEN list_contains(families, 'int_bitwise') THEN 'handler_candidate'
    ELSE 'supporting_runtime_candidate' END"""

HOTSPOT_SQL = f"""WITH {V_EVENTS}, {FOCUS_SQL},
sites AS (
  SELECT url, fn, line, col, count(*) AS event_count, CAST(sum(weight) AS BIGINT) AS weight_sum,
    min(seq) AS first_seq, max(seq) AS last_seq, min(file_index) AS first_index,
    list_sort(list(DISTINCT family)) AS families
  FROM (SELECT *, CAST(1 AS BIGINT) AS line FROM inside WHERE family IS NOT NULL) GROUP BY url, fn, line, col)
SELECT url, fn AS "function", line, col AS "column", {ROLE_SQL} AS role,
  weight_sum * 10 + event_count AS score, event_count, first_seq, last_seq
FROM sites ORDER BY score DESC, event_count DESC, first_index LIMIT 30"""


@query("hotspots", HOTSPOT_SQL)
def hotspots(spark, d):
    return profile.hotspots(_inside(spark, d)).select(
        "url", "function", "line", "column", "role", "score", "event_count", "first_seq", "last_seq"
    )


@query(
    "site_role",
    f"""WITH {V_EVENTS}, sites AS (
  SELECT url, fn, list(DISTINCT family) AS families FROM v_events
  WHERE family IS NOT NULL AND rgt > 60 GROUP BY url, fn)
SELECT url, fn AS "function", {ROLE_SQL} AS role FROM sites""",
)
def site_role(spark, d):
    rows = lookup.with_family(v_events(spark, d)).where("family IS NOT NULL AND right > 60")
    sites = rows.groupBy("url", "function").agg(F.collect_set("family").alias("families"))
    return sites.select("url", "function", profile.site_role(F.col("families")).alias("role"))


SHAPE_SQL = """CASE WHEN calls > 0.5 * n THEN 'DISPATCH' WHEN xors > 0.4 * n THEN 'XOR_MIX' ELSE 'MIXED' END"""


@query(
    "op_shape",
    f"""WITH {V_EVENTS}, sites AS (
  SELECT session_id, url, fn, count(*) AS n,
    count_if(api = 'Function.prototype.call') AS calls, count_if(api = 'Bitwise.xor') AS xors
  FROM v_events WHERE family IS NOT NULL GROUP BY session_id, url, fn)
SELECT session_id, url, fn AS "function", n AS count, {SHAPE_SQL} AS shape FROM sites""",
)
def op_shape(spark, d):
    rows = lookup.with_family(v_events(spark, d)).where("family IS NOT NULL")
    return profile.shape_by_site(rows, ["session_id", "url", "function"])


OPCODE_SQL = f"""opcodes AS (
  SELECT url, fn, col, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq,
    count_if(api = 'Function.prototype.call') AS calls, count_if(api = 'Bitwise.xor') AS xors,
    list(DISTINCT family) AS families,
    row_number() OVER (ORDER BY count(*) DESC, min(file_index)) - 1 AS opcode
  FROM inside WHERE family IS NOT NULL GROUP BY url, fn, col)"""


@query(
    "opcode_table",
    f"""WITH {V_EVENTS}, {FOCUS_SQL}, {OPCODE_SQL}
SELECT opcode, url, fn AS "function", col AS "column", n AS count, {SHAPE_SQL} AS shape,
  {ROLE_SQL} AS role, first_seq, last_seq FROM opcodes WHERE opcode < 40""",
)
def opcode_table(spark, d):
    return profile.opcode_table(_inside(spark, d)).select(
        "opcode", "url", "function", "column", "count", "shape", "role", "first_seq", "last_seq"
    )


@query(
    "site_constants",
    f"""WITH {V_EVENTS}, {FOCUS_SQL},
c AS (SELECT url, fn, col, rgt AS constant, count(*) AS count,
    CAST(row_number() OVER (PARTITION BY url, fn, col ORDER BY count(*) DESC, min(file_index)) AS INTEGER) AS rank
  FROM inside WHERE family IS NOT NULL AND abs(rgt) > 1 GROUP BY url, fn, col, rgt)
SELECT url, fn AS "function", col AS "column", constant, count, rank FROM c WHERE rank <= 8""",
)
def site_constants(spark, d):
    rows = lookup.with_family(_inside(spark, d)).where("family IS NOT NULL")
    keys = ["trace_id", *profile.SITE]
    counted = (
        profile.site_constants(rows, ("right",))
        .groupBy(*keys, "constant")
        .agg(F.count(F.lit(1)).alias("count"), F.min("file_index").alias("first_index"))
    )
    return profile.top_k(counted, keys, 8, F.desc("count"), F.asc("first_index")).select(
        "url", "function", "column", "constant", "count", "rank"
    )


@query(
    "top_script",
    f"""WITH {V_EVENTS}
SELECT url AS script, count(*) AS ops FROM v_events
WHERE starts_with(api, 'Bitwise.') OR starts_with(api, 'DataView.')
GROUP BY url ORDER BY ops DESC, min(file_index) LIMIT 1""",
)
def top_script(spark, d):
    return profile.densest_script(v_events(spark, d)).select("script", "ops")


@query(
    "window_profile",
    f"""WITH {V_EVENTS}, {FOCUS_SQL}, named AS (SELECT * FROM inside WHERE family IS NOT NULL),
items AS (
  SELECT 'api' AS kind, api AS item, count(*) AS count, min(file_index) AS fi, 50 AS k FROM named GROUP BY api
  UNION ALL SELECT 'family', family, count(*), min(file_index), 50 FROM named GROUP BY family
  UNION ALL SELECT 'stack', url || ' ' || fn, count(*), min(file_index), 30 FROM named GROUP BY url, fn
  UNION ALL SELECT 'events', '', count(*), min(file_index), 1 FROM inside
  UNION ALL SELECT 'family_events', '', count(*), min(file_index), 1 FROM named)
SELECT kind, item, count, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY count DESC, fi) AS INTEGER) AS rank FROM items)
WHERE rank <= k""",
)
def window_profile(spark, d):
    return profile.window_profile(_inside(spark, d)).select("kind", "item", "count", "rank")


@query(
    "window_tail",
    f"""WITH {V_EVENTS}, {FOCUS_SQL},
t AS (
  SELECT 'marker_events' AS list, file_index, api,
    row_number() OVER (ORDER BY file_index) AS rn FROM inside WHERE contains(props, '7')
  UNION ALL
  SELECT 'last_events', file_index, api, row_number() OVER (ORDER BY file_index DESC)
  FROM inside WHERE family IS NOT NULL)
SELECT list, file_index, api, CAST(rn AS INTEGER) AS rank FROM t WHERE rn <= 20""",
)
def window_tail(spark, d):
    inside = lookup.with_family(_inside(spark, d))
    return profile.first_last(
        inside, F.contains("props", F.lit("7")), F.col("family").isNotNull(), 20
    ).select("list", "file_index", "api", "rank")
