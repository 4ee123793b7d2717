"""Queries over requests, carriers, bursts and source attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.operators import carriers, profile, provenance
from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import (
    FOCUS_WINDOW_US, V_ASSETS, V_EVENTS, V_REQUESTS, table, v_assets, v_events, v_requests,
)
from traceframe.plans.profile_queries import FOCUS_SQL, ROLE_SQL
from traceframe.sources import requests as req

W = FOCUS_WINDOW_US

CARRIER_SQL = f"""q AS (
  SELECT file_index, mono_time_us, unnest(string_split(split_part(url, '?', 2), '&')) AS kv FROM v_requests),
nv AS (SELECT file_index, mono_time_us, split_part(kv, '=', 1) AS name, substr(kv, instr(kv, '=') + 1) AS value
  FROM q WHERE instr(kv, '=') > 0),
ch AS (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM nv)),
chn AS (SELECT value, c, count(*) AS n FROM ch WHERE c <> '' GROUP BY value, c),
tot AS (SELECT value, sum(n) AS total FROM chn GROUP BY value),
ent AS (SELECT a.value, -sum(n / total * log2(n / total)) AS entropy FROM chn a JOIN tot b ON a.value = b.value GROUP BY a.value),
carriers AS (SELECT nv.*, e.entropy FROM nv JOIN ent e ON nv.value = e.value
  WHERE lower(name) IN ('sign', 'signature', 'sig', 'token')
    OR (regexp_full_match(nv.value, '[A-Za-z0-9_\\-+/=.]{{16,}}') AND e.entropy >= 3.0))"""


@query(
    "carriers",
    f"WITH {V_REQUESTS}, {CARRIER_SQL} SELECT file_index, name, value, 'query' AS \"where\" FROM carriers",
)
def carrier_rows(spark, d):
    return carriers.request_carriers(v_requests(spark, d), 3.0).select("file_index", "name", "value", "where")


@query(
    "burst_count",
    f"""WITH {V_EVENTS}
SELECT r.file_index, count(c.file_index) AS burst FROM v_events r LEFT JOIN v_events c
  ON c.mono_time_us BETWEEN r.mono_time_us - {W} AND r.mono_time_us
  AND (starts_with(c.api, 'Bitwise.') OR starts_with(c.api, 'DataView.'))
WHERE r.api = 'BrowserNetwork.request' GROUP BY r.file_index""",
)
def burst_count(spark, d):
    e = v_events(spark, d)
    r = e.where("api = 'BrowserNetwork.request'").select("trace_id", "file_index", "mono_time_us")
    return carriers.with_burst(r, req.compute_events(e), W).select("file_index", "burst")


@query(
    "anchor_by_material",
    f"""WITH {V_EVENTS}, n AS (
  SELECT r.session_id, r.file_index, r.mono_time_us, count(c.file_index) AS burst FROM v_events r LEFT JOIN v_events c
    ON c.mono_time_us BETWEEN r.mono_time_us - {W} AND r.mono_time_us AND c.category = 'fingerprint'
  WHERE r.api = 'BrowserNetwork.request' GROUP BY ALL)
SELECT session_id, file_index AS anchor_index, mono_time_us AS anchor_time_us, burst AS material_events
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY burst DESC, mono_time_us) AS rn FROM n)
WHERE rn = 1""".replace("GROUP BY ALL", "GROUP BY r.session_id, r.file_index, r.mono_time_us"),
)
def anchor_by_material(spark, d):
    e = v_events(spark, d)
    anchors = e.where("api = 'BrowserNetwork.request'")
    material = e.where("category = 'fingerprint'").select("trace_id", "file_index", "mono_time_us")
    return carriers.anchor_by_material(anchors, material, W, ["session_id"])


@query(
    "carrier_rank",
    f"""WITH {V_EVENTS}, {V_REQUESTS}, {CARRIER_SQL},
pts AS (SELECT file_index * 25000 AS t FROM v_events WHERE starts_with(api, 'Bitwise.') OR starts_with(api, 'DataView.')),
b AS (SELECT c.file_index, c.name, count(p.t) AS burst FROM carriers c LEFT JOIN pts p
  ON p.t BETWEEN c.mono_time_us - 300000 AND c.mono_time_us GROUP BY c.file_index, c.name),
x AS (SELECT c.name, count(*) AS count, count(DISTINCT c.value) AS distinct_values, max(c.entropy) AS ent,
    max(length(c.value)) AS example_len, max(b.burst) AS max_compute_burst, min(c.file_index) AS fi
  FROM carriers c JOIN b ON c.file_index = b.file_index AND c.name = b.name GROUP BY c.name)
SELECT name, count, distinct_values, example_len, max_compute_burst,
  round(distinct_values / count * ent * log10(max_compute_burst + 10)
    * CASE WHEN lower(name) IN ('sign', 'signature', 'sig', 'token') THEN 2.0 ELSE 1.0 END, 3) AS score
FROM x ORDER BY score DESC, fi LIMIT 10""",
)
def carrier_rank(spark, d):
    found = carriers.request_carriers(v_requests(spark, d), 3.0)
    points = req.compute_events(v_events(spark, d)).select(
        F.lit("pages").alias("trace_id"), "file_index", (F.col("file_index") * 25000).alias("mono_time_us")
    )
    ranked = carriers.rank_carriers(carriers.with_burst(found, points, 300_000))
    return ranked.select("name", "count", "distinct_values", "example_len", "max_compute_burst", "score")


@query(
    "signed_urls",
    f"""WITH {V_REQUESTS}, q AS (SELECT *, list_sort(list_distinct(list_transform(
    string_split(split_part(url, '?', 2), '&'), lambda x: split_part(x, '=', 1)))) AS keys FROM v_requests)
SELECT file_index, 'sig' AS primary_target, CAST(32 AS BIGINT) AS primary_value_length,
  array_to_string(keys, ',') AS query_keys, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host,
  method = 'GET' AS is_first_method FROM q""",
)
def signed_urls(spark, d):
    out = carriers.signed_urls(v_requests(spark, d), "url", ["sig"], ["file_index", "method"])
    return out.select(
        "file_index", "primary_target", "primary_value_length",
        F.array_join("query_keys", ",").alias("query_keys"), "host",
        (F.col("method") == "GET").alias("is_first_method"),
    )


@query(
    "request_correlation",
    f"""WITH {V_REQUESTS} SELECT file_index, method FROM v_requests
WHERE network_correlation_key IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en')""",
)
def request_correlation(spark, d):
    renderer = table(spark, d, "documents").where("lang = 'en'").select(
        F.col("doc_id").cast("string").alias("network_correlation_key")
    )
    return carriers.correlated(v_requests(spark, d), renderer).select("file_index", "method")


@query(
    "object_link",
    """SELECT l_returnflag AS header_name, count(*) AS reads FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY l_returnflag""",
)
def object_link(spark, d):
    owners = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("headers_id"))
    reads = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("headers_id"), "l_returnflag")
    linked = carriers.linked_reads(owners, reads)
    return linked.groupBy(F.col("l_returnflag").alias("header_name")).agg(F.count(F.lit(1)).alias("reads"))


@query(
    "expected_missing",
    f"""WITH {V_EVENTS}, r(api) AS (VALUES ('fetch'), ('Date.now'), ('XMLHttpRequest.open'), ('Bitwise.xor'))
SELECT api FROM r WHERE api NOT IN (SELECT api FROM v_events)""",
)
def expected_missing(spark, d):
    names = ["fetch", "Date.now", "XMLHttpRequest.open", "Bitwise.xor"]
    required = spark.createDataFrame([(n,) for n in names], "api STRING")
    return carriers.expected_missing(v_events(spark, d), required)


def _registrations(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.lit("lineitem").alias("trace_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_index"),
        F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string"))).alias("session_id"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber") % 4).cast("bigint").alias("isolate_id"),
        (F.col("l_partkey") % 700).alias("script_id"),
        F.when(F.col("l_partkey") % 5 == 1, F.concat(F.lit("u"), F.col("l_suppkey").cast("string"))).alias("script_url"),
        F.when(F.col("l_partkey") % 7 == 1, F.concat(F.lit("a"), F.col("l_suppkey").cast("string"))).alias("asset_id"),
        F.lit(None).cast("string").alias("source_hash"), F.lit(None).cast("bigint").alias("source_length"),
        F.lit(None).cast("bigint").alias("seq"), "l_returnflag",
    )


def _calls(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.lit("lineitem").alias("trace_id"), F.col("o_orderkey").alias("call"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string"))).alias("session_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5).alias("isolate_id"),
        (F.col("o_custkey") % 700).alias("script_id"),
    )


@query(
    "registry_resolve",
    """WITH reg0 AS (
  SELECT l_orderkey * 10 + l_linenumber AS fi,
    CASE WHEN l_suppkey % 3 <> 0 THEN 's' || CAST(l_suppkey % 3 AS VARCHAR) END AS s,
    CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_linenumber % 4 AS BIGINT) END AS i, l_partkey % 700 AS k,
    CASE WHEN l_partkey % 5 = 1 THEN 'u' || CAST(l_suppkey AS VARCHAR) END AS u,
    CASE WHEN l_partkey % 7 = 1 THEN 'a' || CAST(l_suppkey AS VARCHAR) END AS a
  FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 700 > 0),
reg AS (SELECT s, i, k, arg_max(u, fi) FILTER (WHERE u IS NOT NULL) AS url,
    arg_max(a, fi) FILTER (WHERE a IS NOT NULL) AS asset,
    min(fi) FILTER (WHERE u IS NOT NULL OR a IS NOT NULL) AS fi
  FROM reg0 GROUP BY s, i, k HAVING count(u) + count(a) > 0),
bare AS (SELECT k, arg_min(url, fi) AS url, arg_min(asset, fi) AS asset, min(fi) AS fi FROM
  (SELECT k, coalesce(url, '') AS url, coalesce(asset, '') AS asset, fi FROM reg) GROUP BY k),
calls AS (SELECT o_orderkey AS call,
    CASE WHEN o_orderkey % 5 <> 0 THEN 's' || CAST(o_orderkey % 4 AS VARCHAR) END AS s,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 END AS i, o_custkey % 700 AS k FROM orders)
SELECT c.call, CASE WHEN r1.fi IS NOT NULL THEN coalesce(r1.url, '') WHEN r2.fi IS NOT NULL THEN coalesce(r2.url, '')
    WHEN r3.fi IS NOT NULL THEN coalesce(r3.url, '') WHEN r4.fi IS NOT NULL THEN coalesce(r4.url, '')
    ELSE coalesce(b.url, '') END AS script_url,
  CASE WHEN r1.fi IS NOT NULL THEN 1 WHEN r2.fi IS NOT NULL THEN 2 WHEN r3.fi IS NOT NULL THEN 3
    WHEN r4.fi IS NOT NULL THEN 4 WHEN b.fi IS NOT NULL THEN 5 ELSE 0 END AS step
FROM calls c
LEFT JOIN reg r1 ON r1.k = c.k AND r1.s IS NOT DISTINCT FROM c.s AND r1.i IS NOT DISTINCT FROM c.i
LEFT JOIN reg r2 ON r2.k = c.k AND r2.s IS NOT DISTINCT FROM c.s AND r2.i IS NULL
LEFT JOIN reg r3 ON r3.k = c.k AND r3.s IS NULL AND r3.i IS NOT DISTINCT FROM c.i
LEFT JOIN reg r4 ON r4.k = c.k AND r4.s IS NULL AND r4.i IS NULL
LEFT JOIN bare b ON b.k = c.k""",
)
def registry_resolve(spark, d):
    registry = provenance.script_registry(_registrations(spark, d).where("l_returnflag = 'R'"))
    out = provenance.resolve_scripts(_calls(spark, d), registry)
    return out.select(
        "call", F.coalesce("record.script_url", F.lit("")).alias("script_url"),
        F.coalesce("step", F.lit(0)).alias("step"),
    )


@query(
    "callsite_counts",
    """WITH reg AS (SELECT DISTINCT l_partkey % 700 AS k FROM lineitem
  WHERE l_partkey % 700 > 0 AND (l_partkey % 5 = 1 OR l_partkey % 7 = 1))
SELECT CAST(count_if(o_custkey % 700 IN (SELECT k FROM reg)) AS BIGINT) AS resolved_count,
  CAST(count_if(o_custkey % 700 NOT IN (SELECT k FROM reg)) AS BIGINT) AS unresolved_count FROM orders""",
)
def callsite_counts(spark, d):
    registry = provenance.script_registry(_registrations(spark, d))
    calls = _calls(spark, d).withColumn("callsite_mode", F.lit("dispatch_light"))
    out = provenance.callsite_counts(provenance.dispatch_callsites(calls, registry))
    return out.select("resolved_count", "unresolved_count")


@query(
    "stack_top",
    f"""WITH {V_EVENTS}
SELECT file_index, CASE WHEN file_index % 3 = 0 THEN url WHEN file_index % 3 = 1 THEN 'js-' || url ELSE 'inline' END AS url,
  fn AS "function" FROM v_events""",
)
def stack_top(spark, d):
    e = v_events(spark, d)
    frames = "array<struct<function:string,url:string,script:string,line:int,column:int>>"

    def frame(url, script):
        return F.struct(
            F.col("function"), url.alias("url"), script.alias("script"), F.lit(1).alias("line"), F.lit(2).alias("column")
        )

    builtin = frame(F.lit(""), F.lit(""))
    third = F.col("file_index") % 3
    stack = F.when(third == 0, F.array(builtin, frame(F.lit(""), F.col("url")))).otherwise(F.array(builtin))
    js = F.when(third == 1, F.array(builtin, frame(F.concat(F.lit("js-"), "url"), F.lit(""))))
    site = F.struct(F.col("function"), F.lit("inline").alias("url"), F.lit(1).cast("bigint").alias("line"), F.lit(1).cast("bigint").alias("column"))
    top = provenance.stack_top(stack.cast(frames), js.cast(frames), callsite=site)
    return e.select("file_index", top["url"].alias("url"), top["function"].alias("function"))


@query(
    "asset_resolve",
    f"""WITH {V_ASSETS}, sites AS (
  SELECT doc_id AS site, CASE WHEN doc_id % 3 = 0 THEN asset_id WHEN doc_id % 3 = 1 THEN 'gone' END AS asset_id,
    CASE WHEN doc_id % 2 = 0 THEN source_hash ELSE '' END AS source_hash, url FROM v_assets),
h AS (SELECT source_hash, max(doc_id) AS m FROM v_assets GROUP BY source_hash),
r AS (SELECT s.site, CASE WHEN a.doc_id IS NOT NULL THEN a.doc_id WHEN h.m IS NOT NULL THEN h.m ELSE u.doc_id END AS m,
    CASE WHEN a.doc_id IS NULL AND h.m IS NULL AND (coalesce(s.asset_id, '') <> '' OR coalesce(s.source_hash, '') <> '')
      THEN true ELSE false END AS weak
  FROM sites s LEFT JOIN v_assets a ON a.asset_id = s.asset_id LEFT JOIN h ON h.source_hash = s.source_hash
  LEFT JOIN v_assets u ON u.url = s.url)
SELECT site, m AS manifest_index, weak OR m % 10 = 0 AS source_unverified FROM r""",
)
def asset_resolve(spark, d):
    from traceframe.sources.assets import with_hash_check

    assets = with_hash_check(v_assets(spark, d)).withColumn("manifest_index", F.col("doc_id"))
    third = F.col("doc_id") % 3
    sites = v_assets(spark, d).select(
        F.col("doc_id").alias("site"),
        F.when(third == 0, F.col("asset_id")).when(third == 1, "gone").alias("asset_id"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source_hash")).otherwise("").alias("source_hash"), "url",
    )
    return provenance.resolve_assets(sites, assets).select("site", "manifest_index", "source_unverified")


@query(
    "site_candidates",
    f"""WITH {V_EVENTS}, {FOCUS_SQL}, s AS (
  SELECT url, fn, col, count(*) AS event_count, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight_sum,
    count_if(contains(props, '7')) AS marker_count, count_if(focus_time_us - mono_time_us <= 3600000000) AS proximity_hits,
    min(seq) AS first_seq, max(seq) AS last_seq, min(file_index) AS fi,
    list(DISTINCT family) FILTER (WHERE family IS NOT NULL) AS families
  FROM inside GROUP BY url, fn, col)
SELECT url, fn AS "function", col AS source_position, {ROLE_SQL} AS role,
  weight_sum * 10 + CAST(proximity_hits AS BIGINT) * 5 + event_count AS score,
  event_count, CAST(marker_count AS BIGINT) AS marker_count, CAST(proximity_hits AS BIGINT) AS proximity_hits, first_seq, last_seq
FROM s ORDER BY weight_sum DESC, proximity_hits DESC, event_count DESC, fi LIMIT 30""",
)
def site_candidates(spark, d):
    e = v_events(spark, d)
    focus = profile.focus_by_trace(profile.focus_by_session(e, W))
    rows = profile.window_events(e, focus, W).select(
        "trace_id", "url", F.lit(None).cast("string").alias("source_hash"), "function",
        F.lit(None).cast("bigint").alias("function_start_position"), F.col("column").alias("source_position"),
        "api", "family", "weight", "seq", "file_index", "mono_time_us", "focus_time_us", F.contains("props", F.lit("7")).alias("marked"),
    )
    return provenance.site_candidates(rows, proximity_us=3_600_000_000).select(
        "url", "function", "source_position", "role", "score", "event_count", "marker_count",
        "proximity_hits", "first_seq", "last_seq",
    )
