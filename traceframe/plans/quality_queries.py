"""Quality rules over records built from the driver's events, with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions.lookup import with_family
from traceframe.operators import shape
from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import V_EVENTS, family_catalogue, spread, table, v_events
from traceframe.plans.graph_queries import v_calls
from traceframe.quality import report, requests, rules
from traceframe.session import stored
from traceframe.sources.ndjson import parse_lines, typed_events


def _json(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def event_lines(spark, d):
    """Each event as an NDJSON line. Planted by event id: no origin (50), a phase out of
    the list (41), text in place of a boolean (37), a boolean sequence (43), truncation
    without metadata (47) or with part of it (53), a falling global sequence (1000), an
    empty frame URL (61), previews (7), redacted values (11), opaque references (3)."""
    e = v_events(spark, d)
    i = F.col("file_index")
    every = lambda n: i % n == 0
    origin = F.when(every(50), "").otherwise('"origin":"o",')
    phase = F.when(every(41), "bogus").otherwise("call")
    cut = (
        F.when(every(37), '"yes"').when(every(47), "true")
        .when(every(53), 'true,"truncation":{"original_size":9,"preview":"p"}').otherwise("false")
    )
    session_seq = F.when(every(43), "true").otherwise(i.cast("string"))
    global_seq = F.when(every(1000), i - 5).otherwise(i + 10)
    frame = F.when(every(61), "").otherwise("https://x/")
    stack = F.when(F.col("api") == "Date.now", "[]").otherwise(
        _json('[{"function":"', F.col("function"), '","url":"', F.col("url"), '","line":1,"column":', F.col("column"), "}]")
    )
    extra = F.concat(
        F.when(every(7), ',"input_preview":"abc"').otherwise(""),
        F.when(every(11), ',"note":"<redacted>"').otherwise(""),
        F.when(every(3), F.concat(F.lit(',"result_ref":"string_ref:'), i.cast("string"), F.lit('"'))).otherwise(""),
        F.when(every(6), ',"result":"seen"').otherwise(""),
        F.when(every(13), ',"left_ref":"string:length:4"').otherwise(""),
    )
    args = _json('[{"right":', F.col("right"), ',"url":"https://h/p?sig=', F.col("right"), '","type":"t"', extra, "}]")
    line = _json(
        '{"schema_version":1,"event_id":"e', i, '","session_id":"', F.col("session_id"), '","seq":', i,
        ',"session_seq":', session_seq, ',"global_seq":', global_seq, ',"t":"call","wall_time_us":', F.col("mono_time_us"),
        ',"mono_time_us":', F.col("mono_time_us"), ',"category":"', F.col("category"), '","phase":"', phase,
        '","api":"', F.col("api"), '","args":', args, ',"stack":', stack, ',"pid":1,"tid":2,"frame_url":"', frame, '",', origin,
        '"result":null,"error":null,"truncated":', cut, "}",
    )
    return _as_lines(e, line)


def _as_lines(df, line):
    """Rows as read from a text file. The generator keeps the planner from writing the
    long line expression again into every use of a parsed column. Rows are spread before their lines
    are made, by their number: that is read from the footers of the files."""
    return spread(df, df.count()).select(
        "trace_id", "file_index", F.lit(0).cast("bigint").alias("block_start"), F.explode(F.array(line)).alias("line")
    )


def events_typed(spark, d):
    return with_family(typed_events(parse_lines(event_lines(spark, d), repair=False)), family_catalogue(spark))


@query(
    "value_shape",
    f"""WITH {V_EVENTS}, e AS (SELECT file_index AS i, CAST(rgt AS VARCHAR) AS r FROM v_events),
s AS (SELECT i, 1 AS n, 'args.0.url' AS f, length('https://h/p?sig=' || r) AS l FROM e UNION ALL SELECT i, 2, 'args.0.type', 1 FROM e
  UNION ALL SELECT i, 3, 'args.0.input_preview', 3 FROM e WHERE i % 7 = 0 UNION ALL SELECT i, 4, 'args.0.note', 10 FROM e WHERE i % 11 = 0
  UNION ALL SELECT i, 5, 'args.0.result_ref', length('string_ref:' || i) FROM e WHERE i % 3 = 0 UNION ALL SELECT i, 6, 'args.0.result', 4 FROM e WHERE i % 6 = 0
  UNION ALL SELECT i, 7, 'args.0.left_ref', 15 FROM e WHERE i % 13 = 0)
SELECT i AS file_index, count(*) AS string_field_count, string_agg(f, ' ' ORDER BY n) AS string_fields, string_agg(CAST(l AS VARCHAR), ' ' ORDER BY n) AS string_lengths,
  concat_ws(' ', CASE WHEN i % 13 = 0 THEN 'left_ref' END, CASE WHEN i % 3 = 0 THEN 'result_ref' END) AS material_ref_fields, 'h/p?sig' AS signed_url
FROM s GROUP BY i""",
)
def value_shape(spark, d):
    out = shape.event_value_shape(events_typed(spark, d), ["file_index"], ["sig"])
    first = F.col("signed_urls")[0]
    return out.select(
        "file_index", "string_field_count", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("string_fields", "string_lengths", "material_ref_fields")],
        F.concat(first["host"], first["path"], F.lit("?"), first["primary_target"]).alias("signed_url"),
    )


def _plain(df):
    return df.select("rule", F.coalesce("file_index", F.lit(-1)).alias("file_index"), "path")


@query(
    "dq_record_v1",
    """SELECT 'missing_fields' AS rule, event_id AS file_index, 'origin' AS path FROM events WHERE event_id % 50 = 0
UNION ALL SELECT 'phase', event_id, 'phase' FROM events WHERE event_id % 41 = 0
UNION ALL SELECT 'truncated_type', event_id, 'truncated' FROM events WHERE event_id % 37 = 0
UNION ALL SELECT 'integer_field', event_id, 'session_seq' FROM events WHERE event_id % 43 = 0
UNION ALL SELECT 'truncation_missing', event_id, 'truncation' FROM events WHERE event_id % 47 = 0 AND event_id % 37 <> 0
UNION ALL SELECT 'truncation_fields', event_id, 'hash' FROM events
  WHERE event_id % 53 = 0 AND event_id % 47 <> 0 AND event_id % 37 <> 0""",
)
def dq_record_v1(spark, d):
    return _plain(rules.record_v1(events_typed(spark, d)))


@query(
    "dq_global_seq",
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 1000 = 0 THEN event_id - 5 ELSE event_id + 10 END AS g FROM events),
p AS (SELECT *, coalesce(lag(g) OVER (ORDER BY event_id), 0) AS prev FROM s)
SELECT 'not_rising' AS rule, event_id AS file_index, CAST(g AS VARCHAR) || ' <= ' || CAST(prev AS VARCHAR) AS message FROM p WHERE g <= prev""",
)
def dq_global_seq(spark, d):
    return rules.global_sequence(events_typed(spark, d)).select("rule", "file_index", "message")


@query(
    "dq_context",
    f"""WITH {V_EVENTS}
SELECT 'context_missing' AS rule, file_index, api AS path FROM v_events
WHERE api IN ('Bitwise.xor', 'Date.now') AND (file_index % 61 = 0 OR file_index % 50 = 0)
UNION ALL SELECT 'api_not_observed', CAST(-1 AS BIGINT), 'fetch'""",
)
def dq_context(spark, d):
    return _plain(rules.context(events_typed(spark, d), ("Bitwise.xor", "Date.now", "fetch")))


@query(
    "dq_stack",
    """SELECT 'no_stack' AS rule, CAST(-1 AS BIGINT) AS file_index, 'Date.now' AS path FROM events HAVING count(*) > 0""",
)
def dq_stack(spark, d):
    return _plain(rules.stack_presence(events_typed(spark, d), ("Date.now", "Bitwise.xor", "fetch")))


@query(
    "dq_family",
    """SELECT 'family_not_observed' AS rule, CAST(-1 AS BIGINT) AS file_index, 'base64' AS path FROM events HAVING count(*) > 0""",
)
def dq_family(spark, d):
    e = events_typed(spark, d)
    return _plain(rules.families(e, rules.event_leaves(e), ("base64", "int_bitwise", "dynamic_dispatch"), evidence=True))


@query(
    "dq_arg_fields",
    f"""WITH {V_EVENTS}, s(api, field, mode) AS (VALUES ('Bitwise.xor', 'result_ref', 'material'), ('Bitwise.xor', 'shift', 'material'),
  ('fetch', 'url', 'material'), ('fetch', 'url', 'observed'), ('Date.now', 'radix', 'observed'), ('Date.now', 'right', 'observed')),
have AS (SELECT DISTINCT api, unnest(['right', 'url', 'type', CASE WHEN file_index % 3 = 0 THEN 'result_ref' END]) AS field FROM v_events)
SELECT 'field_' || s.mode AS rule, CAST(-1 AS BIGINT) AS file_index, s.api || ':' || s.field AS path FROM s
LEFT JOIN have h ON h.api = s.api AND h.field = s.field
WHERE h.api IS NULL AND (s.mode = 'material' OR s.api IN (SELECT api FROM v_events))""",
)
def dq_arg_fields(spark, d):
    e = events_typed(spark, d)
    specs = spark.createDataFrame(
        [("Bitwise.xor", "result_ref", "material"), ("Bitwise.xor", "shift", "material"), ("fetch", "url", "material"),
         ("fetch", "url", "observed"), ("Date.now", "radix", "observed"), ("Date.now", "right", "observed")],
        "api STRING, field STRING, mode STRING",
    )
    return _plain(rules.arg_fields(e, rules.event_leaves(e), specs))


@query(
    "dq_complete",
    """SELECT 'preview_field' AS rule, event_id AS file_index, 'args[0].input_preview' AS path FROM events WHERE event_id % 7 = 0
UNION ALL SELECT 'redacted', event_id, 'args[0].note' FROM events WHERE event_id % 11 = 0
UNION ALL SELECT 'preview_field', event_id, 'truncation.preview' FROM events WHERE event_id % 53 = 0 AND event_id % 47 <> 0 AND event_id % 37 <> 0
UNION ALL SELECT 'truncated', event_id, CASE event_type WHEN 'click' THEN 'Function.prototype.call'
      WHEN 'view' THEN 'DataView.getUint8' WHEN 'signup' THEN 'Bitwise.xor'
      WHEN 'error' THEN 'Date.now' ELSE 'BrowserNetwork.request' END FROM events
  WHERE event_id % 37 <> 0 AND (event_id % 47 = 0 OR event_id % 53 = 0)""",
)
def dq_complete(spark, d):
    e = events_typed(spark, d)
    return _plain(rules.complete_values(e, rules.event_leaves(e)))


@query(
    "dq_refs",
    """SELECT 'summary_ref' AS rule, event_id AS file_index, 'args[0].left_ref' AS path FROM events WHERE event_id % 13 = 0
UNION ALL SELECT 'opaque_ref', event_id, 'args[0].result_ref' FROM events WHERE event_id % 3 = 0 AND event_id % 6 <> 0""",
)
def dq_refs(spark, d):
    # The rule reads the leaves several times.
    return _plain(rules.material_refs(stored(rules.event_leaves(events_typed(spark, d)), "leaves")))


@query(
    "dq_param",
    """SELECT 'no_request_carrier' AS rule, CAST(-1 AS BIGINT) AS file_index, 'nonce' AS path FROM events HAVING count(*) > 0
UNION ALL SELECT 'no_materialisation', CAST(-1 AS BIGINT), p FROM (SELECT unnest(['sig', 'nonce']) AS p) WHERE (SELECT count(*) FROM events) > 0""",
)
def dq_param(spark, d):
    e = events_typed(spark, d)
    return _plain(requests.parameter_materialisation(e, rules.event_leaves(e), ["sig", "nonce"]))


@query(
    "dq_branch",
    """SELECT 'form_field' AS rule, o_orderkey AS file_index, 'FormData.append:blob_uuid_ref' AS path FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0
UNION ALL SELECT 'form_field', o_orderkey, 'FormData.append:value_length' FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 5 = 0""",
)
def dq_branch(spark, d):
    """Form entries built from orders: strings and blobs, some with a field left out."""
    o = table(spark, d, "orders")
    i = F.col("o_orderkey")
    blob = F.col("o_orderstatus") == "F"
    body = F.when(
        blob, _json('"value_kind":"blob","filename":"f","filename_length":1,"filename_ref":"r","blob_type":"t","blob_type_length":1,"blob_type_ref":"r","blob_size":', i, ',"blob_uuid":"u"', F.when(i % 4 == 0, "").otherwise(',"blob_uuid_ref":"r"'))
    ).otherwise(_json('"value_kind":"string","value":"v","value_ref":"r"', F.when(i % 5 == 0, "").otherwise(',"value_length":1')))
    line = _json('{"api":"FormData.append","args":[{', body, "}]}")
    lines = _as_lines(o.withColumn("trace_id", F.lit("orders")).withColumn("file_index", i), line)
    e = typed_events(parse_lines(lines, repair=False))
    return _plain(rules.form_branches(e, rules.event_leaves(e)))


@query("dq_request")
def dq_request(spark, d):
    """Evidence the event trace lacks for a request contract."""
    contract = requests.RequestContract("/p", ("sig",), ("cursor",), ("x-token",), ("content-type",))
    return _plain(requests.request_conformance(events_typed(spark, d), contract))


@query(
    "dq_report",
    """WITH e AS (SELECT event_id AS i, event_id % 37 = 0 AS odd, event_id % 47 = 0 AS cut, event_id % 53 = 0 AS part FROM events),
v AS (SELECT 10 AS stage, 'missing_fields' AS rule FROM e WHERE i % 50 = 0
  UNION ALL SELECT 10, 'phase' FROM e WHERE i % 41 = 0 UNION ALL SELECT 10, 'integer_field' FROM e WHERE i % 43 = 0
  UNION ALL SELECT 10, 'truncated_type' FROM e WHERE odd UNION ALL SELECT 10, 'truncation_missing' FROM e WHERE cut AND NOT odd
  UNION ALL SELECT 10, 'truncation_fields' FROM e WHERE part AND NOT cut AND NOT odd UNION ALL SELECT 20, 'not_rising' FROM e WHERE i % 1000 = 0
  UNION ALL SELECT 50, 'truncated' FROM e WHERE (cut OR part) AND NOT odd
  UNION ALL SELECT 50, 'preview_field' FROM e WHERE i % 7 = 0 UNION ALL SELECT 50, 'preview_field' FROM e WHERE part AND NOT cut AND NOT odd
  UNION ALL SELECT 50, 'redacted' FROM e WHERE i % 11 = 0 UNION ALL SELECT 60, 'summary_ref' FROM e WHERE i % 13 = 0
  UNION ALL SELECT 60, 'opaque_ref' FROM e WHERE i % 3 = 0 AND i % 6 <> 0
  UNION ALL SELECT 70, 'api_not_observed' FROM (SELECT count(*) AS n FROM e) WHERE n > 0)
SELECT stage, rule, count(*) AS violations FROM v GROUP BY stage, rule""",
)
def dq_report(spark, d):
    """Verdict of the strict preset, with the violations counted by rule."""
    # The columns that the preset's rules read are stored once.
    e = stored(events_typed(spark, d).select(
        "trace_id", "file_index", "schema_version", "session_seq", "global_seq", "phase", "api", "truncated", "truncation", "keys", "raw",
        "family", "weight",
    ), "events")
    preset = report.strict(report.RuleSet(expected=("Bitwise.xor", "fetch")), generic=True)
    return report.check(e, preset).groupBy("stage", "rule").agg(F.count(F.lit(1)).alias("violations"))


def _call_lines(spark, d):
    """The call view as schema-2 lines; id 7 in every 1000 orders and lines is planted."""
    c = v_calls(spark, d)
    i = F.col("file_index")
    text = lambda col: F.coalesce(F.concat(F.lit('"'), col, F.lit('"')), F.lit("null"))
    parent = F.when((F.col("api") == "line") & (i % 1000 == 7), F.lit("s:1x")).otherwise(F.col("parent_id"))
    depth = F.when((F.col("api") == "order") & (i % 1000 == 7), F.lit(5).cast("bigint")).otherwise(F.col("depth"))
    end = F.col("phase").isin("return", "exception")
    line = _json(
        '{"schema_version":2,"event_id":"e', i, '","session_id":"s","seq":', i, ',"t":"call","wall_time_us":', i,
        ',"mono_time_us":', i, ',"category":"reverse","phase":"', F.col("phase"), '","api":"', F.col("api"),
        '","args":[],"stack":[],"pid":1,"tid":2,"frame_url":"f","origin":"o","result":null,"error":null,"truncated":false,"call_id":',
        text(F.col("call_id")), ',"parent_id":', text(parent), ',"depth":', depth, ',"causality_kind":"',
        F.col("causality_kind"), '","duration_us":', F.when(end, F.lit("5")).otherwise("null"), "}",
    )
    return _as_lines(c, line)


@query(
    "dq_record_v2",
    """SELECT 'depth' AS rule, event_id AS file_index, 'depth' AS path FROM events WHERE event_id % 17 = 0
UNION ALL SELECT 'call_id_format', event_id, 'call_id' FROM events WHERE event_id % 19 = 0
UNION ALL SELECT 'singleton_duration', event_id, 'duration_us' FROM events WHERE event_id % 23 = 0 AND event_id % 31 <> 0
UNION ALL SELECT 'missing_fields', event_id, 'parent_id' FROM events WHERE event_id % 29 = 0
UNION ALL SELECT 'causality_kind', event_id, 'causality_kind' FROM events WHERE event_id % 31 = 0""",
)
def dq_record_v2(spark, d):
    e = v_events(spark, d)
    i = F.col("file_index")
    line = _json(
        '{"schema_version":2,"event_id":"e', i, '","session_id":"s","seq":1,"t":"call","wall_time_us":1,"mono_time_us":1,"category":"reverse",'
        '"phase":"get","api":"x","args":[],"stack":[],"pid":1,"tid":2,"frame_url":"f","origin":"o","result":null,"error":null,"truncated":false,"call_id":"',
        F.when(i % 19 == 0, "other:").otherwise("s:"), i, '"', F.when(i % 29 == 0, "").otherwise(',"parent_id":null'),
        ',"depth":', F.when(i % 17 == 0, "-1").otherwise("0"), ',"causality_kind":"', F.when(i % 31 == 0, "loop").otherwise("singleton"),
        '","duration_us":', F.when((i % 23 == 0) & (i % 31 != 0), "4").otherwise("null"), "}",
    )
    lines = _as_lines(e, line)
    return _plain(rules.record_v2(typed_events(parse_lines(lines, repair=False))))


@query(
    "dq_causality",
    """WITH li AS (SELECT 100000000 + l_orderkey * 10 + l_linenumber AS fi, 's:' || CAST(100000000 + l_orderkey * 10 + l_linenumber AS VARCHAR) AS cid,
    l_orderkey FROM lineitem)
SELECT 'missing_parent' AS rule, fi AS file_index, 's:1x' AS path FROM li WHERE fi % 1000 = 7
UNION ALL SELECT 'depth_step', 10000000 + o_orderkey, 's:' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 1000 = 7
UNION ALL SELECT 'depth_step', fi, 's:' || CAST(10000000 + l_orderkey AS VARCHAR) FROM li WHERE l_orderkey % 1000 = 7 AND fi % 1000 <> 7
UNION ALL SELECT 'unclosed_call', 10000000 + o_orderkey, 's:' || CAST(10000000 + o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'""",
)
def dq_causality(spark, d):
    # The rule reads its input several times, so the parsed columns are stored once.
    e = typed_events(parse_lines(_call_lines(spark, d), repair=False)).select(
        "trace_id", "file_index", "schema_version", "session_id", "phase", "api", "call_id", "parent_id", "depth",
        "causality_kind", "duration_us",
    )
    return _plain(rules.causality(stored(e, "calls")))
