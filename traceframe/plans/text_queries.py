"""Queries over text, URL and source functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions import text
from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import (
    V_ASSETS, V_EVENTS, V_REQUESTS, spread, table, v_assets, v_events, v_requests,
)

TOKEN_SQL = "[A-Za-z0-9_\\-+/=.]{16,}"
TELEMETRY_SQL = text.TELEMETRY


@query(
    "url_extract",
    r"""WITH t AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'see ' || url || ' or "' || url || 'z"' END AS v FROM pages)
SELECT page_id, u AS url, count(*) AS n FROM (
  SELECT page_id, unnest(CASE WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN [v]
    ELSE regexp_extract_all(v, 'https?://[^\s"''<>\\]+') END) AS u FROM t) GROUP BY page_id, u""",
)
def url_extract(spark, d):
    p = table(spark, d, "pages")
    v = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.concat(F.lit("see "), "url", F.lit(' or "'), "url", F.lit('z"'))
    )
    urls = p.select("page_id", F.explode(text.extract_urls(v)).alias("url"))
    return urls.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))


@query(
    "query_params",
    """WITH p AS (
  SELECT page_id, unnest(string_split(split_part(split_part(url, '#', 1), '?', 2), '&')) AS kv FROM pages)
SELECT page_id, url_decode(split_part(kv, '=', 1)) AS name,
  url_decode(CASE WHEN instr(kv, '=') > 0 THEN substr(kv, instr(kv, '=') + 1) ELSE '' END) AS value
FROM p WHERE kv <> ''""",
)
def query_params(spark, d):
    p = table(spark, d, "pages")
    pairs = p.select("page_id", F.explode(text.query_params(F.col("url"), True)).alias("kv"))
    return pairs.select("page_id", F.col("kv.name").alias("name"), F.col("kv.value").alias("value"))


@query(
    "entropy",
    """WITH chars AS (
  SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''),
counts AS (SELECT doc_id, c, count(*) AS n FROM chars WHERE c <> '' GROUP BY doc_id, c),
totals AS (SELECT doc_id, sum(n) AS total FROM counts GROUP BY doc_id)
SELECT d.doc_id, coalesce(round(e.entropy, 6), 0.0) AS entropy FROM documents d LEFT JOIN (
  SELECT c.doc_id, -sum(n / total * log2(n / total)) AS entropy
  FROM counts c JOIN totals t ON c.doc_id = t.doc_id GROUP BY c.doc_id) e ON d.doc_id = e.doc_id""",
)
def entropy(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.round(text.text_entropy("text"), 6).alias("entropy"))


@query(
    "token_scan",
    f"""SELECT doc_id, token, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS token FROM documents)
GROUP BY doc_id, token""",
)
def token_scan(spark, d):
    docs = table(spark, d, "documents")
    tokens = docs.select("doc_id", F.explode(text.token_scan(F.col("text"))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ref_literal",
    f"""WITH {V_EVENTS}, r AS (
  SELECT file_index, CASE file_index % 4 WHEN 0 THEN 'number:' || CAST(rgt AS VARCHAR) || '.0'
    WHEN 1 THEN 'handler_arg:' || CAST(rgt AS VARCHAR) || '/number:' || CAST(value AS VARCHAR)
    WHEN 2 THEN 'string_ref:' || api ELSE session_id END AS ref FROM v_events),
l AS (SELECT *, split_part(ref, '/', -1) AS tail FROM r),
x AS (SELECT *, CASE WHEN instr(tail, ':') > 0 THEN substr(tail, instr(tail, ':') + 1) ELSE tail END AS txt FROM l)
SELECT file_index, txt AS "text", TRY_CAST(txt AS DOUBLE) AS number FROM x""",
)
def ref_literal(spark, d):
    e = v_events(spark, d)
    k = F.col("right").cast("string")
    kind = F.col("file_index") % 4
    ref = (
        F.when(kind == 0, F.concat(F.lit("number:"), k, F.lit(".0")))
        .when(kind == 1, F.concat(F.lit("handler_arg:"), k, F.lit("/number:"), F.col("value").cast("string")))
        .when(kind == 2, F.concat(F.lit("string_ref:"), "api"))
        .otherwise(F.col("session_id"))
    )
    lit = text.ref_literal(ref)
    return e.select("file_index", lit["text"].alias("text"), lit["number"].alias("number"))


@query(
    "value_fingerprint",
    "SELECT doc_id, substr(sha256(text), 1, 8) AS value_sha FROM documents",
)
def value_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sha8(F.col("text")).alias("value_sha"))


@query(
    "token_fields",
    """SELECT doc_id, i - 1 AS i, 'f' || CAST(i - 1 AS VARCHAR) AS name, parts[i] AS value, length(parts[i]) AS len
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, '.') AS parts FROM documents WHERE contains(text, '.')))""",
)
def token_fields(spark, d):
    docs = table(spark, d, "documents")
    f = docs.select("doc_id", F.explode(text.token_fields(F.col("text"), ".")).alias("f"))
    return f.select(
        "doc_id", F.col("f.i").cast("bigint").alias("i"), F.col("f.name").alias("name"),
        F.col("f.value").alias("value"), F.col("f.len").cast("bigint").alias("len"),
    )


LINE_SQL = "length(p) - length(replace(p, chr(10), ''))"


@query(
    "line_column",
    f"""WITH t AS (SELECT doc_id, text, least(length(text), 100 + doc_id % 300) AS idx FROM documents),
x AS (SELECT *, substr(text, 1, idx) AS p FROM t)
SELECT doc_id, {LINE_SQL} + 1 AS line, length(split_part(p, chr(10), -1)) AS "column", idx AS back FROM x""",
)
def line_column(spark, d):
    docs = table(spark, d, "documents")
    lc = text.line_column(F.col("text"), F.lit(100) + F.col("doc_id") % 300)
    out = docs.select("doc_id", "text", lc["line"].alias("line"), lc["column"].alias("column"))
    back = text.line_column_index(F.col("text"), F.col("line"), F.col("column"))
    return out.select("doc_id", "line", "column", back.alias("back"))


@query(
    "snippets",
    """WITH t AS (SELECT doc_id, text, least(length(text), 100 + doc_id % 900) AS idx FROM documents),
b AS (SELECT *, greatest(0, idx - 240) AS s, least(length(text), idx + 520) AS e FROM t)
SELECT doc_id, s AS snippet_start, e AS snippet_end, substr(text, s + 1, e - s) AS snippet FROM b""",
)
def snippets(spark, d):
    docs = table(spark, d, "documents")
    s = text.snippet(F.col("text"), F.lit(100) + F.col("doc_id") % 900)
    return docs.select("doc_id", s.alias("s")).select("doc_id", "s.*")


@query(
    "url_role",
    """SELECT page_id, CASE WHEN regexp_matches(lower(url), 'signature|security|risk|fingerprint|sensor|challenge|captcha|waf|sdk|vmp|vm')
  THEN 'security_runtime_candidate'
  WHEN regexp_matches(lower(url), '/sw/|workbox|cdn-sw') THEN 'request_transport_candidate'
  ELSE 'supporting_runtime_candidate' END AS role FROM pages""",
)
def url_role(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_role(F.col("url")).alias("role"))


CANONICAL_SQL = """regexp_extract(url, '^([A-Za-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) ||
  CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/'
  ELSE regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/$', '') END"""


@query("canonical_endpoint", f"SELECT page_id, {CANONICAL_SQL} AS endpoint FROM pages")
def canonical_endpoint(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_endpoint(F.col("url")).alias("endpoint"))


RESOURCE_SQL = f"""CASE
  WHEN regexp_matches(lower(path), '\\.(js|mjs|css|png|jpg|jpeg|gif|webp|svg|ico|woff|woff2|ttf|otf|mp4|webm)$') THEN 'static_resource'
  WHEN regexp_matches(hay, '(/web/resource|/resource$)') THEN 'static_resource'
  WHEN regexp_matches(hay, '{TELEMETRY_SQL}') THEN 'telemetry_endpoint'
  WHEN path = '/' THEN 'document_request' ELSE '' END"""
REQUEST_PARTS_SQL = f"""parts AS (
  SELECT *, CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS path,
    lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '(\\?[^#]*)', 1) AS search FROM v_requests),
classed AS (SELECT *, {RESOURCE_SQL} AS resource_class, {CANONICAL_SQL} AS endpoint
  FROM (SELECT *, lower(host || ' ' || path || ' ' || search) AS hay FROM parts))"""


@query(
    "resource_class",
    f"WITH {V_REQUESTS}, {REQUEST_PARTS_SQL} SELECT file_index, resource_class FROM classed",
)
def resource_class(spark, d):
    r = v_requests(spark, d)
    none = F.lit(None).cast("string")
    return r.select(
        "file_index", text.resource_class(F.col("url"), F.col("api"), none, none).alias("resource_class")
    )


@query(
    "hamming",
    """WITH h AS (SELECT conv_id, turn, substr(sha256(text), 1, 16) AS a,
  substr(sha256(text), 17, 16) AS b FROM conversations)
SELECT conv_id, turn, CAST(hamming(a, b) AS BIGINT) AS distance FROM h""",
)
def hamming(spark, d):
    c = table(spark, d, "conversations")
    h = F.sha2("text", 256)
    return c.select(
        "conv_id", "turn", text.hamming(F.substring(h, 1, 16), F.substring(h, 17, 16)).alias("distance")
    )


@query(
    "event_filter",
    f"""WITH {V_EVENTS}
SELECT file_index, category, api FROM v_events
WHERE contains(lower(category), 'print') OR contains(lower(api), 'print')
ORDER BY file_index DESC LIMIT 400""",
)
def event_filter(spark, d):
    hits = v_events(spark, d).where(text.event_filter("print"))
    return hits.orderBy(F.desc("file_index")).limit(400).select("file_index", "category", "api")


VALUE_SQL = """SELECT *, CASE file_index % 5 WHEN 0 THEN 'url_preview' WHEN 1 THEN 'result_ref'
    WHEN 2 THEN 'value' WHEN 3 THEN 'input_refs' ELSE 'body_redacted' END AS k,
  CASE file_index % 7 WHEN 0 THEN 'string:length:' || CAST(rgt AS VARCHAR) WHEN 1 THEN 'string_ref:' || api
    WHEN 2 THEN '<Redacted>' ELSE session_id END AS v FROM v_events"""


@query(
    "value_class",
    f"""WITH {V_EVENTS}, kv AS ({VALUE_SQL})
SELECT file_index, CASE WHEN k = 'url_preview' THEN 'preview'
  WHEN k = 'body_redacted' OR contains(lower(v), 'redacted') THEN 'redacted'
  WHEN k IN ('result_ref', 'input_refs') AND starts_with(v, 'string:length:') THEN 'summary_ref'
  WHEN k IN ('result_ref', 'input_refs') AND starts_with(v, 'string_ref:') THEN 'opaque_ref'
  WHEN k IN ('result_ref', 'input_refs') THEN 'stable_ref' ELSE 'raw' END AS value_class FROM kv""",
)
def value_class(spark, d):
    e = v_events(spark, d)
    m5, m7 = F.col("file_index") % 5, F.col("file_index") % 7
    k = (
        F.when(m5 == 0, "url_preview").when(m5 == 1, "result_ref").when(m5 == 2, "value")
        .when(m5 == 3, "input_refs").otherwise("body_redacted")
    )
    v = (
        F.when(m7 == 0, F.concat(F.lit("string:length:"), F.col("right").cast("string")))
        .when(m7 == 1, F.concat(F.lit("string_ref:"), "api"))
        .when(m7 == 2, F.lit("<Redacted>")).otherwise(F.col("session_id"))
    )
    return e.select("file_index", text.value_class(k, v).alias("value_class"))


@query(
    "asset_hash_check",
    f"""WITH {V_ASSETS}
SELECT asset_id, source_hash, 'sha1:' || upper(sha1(source)) AS computed_hash,
  source_hash <> 'sha1:' || upper(sha1(source)) AS source_unverified FROM v_assets""",
)
def asset_hash_check(spark, d):
    from traceframe.sources.assets import with_hash_check

    return with_hash_check(v_assets(spark, d)).select(
        "asset_id", "source_hash", "computed_hash", "source_unverified"
    )
