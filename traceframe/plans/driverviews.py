"""Event-shaped projections of the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.functions import lookup

# The family catalogue of the views: the APIs that occur in them.
FAMILY_ROWS = [
    ("Function.prototype.call", "dynamic_dispatch"), ("DataView.getUint8", "byte_buffer"),
    ("Bitwise.xor", "int_bitwise"), ("Date.now", "anti_debug_timing"),
]
FOCUS_WINDOW_US = 21_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Rows of a task whose work is heavy per row.
SPREAD_ROWS = 50_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of a plain scan over all cores, for work that is heavy per row.

    A small single-file table arrives as one partition, and a large one as few partitions of very many rows. With
    ``rows``, the number of rows, a task gets at most about ``SPREAD_ROWS`` of them. A scan that already has
    enough partitions is left alone, so nothing is shuffled.
    """
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // SPREAD_ROWS))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch, whatever the session zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")
    return F.unix_micros(F.col(name))


def family_catalogue(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(api).alias("api"), F.lit(family).alias("family")) for api, family in FAMILY_ROWS])
    return spark.range(1).select(F.inline(rows))


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    api = (
        F.when(kind == "click", "Function.prototype.call")
        .when(kind == "view", "DataView.getUint8")
        .when(kind == "signup", "Bitwise.xor")
        .when(kind == "error", "Date.now")
        .otherwise("BrowserNetwork.request")
    )
    family = (
        F.when(kind == "click", "dynamic_dispatch")
        .when(kind == "view", "byte_buffer")
        .when(kind == "signup", "int_bitwise")
        .when(kind == "error", "anti_debug_timing")
    )
    category = (
        F.when(kind == "purchase", "network").when(kind == "error", "fingerprint").otherwise("reverse")
    )
    return raw.select(
        F.lit("events").alias("trace_id"),
        F.col("event_id").alias("file_index"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")).alias("session_id"),
        micros(raw, "ts").alias("mono_time_us"),
        api.alias("api"),
        category.alias("category"),
        family.alias("family"),
        lookup.family_weight(family).alias("weight"),
        F.lit("call").alias("phase"),
        F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string")).alias("url"),
        F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")).alias("function"),
        F.lit(1).cast("bigint").alias("line"),
        (F.col("user_id") % 5).alias("column"),
        F.get_json_object("props", "$.k").cast("bigint").alias("right"),
        F.col("value"),
        F.col("props"),
        F.col("user_id"),
    )


V_EVENTS = """
v_events AS (
  SELECT 'events' AS trace_id, event_id AS file_index, event_id AS seq,
    's' || CAST(user_id % 10 AS VARCHAR) AS session_id,
    epoch_us(ts) AS mono_time_us,
    CASE event_type WHEN 'click' THEN 'Function.prototype.call'
      WHEN 'view' THEN 'DataView.getUint8' WHEN 'signup' THEN 'Bitwise.xor'
      WHEN 'error' THEN 'Date.now' ELSE 'BrowserNetwork.request' END AS api,
    CASE event_type WHEN 'purchase' THEN 'network' WHEN 'error' THEN 'fingerprint'
      ELSE 'reverse' END AS category,
    CASE event_type WHEN 'click' THEN 'dynamic_dispatch' WHEN 'view' THEN 'byte_buffer'
      WHEN 'signup' THEN 'int_bitwise' WHEN 'error' THEN 'anti_debug_timing' END AS family,
    CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 3 WHEN 'signup' THEN 3
      WHEN 'error' THEN 2 ELSE 0 END AS weight,
    'app' || CAST(user_id % 3 AS VARCHAR) AS url,
    'f' || CAST(user_id % 7 AS VARCHAR) AS fn,
    user_id % 5 AS col, CAST(json_extract_string(props, '$.k') AS BIGINT) AS rgt,
    value, props, user_id
  FROM events)"""


def v_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTTP request per page; ``sig`` is a computed parameter."""
    p = table(spark, sf_dir, "pages")
    sig = F.substring(F.sha2("html", 256), 1, 32)
    bare = F.substring_index(F.col("url"), "#", 1)
    glue = F.when(F.instr(bare, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return p.select(
        F.lit("pages").alias("trace_id"),
        F.col("page_id").alias("file_index"),
        F.lit("network").alias("category"),
        F.lit("BrowserNetwork.request").alias("api"),
        F.concat(F.lit("s"), (F.col("page_id") % 10).cast("string")).alias("session_id"),
        (F.col("page_id") * 1_000_000).alias("mono_time_us"),
        F.concat(bare, glue, F.lit("sig="), sig).alias("url"),
        F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.col("page_id").cast("string").alias("network_correlation_key"),
    )


V_REQUESTS = """
v_requests AS (
  SELECT 'pages' AS trace_id, page_id AS file_index, 'network' AS category,
    'BrowserNetwork.request' AS api,
    's' || CAST(page_id % 10 AS VARCHAR) AS session_id,
    page_id * 1000000 AS mono_time_us,
    split_part(url, '#', 1)
      || CASE WHEN instr(split_part(url, '#', 1), '?') > 0 THEN '&' ELSE '?' END
      || 'sig=' || substr(sha256(html), 1, 32) AS url,
    CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
    CAST(page_id AS VARCHAR) AS network_correlation_key
  FROM pages)"""


def v_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    good = F.concat(F.lit("sha1:"), F.upper(F.sha1(F.encode("text", "UTF-8"))))
    return d.select(
        F.col("doc_id"),
        F.concat(F.lit("asset-"), F.col("doc_id").cast("string")).alias("asset_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("source"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("sha1:0")).otherwise(good).alias("source_hash"),
    )


V_ASSETS = """
v_assets AS (
  SELECT doc_id, 'asset-' || CAST(doc_id AS VARCHAR) AS asset_id,
    'https://' || source || '/' || CAST(doc_id AS VARCHAR) AS url, text AS source,
    CASE WHEN doc_id % 10 = 0 THEN 'sha1:0' ELSE 'sha1:' || upper(sha1(text)) END AS source_hash
  FROM documents)"""
