"""Queries over streams: the tables written as lines of growing files, tailed and judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import V_REQUESTS, table, v_requests
from traceframe.plans.text_queries import REQUEST_PARTS_SQL
from traceframe.session import work_folder
from traceframe.streaming import live


def _written(lines, name):
    folder = work_folder(lines.sparkSession, name)
    lines.write.text(folder)
    return folder


@query(
    "tail_lines",
    """SELECT CASE WHEN turn % 5 = 4 THEN 'malformed' ELSE 'ok' END AS status, CASE WHEN turn % 5 <> 4 THEN conv_id END AS conv_id,
  CASE WHEN turn % 5 <> 4 THEN turn END AS turn FROM conversations""",
)
def tail_lines(spark, d):
    """Conversations as lines of files, each fifth turn cut short, read by the tail."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    whole = F.to_json(F.struct(*c.columns))
    line = F.when(F.col("turn") % 5 == 4, F.expr("substr(j, 1, length(j) - 1)")).otherwise(F.col("j"))
    folder = _written(c.withColumn("j", whole).select(line.alias("line")), "lines")
    get = lambda name: F.try_variant_get("event", f"$.{name}", "bigint").alias(name)
    rows = live.tail_ndjson(spark, folder).select("status", get("conv_id"), get("turn"))
    out = work_folder(spark, "tailed")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    writer.start(f"{out}/rows").awaitTermination()
    return spark.read.schema("status string, conv_id bigint, turn bigint").parquet(f"{out}/rows").select(
        "status", "conv_id", F.col("turn").cast(dict(c.dtypes)["turn"]).alias("turn")
    )


@query(
    "live_gate",
    f"""WITH {V_REQUESTS}, {REQUEST_PARTS_SQL}, t AS (SELECT *, 's' || CAST(file_index % 10 AS VARCHAR) AS s FROM classed),
a AS (SELECT s, endpoint, min(file_index) AS fi FROM t WHERE resource_class = '' GROUP BY s, endpoint),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY fi, endpoint) AS rn FROM a)
SELECT s AS trace_id, 'passed' AS status, CAST(count(*) AS BIGINT) AS observed_actionable_endpoint_count,
  string_agg(CASE WHEN rn <= 8 THEN endpoint END, ' ' ORDER BY rn) AS matched_endpoints FROM r GROUP BY s""",
)
def live_gate(spark, d):
    """The gate of every session, kept by the stream: its last row of each trace."""
    r = v_requests(spark, d)
    event = F.struct(
        F.col("file_index").alias("seq"), "category", "api", "session_id", F.array(F.struct("url")).alias("args"),
    )
    folder = _written(r.select(F.to_json(event).alias("line")), "requests")
    events = live.live_events(live.tail_ndjson(spark, folder, max_bytes=64 << 20))
    events = events.withColumns({"trace_id": F.col("session_id"), "file_index": F.col("seq")})
    out = work_folder(spark, "gates")

    def publish(gates, batch_id):
        # Written under its number, so a batch that is run again replaces its rows.
        gates.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/rows/batch-{batch_id}")

    live.start_gate(events, f"{out}/checkpoint", publish, poll=None).awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/rows")
    names = ["status", "observed_actionable_endpoint_count", "matched_endpoints"]
    last = rows.groupBy("trace_id").agg(F.max_by(F.struct(*names), "batch").alias("g")).select("trace_id", "g.*")
    return last.withColumn("matched_endpoints", F.array_join("matched_endpoints", " "))
