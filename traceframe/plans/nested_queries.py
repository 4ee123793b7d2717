"""Queries over nested values and merged sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions import nested
from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import V_EVENTS, spread, v_events
from traceframe.sources import merge


def _json_events(spark, d):
    """Each event as one nested object, with a list and an inner object."""
    e = spread(v_events(spark, d))
    obj = F.struct(
        F.col("api").alias("name"),
        F.array(
            F.struct(F.col("session_id").alias("sid"), F.col("right").alias("k")),
            F.struct(F.col("url").alias("sid"), F.col("file_index").alias("k")),
        ).alias("items"),
        F.struct(F.struct(F.col("function").alias("fn")).alias("source"), F.lit("call").alias("phase")).alias("inner"),
    )
    return e.select("file_index", F.to_json(obj).alias("j"))


LEAVES_SQL = """lv AS (
  SELECT file_index, 'name' AS path, 'name' AS jp, api AS text FROM v_events
  UNION ALL SELECT file_index, 'items.0.sid', 'items[0].sid', session_id FROM v_events
  UNION ALL SELECT file_index, 'items.1.sid', 'items[1].sid', url FROM v_events
  UNION ALL SELECT file_index, 'inner.source.fn', 'inner.source.fn', fn FROM v_events
  UNION ALL SELECT file_index, 'inner.phase', 'inner.phase', 'call' FROM v_events)"""


@query("string_leaves", f"WITH {V_EVENTS}, {LEAVES_SQL} SELECT file_index, path, text FROM lv")
def string_leaves(spark, d):
    out = nested.string_leaves(_json_events(spark, d), "j", ["file_index"])
    return out.select("file_index", nested.dot_path(F.col("path")).alias("path"), "text")


@query(
    "json_flatten",
    f"""WITH {V_EVENTS}, {LEAVES_SQL}
SELECT file_index, jp AS path, text FROM lv
UNION ALL SELECT file_index, 'items[0].k', CAST(rgt AS VARCHAR) FROM v_events
UNION ALL SELECT file_index, 'items[1].k', CAST(file_index AS VARCHAR) FROM v_events""",
)
def json_flatten(spark, d):
    out = nested.leaves(_json_events(spark, d), "j", ["file_index"])
    return out.select("file_index", "path", "text")


@query(
    "json_leaves",
    f"""WITH {V_EVENTS}, {LEAVES_SQL}
SELECT file_index, jp AS json_path, text AS leaf FROM lv WHERE length(text) >= 4""",
)
def json_leaves(spark, d):
    return nested.mined_leaves(_json_events(spark, d), "j", ["file_index"]).select(
        "file_index", "json_path", "leaf"
    )


@query(
    "marker_filter",
    f"""WITH {V_EVENTS}, {LEAVES_SQL}
SELECT DISTINCT file_index FROM lv WHERE path <> 'inner.source.fn'
  AND (contains(text, 'app1') OR contains(text, 'xor'))""",
)
def marker_filter(spark, d):
    return nested.marked_events(_json_events(spark, d), "j", ["file_index"], ["app1", "xor"])


CLOCK_SQL = """native AS (
  SELECT 'events' AS trace_id, event_id AS file_index, epoch_us(ts) AS wall,
    epoch_us(ts) - 1700000000000000 + event_id % 3 AS mono FROM events),
off AS (SELECT list_sort(list(CAST(mono - wall AS DOUBLE))) AS l FROM native),
o AS (SELECT l[len(l) // 2 + 1] AS offset_us FROM off),
inj AS (SELECT event_id, epoch_us(ts) AS wall, row_number() OVER (ORDER BY event_id) AS rn
  FROM events WHERE event_type = 'error')"""


def _clock(spark, d):
    e = v_events(spark, d)
    wall = F.col("mono_time_us").cast("double")
    native = e.select(
        "trace_id", "file_index", "seq", "session_id", "api", wall.alias("wall_time_us"),
        (wall - F.lit(1.7e15) + (F.col("file_index") % 3)).alias("mono_time_us"),
        (F.col("file_index") + 1).alias("global_seq"),
    )
    injected = e.where("api = 'Date.now'").select("trace_id", "file_index", "api", wall.alias("wall_time_us"))
    return native, injected


@query(
    "clock_align",
    f"""WITH {CLOCK_SQL}
SELECT event_id AS file_index, CAST(wall + offset_us AS DOUBLE) AS mono_time_us, offset_us FROM inj, o""",
)
def clock_align(spark, d):
    return merge.align_clock(*_clock(spark, d)).select("file_index", "mono_time_us", "offset_us")


@query(
    "merge_union",
    f"""WITH {CLOCK_SQL}, n AS (SELECT max(event_id) AS m FROM events)
SELECT 's' || CAST(user_id % 10 AS VARCHAR) AS session_id, event_id AS seq, event_id + 1 AS global_seq,
  CAST(epoch_us(ts) - 1700000000000000 + event_id % 3 AS DOUBLE) AS mono_time_us,
  CAST(NULL AS VARCHAR) AS phase FROM events
UNION ALL
SELECT 'inject:' || substr(sha256('events'), 1, 16), rn, m + 1 + rn, CAST(wall + offset_us AS DOUBLE), 'call'
FROM inj, o, n""",
)
def merge_union(spark, d):
    return merge.append_injected(*_clock(spark, d)).select(
        "session_id", "seq", "global_seq", "mono_time_us", "phase"
    )
