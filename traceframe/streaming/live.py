"""Live traces: incremental reading and the capture gate on a stream."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from traceframe.operators import gate
from traceframe.sources.ndjson import parse_lines, typed_events
from traceframe.streaming.tail import NAME, TailSource

# Fixed value: poll interval.
POLL = "500 milliseconds"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail_ndjson(spark: SparkSession, directory: str, max_bytes: int | None = None) -> DataFrame:
    """New lines of a folder's files as they arrive; a malformed line is kept as a marker row.

    Files may grow, appear, or be written anew (then they are read from the start); a line counts once it is ended. The
    checkpoint holds the offsets. ``file_index`` is the byte at which a line starts. Without ``max_bytes`` a poll reads
    all that has arrived, so a tail never falls behind by design.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format(NAME)
    if max_bytes is not None:
        reader = reader.option("maxBytes", str(max_bytes))
    lines = reader.load(directory).withColumn("line", F.trim("line")).where("line <> ''")
    return parse_lines(lines, repair=False)


def live_events(tail: DataFrame) -> DataFrame:
    """Typed events in the order of their lines."""
    return typed_events(tail.where("status = 'ok'"))


def without_replays(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of an event id that arrive within the delay, with bounded state."""
    timed = events.withColumn("event_time", F.timestamp_micros(F.col("wall_time_us").cast("bigint")))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["trace_id", "event_id"])


# --- the gate

_COUNTED = "trace_id string, resource_class string, actionable boolean, endpoint string, events bigint, first_index bigint"
_GATE = (
    "trace_id string, status string, observed_actionable_endpoint_count bigint, matched_endpoints array<string>, missing array<string>, "
    "rejected array<struct<resource_class: string, endpoint_count: bigint, event_count: bigint>>"
)


def batch_counts(batches):
    """Endpoint counts inside a task: a trace that sends most events of a batch reaches its state as few rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = ["trace_id", "resource_class", "actionable", "endpoint"]
        yield from table.group_by(keys, use_threads=False).aggregate([("events", "sum"), ("first_index", "min")]).rename_columns(
            [*keys, "events", "first_index"]).to_batches()


class GateProcessor(StatefulProcessor):
    """State of a trace: each endpoint's place of first sight and events, apart from each other, and what the gate says."""

    def init(self, handle) -> None:
        self.endpoints = handle.getMapState("endpoints", "kind string, endpoint string", "events bigint, first_index bigint")
        self.gate = handle.getValueState("gate", "actionable bigint, shown string, rejected string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        actionable, shown, rejected = self.gate.get() if self.gate.exists() else (0, "[]", "{}")
        shown, rejected = json.loads(shown), json.loads(rejected)
        for frame in rows:
            for row in frame.itertuples(index=False):
                kind = "actionable" if row.actionable else row.resource_class
                if not kind:
                    continue
                at = (kind, row.endpoint)
                known = self.endpoints.containsKey(at)
                events, first = self.endpoints.getValue(at) if known else (0, row.first_index)
                first = min(int(first), int(row.first_index))
                self.endpoints.updateValue(at, (int(events) + int(row.events), first))
                if kind == "actionable":
                    actionable += not known
                    # A first sight may move ahead when a file is read late; only the first few are kept.
                    shown = sorted([*(x for x in shown if x[1] != row.endpoint), [first, row.endpoint]])[: gate.SHOWN_ENDPOINTS]
                else:
                    endpoints, total = rejected.get(kind, (0, 0))
                    rejected[kind] = (endpoints + (not known), total + int(row.events))
        self.gate.update((actionable, json.dumps(shown), json.dumps(rejected)))
        order = [c for c in gate.REJECT_CLASSES if c in rejected]
        yield pd.DataFrame({
            "trace_id": [key[0]], "status": ["passed" if shown else "pending"], "observed_actionable_endpoint_count": [actionable],
            "matched_endpoints": [[e for _, e in shown]], "missing": [[] if shown else ["business_api_anchor_not_captured"]],
            "rejected": [[{"resource_class": c, "endpoint_count": rejected[c][0], "event_count": rejected[c][1]} for c in order]],
        })

    def close(self) -> None:
        pass


def gate_stream(events: DataFrame) -> DataFrame:
    """The gate of every trace that a batch changed: one row each, whatever was seen before.

    Needs a state store that keeps entries apart (``spark.sql.streaming.stateStore.providerClass``: RocksDB).
    """
    rows = gate.classified(gate.network_rows(events))
    one = rows.select("trace_id", "resource_class", "actionable", "endpoint", F.lit(1).cast("bigint").alias("events"), F.col("file_index").cast("bigint").alias("first_index"))
    counted = one.mapInArrow(batch_counts, _COUNTED)
    return counted.groupBy("trace_id").transformWithStateInPandas(GateProcessor(), _GATE, "Update", "None")


def start_gate(events: DataFrame, checkpoint: str, publish, poll: str | None = POLL):
    """Run the gate; ``publish(gate DataFrame, batch id)`` gets the rows of traces that changed.

    With ``poll=None`` everything available is processed and the query ends.
    """
    conf = events.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        writer = gate_stream(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)
        return writer.foreachBatch(publish).start()
    finally:
        conf.set(STORE, before) if before else conf.unset(STORE)
