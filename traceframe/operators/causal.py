"""The call tree of schema-2 traces: links, summary, bounded view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.operators.profile import top_k
from traceframe.session import stored

TERMINAL = "causality_kind = 'paired' AND phase IN ('return', 'exception')"


def call_nodes(events: DataFrame) -> DataFrame:
    """Rows that open a node: neither external nor the end of a pair."""
    return events.where(
        f"schema_version = 2 AND causality_kind <> 'external' AND call_id <> '' AND NOT ({TERMINAL})"
    )


def id_session(call_id: Column) -> Column:
    """Session of a call id: what stands before the last colon, so a session may hold colons itself."""
    return F.regexp_extract(call_id, "^(.*):[^:]*$", 1)


def first_nodes(events: DataFrame) -> DataFrame:
    """First row of each call id."""
    cols = F.struct("file_index", "depth", "api", "parent_id", "session_id", "causality_kind", "phase")
    return call_nodes(events).groupBy("trace_id", "call_id").agg(F.min(cols).alias("node"))


def parent_links(events: DataFrame) -> DataFrame:
    """Every node with its parent's first row, NULL when there is none."""
    parents = first_nodes(events).select(
        "trace_id", F.col("call_id").alias("parent_id"), F.col("node").alias("parent")
    )
    return call_nodes(events).join(parents, ["trace_id", "parent_id"], "left")


def link_status(events: DataFrame) -> DataFrame:
    """Status of each node's parent link: root, ok, missing, forward, session, depth."""
    linked = parent_links(events)
    parent = F.col("parent")
    status = (
        F.when(F.col("parent_id").isNull(), "root")
        .when(id_session(F.col("parent_id")) != F.col("session_id"), "session")
        .when(parent.isNull(), "missing")
        .when(parent["file_index"] >= F.col("file_index"), "forward")
        .when(F.col("depth") != parent["depth"] + 1, "depth")
        .otherwise("ok")
    )
    return linked.withColumn("link", status)


def causality_summary(events: DataFrame) -> DataFrame:
    """One row per trace; all zero when the trace has no schema-2 rows."""
    two = F.coalesce(F.col("schema_version") == 2, F.lit(False))
    kind, phase = F.coalesce("causality_kind", F.lit("")), F.coalesce("phase", F.lit(""))
    live = two & (kind != "external") & (F.coalesce("call_id", F.lit("")) != "")
    end = live & (kind == "paired") & phase.isin("return", "exception")
    node = live & ~end
    flagged = events.select(
        "trace_id", "call_id", two.alias("two"), (two & (kind == "external")).alias("external"),
        (end & (phase == "exception")).alias("exception"), (node & (kind == "singleton")).alias("singleton"),
        (node & (kind == "paired")).alias("call"), end.alias("end"),
        (node & (F.coalesce("parent_id", F.lit("")) == "")).alias("root"),
        F.when(node, F.coalesce("depth", F.lit(0))).alias("node_depth"),
    )
    counts = flagged.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("two").alias("causal_events"),
        F.count_if("external").alias("external_nodes"), F.count_if("exception").alias("exception_count"),
        F.count_if("singleton").alias("singleton_nodes"), F.count_if("root").alias("root_count"),
        F.coalesce(F.max("node_depth"), F.lit(0)).alias("max_depth"),
    )
    pairs = flagged.where("call OR end").groupBy("trace_id", "call_id").agg(
        F.bool_or("call").alias("call"), F.bool_or("end").alias("end")
    ).groupBy("trace_id").agg(
        F.count_if("call").alias("paired_activations"), F.count_if(F.col("call") & ~F.col("end")).alias("unclosed_count")
    )
    zero = {"paired_activations": 0, "unclosed_count": 0}
    return counts.join(pairs, "trace_id", "left").na.fill(zero).withColumn(
        "coverage", F.col("causal_events") / F.col("events")
    ).withColumn("available", F.col("causal_events") > 0)


def call_tree(events: DataFrame, max_depth: int = 4, max_nodes: int = 80) -> DataFrame:
    """Nodes down to ``max_depth`` below a root, the first ``max_nodes`` in pre-order.

    Depth and number define this view. One join per level; the path of file indexes
    sorts in pre-order. A repeated call id keeps its last row. A parent comes before its children, so
    each level keeps the first ``max_nodes`` so far and looks below these only: what is behind them stays behind.
    """
    cols = F.struct("file_index", "api", "phase", "causality_kind", "depth", "parent_id")
    nodes = call_nodes(events).groupBy("trace_id", "call_id").agg(
        F.max(cols).alias("n"), F.min("file_index").alias("at")
    ).select("trace_id", "call_id", "at", "n.api", "n.phase", F.col("n.causality_kind").alias("kind"), "n.depth", "n.parent_id")
    nodes = stored(nodes, "nodes")
    first = lambda df: stored(top_k(df, ["trace_id"], max_nodes, F.asc("path"), rank="preorder"), "tree")
    tree = first(nodes.where("coalesce(parent_id, '') = ''").withColumn("path", F.array("at")).withColumn("level", F.lit(0)))
    for i in range(1, max_depth + 1):
        up = tree.where(F.col("level") == i - 1)
        up = up.select("trace_id", F.col("call_id").alias("parent_id"), F.col("path").alias("_up"))
        if up.isEmpty():
            break
        level = nodes.join(up, ["trace_id", "parent_id"]).withColumn(
            "path", F.concat("_up", F.array("at"))
        ).drop("_up").withColumn("level", F.lit(i))
        tree = first(tree.drop("preorder").unionByName(level))
    return tree.drop("at")
