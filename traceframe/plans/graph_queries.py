"""Queries over sequences, call trees, lineage and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.operators import causal, diff, lineage, sequence
from traceframe.operators.ordered import with_previous
from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import V_EVENTS, micros, table, v_events


@query(
    "monotonic_seq",
    f"""WITH {V_EVENTS}, s AS (SELECT session_id, file_index, file_index + 20 * (rgt % 3) AS global_seq FROM v_events),
p AS (SELECT *, coalesce(lag(global_seq) OVER (PARTITION BY session_id ORDER BY file_index), 0) AS prev_global_seq FROM s)
SELECT session_id, file_index, global_seq, prev_global_seq FROM p WHERE global_seq <= prev_global_seq""",
)
def monotonic_seq(spark, d):
    rows = v_events(spark, d).select(
        "session_id", "file_index", (F.col("file_index") + 20 * (F.col("right") % 3)).alias("global_seq")
    )
    return sequence.non_monotonic(rows, ["session_id"], ["file_index"], "global_seq")


@query(
    "bigrams",
    """WITH n AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT role AS "from", nxt AS "to", count(*) AS count FROM n WHERE nxt IS NOT NULL
GROUP BY role, nxt ORDER BY count DESC, min(conv_id * 1000000 + turn) LIMIT 20""",
)
def bigrams(spark, d):
    c = table(spark, d, "conversations")
    return sequence.bigrams(c, ["conv_id"], ["turn"], "role", 20, scope=[]).select("from", "to", "count")


@query(
    "runs_period1",
    f"""WITH {V_EVENTS}, p AS (SELECT session_id, file_index, api,
    row_number() OVER (PARTITION BY session_id ORDER BY file_index) - 1 AS pos,
    row_number() OVER (PARTITION BY session_id, api ORDER BY file_index) AS rn FROM v_events)
SELECT session_id, api AS label, min(pos) AS block_start, count(*) AS "repeat" FROM p
GROUP BY session_id, api, pos - rn HAVING count(*) >= 2""",
)
def runs_period1(spark, d):
    pieces = sequence.roll_loops(v_events(spark, d), ["session_id"], ["file_index"], "api", max_period=1)
    return pieces.where("kind = 'loop'").select(
        "session_id", F.col("body")[0].alias("label"), "block_start", "repeat"
    )


@query(
    "loops",
    f"""WITH RECURSIVE {V_EVENTS},
s AS (SELECT session_id, api, row_number() OVER (PARTITION BY session_id ORDER BY file_index) - 1 AS pos FROM v_events),
p AS (SELECT unnest(range(1, 9)) AS p),
m AS (SELECT s.session_id, s.pos, p.p, t.api IS NULL OR t.api <> s.api AS differs
  FROM s CROSS JOIN p LEFT JOIN s t ON t.session_id = s.session_id AND t.pos = s.pos + p.p),
r AS (SELECT session_id, pos, p, min(CASE WHEN differs THEN pos END) OVER (PARTITION BY session_id, p ORDER BY pos
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos AS run FROM m),
f AS (SELECT session_id, pos, min(p) AS p, arg_min(run, p) AS run FROM r WHERE run >= p GROUP BY 1, 2),
n AS (SELECT s.session_id, s.pos, coalesce(f.p, 0) AS p, CASE WHEN f.p IS NULL THEN s.pos + 1 ELSE s.pos + f.p * (f.run // f.p + 1) END AS nxt
  FROM s LEFT JOIN f ON f.session_id = s.session_id AND f.pos = s.pos),
walk AS (SELECT * FROM n WHERE pos = 0
  UNION ALL SELECT n.* FROM walk JOIN n ON n.session_id = walk.session_id AND n.pos = walk.nxt),
i AS (SELECT *, count_if(p > 0) OVER (PARTITION BY session_id ORDER BY pos) AS island FROM walk),
b AS (
  SELECT session_id, pos AS block_start, 'loop' AS kind, nxt - pos AS ops, (nxt - pos) // p AS "repeat", p AS len FROM i WHERE p > 0
  UNION ALL SELECT session_id, min(pos), 'straight', count(*), 1, 0 FROM i WHERE p = 0 GROUP BY session_id, island)
SELECT b.session_id, block_start, kind, CAST(ops AS BIGINT) AS ops, CAST("repeat" AS BIGINT) AS "repeat",
  string_agg(s.api, ' ' ORDER BY s.pos) AS body
FROM b LEFT JOIN s ON s.session_id = b.session_id AND s.pos >= block_start AND s.pos < block_start + len GROUP BY 1, 2, 3, 4, 5""",
)
def loops(spark, d):
    pieces = sequence.roll_loops(v_events(spark, d), ["session_id"], ["file_index"], "api")
    whole = sequence.blocks(pieces, ["session_id"])
    return whole.select("session_id", "block_start", "kind", "ops", "repeat", F.array_join("body", " ").alias("body"))


def v_calls(spark, d):
    """Customers, their orders (pairs) and lineitems as one call tree."""
    none = F.lit(None)
    cust, orders, li, nation = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "nation"))

    def rows(df, index, call, parent, depth, kind, phase, api):
        return df.select(
            F.lit("calls").alias("trace_id"), F.lit("s").alias("session_id"), index.cast("bigint").alias("file_index"),
            F.lit(2).cast("bigint").alias("schema_version"), call.cast("string").alias("call_id"),
            parent.cast("string").alias("parent_id"), F.lit(depth).cast("bigint").alias("depth"),
            F.lit(kind).alias("causality_kind"), F.lit(phase).alias("phase"), F.lit(api).alias("api"),
        )

    cid = lambda base, col: F.concat(F.lit("s:"), (F.lit(base) + col).cast("string"))
    ck, ok = F.col("c_custkey"), F.col("o_orderkey")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    out = rows(cust, ck, cid(0, ck), none, 0, "singleton", "call", "customer")
    out = out.unionByName(rows(orders, 10_000_000 + ok, cid(10_000_000, ok), cid(0, F.col("o_custkey")), 1, "paired", "call", "order"))
    ends = orders.where("o_orderstatus <> 'O'")
    fine, failed = ends.where("o_orderstatus = 'F'"), ends.where("o_orderstatus <> 'F'")
    out = out.unionByName(rows(fine, 20_000_000 + ok, cid(10_000_000, ok), cid(0, F.col("o_custkey")), 1, "paired", "return", "order"))
    out = out.unionByName(rows(failed, 20_000_000 + ok, cid(10_000_000, ok), cid(0, F.col("o_custkey")), 1, "paired", "exception", "order"))
    out = out.unionByName(rows(li, 100_000_000 + line, cid(100_000_000, line), cid(10_000_000, F.col("l_orderkey")), 2, "singleton", "get", "line"))
    return out.unionByName(rows(nation, 900_000_000 + F.col("n_nationkey"), none, none, 0, "external", "call", "nation"))


V_CALLS = """
v_calls AS (
  SELECT c_custkey AS file_index, 's:' || CAST(c_custkey AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS parent_id,
    0 AS depth, 'singleton' AS kind, 'call' AS phase, 'customer' AS api FROM customer
  UNION ALL SELECT 10000000 + o_orderkey, 's:' || CAST(10000000 + o_orderkey AS VARCHAR), 's:' || CAST(o_custkey AS VARCHAR),
    1, 'paired', 'call', 'order' FROM orders
  UNION ALL SELECT 20000000 + o_orderkey, 's:' || CAST(10000000 + o_orderkey AS VARCHAR), 's:' || CAST(o_custkey AS VARCHAR),
    1, 'paired', CASE WHEN o_orderstatus = 'F' THEN 'return' ELSE 'exception' END, 'order' FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT 100000000 + l_orderkey * 10 + l_linenumber, 's:' || CAST(100000000 + l_orderkey * 10 + l_linenumber AS VARCHAR),
    's:' || CAST(10000000 + l_orderkey AS VARCHAR), 2, 'singleton', 'get', 'line' FROM lineitem
  UNION ALL SELECT 900000000 + n_nationkey, NULL, NULL, 0, 'external', 'call', 'nation' FROM nation),
nodes AS (SELECT * FROM v_calls WHERE kind <> 'external' AND NOT (kind = 'paired' AND phase IN ('return', 'exception'))),
firsts AS (SELECT call_id, min(file_index) AS fi, arg_min(depth, file_index) AS depth FROM nodes GROUP BY call_id)"""


@query(
    "call_tree_links",
    f"""WITH {V_CALLS}
SELECT n.api, CASE WHEN n.parent_id IS NULL THEN 'root' WHEN p.call_id IS NULL THEN 'missing'
    WHEN p.fi >= n.file_index THEN 'forward' WHEN n.depth <> p.depth + 1 THEN 'depth' ELSE 'ok' END AS link,
  count(*) AS n FROM nodes n LEFT JOIN firsts p ON n.parent_id = p.call_id GROUP BY 1, 2""",
)
def call_tree_links(spark, d):
    return causal.link_status(v_calls(spark, d)).groupBy("api", "link").agg(F.count(F.lit(1)).alias("n"))


@query(
    "causality_summary",
    f"""WITH {V_CALLS}, pairs AS (SELECT call_id, bool_or(phase = 'call') AS c, bool_or(phase <> 'call') AS e
  FROM v_calls WHERE kind = 'paired' GROUP BY call_id)
SELECT count(*) AS causal_events, CAST(count_if(kind = 'external') AS BIGINT) AS external_nodes,
  CAST(count_if(phase = 'exception') AS BIGINT) AS exception_count,
  CAST(count_if(kind = 'singleton') AS BIGINT) AS singleton_nodes,
  (SELECT CAST(count_if(parent_id IS NULL) AS BIGINT) FROM nodes) AS root_count, CAST(max(depth) AS BIGINT) AS max_depth,
  (SELECT CAST(count_if(c) AS BIGINT) FROM pairs) AS paired_activations,
  (SELECT CAST(count_if(c AND NOT e) AS BIGINT) FROM pairs) AS unclosed_count, CAST(1.0 AS DOUBLE) AS coverage FROM v_calls""",
)
def causality_summary(spark, d):
    return causal.causality_summary(v_calls(spark, d)).select(
        "causal_events", "external_nodes", "exception_count", "singleton_nodes", "root_count", "max_depth",
        "paired_activations", "unclosed_count", "coverage",
    )


@query(
    "call_tree",
    f"""WITH {V_CALLS}, uniq AS (SELECT call_id, arg_max(parent_id, file_index) AS parent_id, min(file_index) AS at_,
    arg_max(api, file_index) AS api FROM nodes GROUP BY call_id),
t0 AS (SELECT u.call_id, u.api, [u.at_] AS path, 0 AS level FROM uniq u JOIN nodes n ON n.call_id = u.call_id WHERE n.parent_id IS NULL),
t1 AS (SELECT u.call_id, u.api, list_append(t0.path, u.at_) AS path, 1 AS level FROM uniq u JOIN t0 ON u.parent_id = t0.call_id),
t2 AS (SELECT u.call_id, u.api, list_append(t1.path, u.at_) AS path, 2 AS level FROM uniq u JOIN t1 ON u.parent_id = t1.call_id)
SELECT call_id, api, level FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)
ORDER BY path LIMIT 80""",
)
def call_tree(spark, d):
    return causal.call_tree(v_calls(spark, d)).select("call_id", "api", "level")


def v_refs(spark, d):
    """Reference members of operations: lineitems that combine a part and a supplier."""
    li = table(spark, d, "lineitem")
    op = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    member = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    return li.select(
        F.lit("lineitem").alias("trace_id"), op.alias("op"),
        F.explode(F.array(
            member("left_ref", F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))),
            member("left", F.col("l_quantity").cast("bigint")),
            member("right_source_ref", F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string"))),
            member("result_ref", F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))),
        )).alias("m"),
    ).select("trace_id", "op", "m.key", "m.value")


@query(
    "dag_edges",
    """WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS op, l_partkey, l_suppkey, l_orderkey FROM lineitem),
e AS (SELECT DISTINCT 'part:' || CAST(l_partkey AS VARCHAR) AS "from", 'order:' || CAST(l_orderkey AS VARCHAR) AS "to", 'left' AS role, op FROM o
  UNION SELECT DISTINCT 'supp:' || CAST(l_suppkey AS VARCHAR), 'order:' || CAST(l_orderkey AS VARCHAR), 'right_source', op FROM o)
SELECT "from", "to", role, op FROM e""",
)
def dag_edges(spark, d):
    edges, _, _, _ = lineage.dag(v_refs(spark, d), ["trace_id"])
    return edges.select("from", "to", "role", "op").distinct()


@query(
    "ref_values",
    """WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS op, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem),
g AS (SELECT op, max(l_partkey) AS dummy FROM o GROUP BY op),
f AS (SELECT op, max('part:' || CAST(l_partkey AS VARCHAR)) AS ref, max(q) AS q FROM o GROUP BY op),
v AS (SELECT ref, arg_min(q, op) AS value FROM f GROUP BY ref),
refs AS (SELECT DISTINCT 'part:' || CAST(l_partkey AS VARCHAR) AS ref, CAST(l_partkey AS VARCHAR) AS lit FROM lineitem
  UNION SELECT DISTINCT 'supp:' || CAST(l_suppkey AS VARCHAR), CAST(l_suppkey AS VARCHAR) FROM lineitem)
SELECT r.ref, coalesce(v.value, r.lit) AS value FROM refs r LEFT JOIN v ON r.ref = v.ref""",
)
def ref_values(spark, d):
    _, _, inputs, values = lineage.dag(v_refs(spark, d), ["trace_id"])
    return lineage.ref_materials(inputs, values, ["trace_id"]).select("ref", "value")


@query(
    "lineage_closure",
    """WITH RECURSIVE c AS (
  SELECT doc_id AS anchor_id, doc_id AS node, 0 AS hop FROM documents
  UNION SELECT c.anchor_id, d.doc_id // 2, hop + 1 FROM c JOIN documents d ON d.doc_id = c.node WHERE d.doc_id > 0)
SELECT anchor_id, node, CAST(hop AS INTEGER) AS hop FROM c""",
)
def lineage_closure(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    edges = docs.where("doc_id > 0").select(F.expr("doc_id div 2").alias("from"), F.col("doc_id").alias("to"))
    anchors = docs.select(F.col("doc_id").alias("anchor_id"), F.col("doc_id").alias("node"))
    return lineage.closure(anchors, edges)


@query(
    "lineage_chain",
    f"""WITH {V_EVENTS}
SELECT session_id AS anchor_id, file_index AS node, CAST(row_number() OVER (PARTITION BY session_id ORDER BY file_index DESC) - 1 AS INTEGER) AS hop
FROM v_events""",
)
def lineage_chain(spark, d):
    """All events that lead to the last one of each session, each event coming from the one before: long chains."""
    e = v_events(spark, d).select("session_id", "file_index")
    edges = with_previous(e, ["session_id"], ["file_index"], ["file_index"]).where("prev_file_index is not null")
    anchors = e.groupBy(F.col("session_id").alias("anchor_id")).agg(F.max("file_index").alias("node"))
    return lineage.closure(anchors, edges.select(F.col("prev_file_index").alias("from"), F.col("file_index").alias("to")))


@query(
    "field_subdag",
    """WITH RECURSIVE c AS (
  SELECT doc_id AS field, doc_id AS node FROM documents UNION ALL SELECT field, node // 2 FROM c WHERE node > 0)
SELECT d.source AS anchor_id, c.field, 'doc:' || CAST(c.node // 2 AS VARCHAR) AS "from", 'doc:' || CAST(c.node AS VARCHAR) AS "to", 'left' AS role, c.node AS op
FROM c JOIN documents d ON d.doc_id = c.field JOIN documents p ON p.doc_id = c.node WHERE c.node > 0""",
)
def field_subdag(spark, d):
    """A document is made from the one of half its number; each is a field of its source."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    ref = lambda c: F.concat(F.lit("doc:"), c.cast("string"))
    member = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    half = F.expr("doc_id div 2")
    members = F.explode(F.array(member("left_ref", ref(half)), member("result_ref", ref(F.col("doc_id"))), member("result", F.concat(F.lit("v"), F.col("doc_id").cast("string")))))
    refs = docs.select(F.lit("docs").alias("trace_id"), F.col("doc_id").alias("op"), members.alias("m")).select("trace_id", "op", "m.key", "m.value")
    edges, _, _, values = lineage.dag(refs, ["trace_id"])
    fields = docs.select(F.col("source").alias("anchor_id"), F.col("doc_id").alias("field"), F.lit("docs").alias("trace_id"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("value"))
    return lineage.field_subdag(fields, values, edges, ["trace_id"])


def _runs(spark, d):
    e = v_events(spark, d)
    day = F.floor(F.col("mono_time_us") / 86_400_000_000)
    return e.withColumn("run_id", (day % 2).cast("bigint"))


RUNS_SQL = f"{V_EVENTS}, runs AS (SELECT *, (mono_time_us // 86400000000) % 2 AS run_id FROM v_events)"


@query(
    "run_diff",
    f"""WITH {RUNS_SQL}, n AS (SELECT run_id, user_id, count(*) AS n FROM runs GROUP BY run_id, user_id)
SELECT user_id, count(*) AS runs_seen, CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS min_count, max(n) AS max_count,
  count(*) = 2 AND min(n) = max(n) AS constant, count(*) = 2 AS shared FROM n GROUP BY user_id""",
)
def run_diff(spark, d):
    return diff.run_diff(_runs(spark, d), "user_id")


@query(
    "set_diff",
    f"""WITH {RUNS_SQL}, v AS (SELECT props || api AS value, bool_or(run_id = 0) AS a, bool_or(run_id = 1) AS b FROM runs GROUP BY 1)
SELECT CAST(count_if(b AND NOT a) AS BIGINT) AS added, CAST(count_if(a AND NOT b) AS BIGINT) AS removed,
  CAST(count_if(a AND b) AS BIGINT) AS shared FROM v""",
)
def set_diff(spark, d):
    rows = _runs(spark, d).withColumn("material", F.concat("props", "api"))
    return diff.set_diff(rows, "material", "run_id", 0, 1)


@query(
    "field_diff",
    """WITH p AS (SELECT conv_id, turn, string_split(text, '.') AS parts, contains(text, '.') AS ok FROM conversations),
g AS (SELECT conv_id, min(len(parts)) AS short FROM p GROUP BY conv_id HAVING bool_and(ok)),
r AS (SELECT p.conv_id, p.turn, unnest(range(0, g.short)) AS i, parts FROM p JOIN g ON p.conv_id = g.conv_id),
v AS (SELECT conv_id, turn, i, parts[i + 1] AS v FROM r),
f AS (SELECT conv_id, i, arg_min(v, turn) AS v0 FROM v GROUP BY conv_id, i),
x AS (SELECT v.conv_id, v.i, bool_and(v = v0) AS same, min(length(v)) AS min_len, max(length(v)) AS max_len,
    max(CASE WHEN length(v) = length(v0) THEN (SELECT count(*) FROM range(1, length(v) + 1) t(k) WHERE substr(v, CAST(k AS INTEGER), 1) <> substr(v0, CAST(k AS INTEGER), 1)) END) AS dist
  FROM v JOIN f ON v.conv_id = f.conv_id AND v.i = f.i GROUP BY v.conv_id, v.i)
SELECT conv_id AS group_id, i, same, min_len, max_len, CASE WHEN NOT same AND min_len = max_len THEN dist END AS hamming FROM x""",
)
def field_diff(spark, d):
    c = table(spark, d, "conversations")
    tokens = c.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("run_id"), F.lit("text").alias("token"), F.col("text").alias("value"))
    return diff.field_diff(tokens, ".").drop("token")
