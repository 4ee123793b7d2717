"""Counts, the busiest window per session, and profiles of what lies inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.functions import lookup
from traceframe.functions.order import event_time
from traceframe.operators.ordered import interval_sums

SITE = ["url", "function", "line", "column"]


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First k rows per key. The planner prunes to k per task before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def api_counts(events: DataFrame, k: int | None = None) -> DataFrame:
    """Count per (trace, api); ties keep the order of first appearance."""
    out = events.groupBy("trace_id", "api").agg(
        F.count(F.lit(1)).alias("count"), F.min("file_index").alias("first_index")
    )
    if k is None:
        return out
    return top_k(out, ["trace_id"], k, F.desc("count"), F.asc("first_index"))


def family_counts(events: DataFrame, evidence: Column | None = None) -> DataFrame:
    """Per (trace, family, api): events, and events that carry evidence."""
    seen = evidence if evidence is not None else F.lit(True)
    return (
        lookup.with_family(events).where(F.col("family").isNotNull())
        .groupBy("trace_id", "family", "api")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if(seen).alias("evidence_count"),
            F.min("file_index").alias("first_index"),
        )
    )


def signal_counts(events: DataFrame, marked: Column) -> DataFrame:
    """Runtime-signal APIs, and marker-bearing assembly or network APIs."""
    api = F.col("api")
    materialising = api.isin(*lookup.URL_ASSEMBLY_APIS, *lookup.NETWORK_APIS)
    kinds = F.array_compact(
        F.array(
            F.when(lookup.is_runtime_signal(api), F.lit("runtime_signal")),
            F.when(marked & materialising, F.lit("materialization")),
        )
    )
    return (
        events.select("trace_id", "api", "file_index", F.explode(kinds).alias("signal"))
        .groupBy("trace_id", "signal", "api")
        .agg(F.count(F.lit(1)).alias("count"), F.min("file_index").alias("first_index"))
    )


def focus_by_session(events: DataFrame, window_us: int) -> DataFrame:
    """Per session the trailing window with the highest (weight sum, event count).

    Equal peaks: earliest time wins, and among events of one instant the last one,
    since it is the one that completes the sum. An event without a session is a
    session of its own.
    """
    weighted = lookup.with_family(events).where(F.col("weight") > 0)
    lone = F.concat(F.lit("missing-session:"), F.col("file_index").cast("string"))
    weighted = weighted.select(
        "trace_id",
        F.coalesce(F.when(F.col("session_id") != "", F.col("session_id")), lone).alias("session_id"),
        event_time(weighted).cast("bigint").alias("t"), "file_index", "seq", "weight", F.lit(1).cast("bigint").alias("n"),
    )
    keys = ["trace_id", "session_id"]
    instants = weighted.groupBy(*keys, "t").agg(
        F.max(F.struct("file_index", "seq")).alias("last_event")
    )
    spans = instants.select(
        *keys, (F.col("t") - window_us).alias("lo"), F.col("t").alias("hi"), "last_event"
    )
    scored = interval_sums(weighted, "t", spans, "lo", "hi", keys, ["weight", "n"], ["last_event"], distinct=True)
    rank = F.struct(F.col("weight"), F.col("n"), -F.col("hi"))
    best = scored.groupBy(*keys).agg(
        F.max_by(F.struct("hi", "weight", "n", "last_event"), rank).alias("b")
    )
    return best.select(
        *keys,
        F.col("b.hi").cast("bigint").alias("focus_time_us"),
        F.col("b.last_event.file_index").alias("focus_index"),
        F.col("b.last_event.seq").alias("focus_seq"),
        F.col("b.weight").alias("window_score"),
        F.col("b.n").alias("window_event_count"),
    )


def focus_by_trace(session_focus: DataFrame) -> DataFrame:
    """Best session per trace: score, then count, then the earliest order."""
    rank = F.struct("window_score", "window_event_count", -F.col("focus_index"))
    cols = [c for c in session_focus.columns if c != "trace_id"]
    return session_focus.groupBy("trace_id").agg(F.max_by(F.struct(*cols), rank).alias("b")).select(
        "trace_id", *[F.col(f"b.{c}").alias(c) for c in cols]
    )


def window_events(events: DataFrame, focus: DataFrame, window_us: int) -> DataFrame:
    """Events of the focus session in [focus - window, focus].

    An equi-join on (trace, session) with a range filter. The focus side has one row
    per session at most, so a hot session is one key met by one row: the planner may
    broadcast it when small, and skew-join splitting applies when it does not.
    """
    f = focus.select(
        F.col("trace_id"), F.col("session_id"), F.col("focus_time_us"), F.col("focus_index")
    )
    joined = events.join(f, ["trace_id", "session_id"])
    t = event_time(events)
    return joined.where((t <= F.col("focus_time_us")) & (t >= F.col("focus_time_us") - window_us))


def focus_spans(events: DataFrame, focus: DataFrame, window_us: int) -> DataFrame:
    """Add the time of the first weighted event inside each focus window."""
    inside = window_events(lookup.with_family(events).where(F.col("weight") > 0), focus, window_us)
    starts = inside.groupBy("trace_id", "session_id").agg(F.min(event_time(inside).cast("bigint")).alias("window_start_us"))
    return focus.join(starts, ["trace_id", "session_id"], "left").withColumn(
        "window_end_us", F.col("focus_time_us")
    )


def site_role(families: Column) -> Column:
    """Role of a site from the array of families seen there; first rule wins."""

    def meets(names) -> Column:
        return F.arrays_overlap(families, F.array(*[F.lit(n) for n in names]))

    has = lambda name: F.array_contains(families, name)
    return (
        F.when(meets(lookup.DISPATCHER_FAMILIES), "dispatcher_candidate")
        .when(meets(lookup.ANTI_DEBUG_FAMILIES), "anti_debug_candidate")
        .when(meets(lookup.STATE_TABLE_FAMILIES), "state_table_candidate")
        .when(has("hash_crypto") | (has("random_source") & has("int_bitwise")), "crypto_mix_candidate")
        .when(
            meets(("base64", "text_codec"))
            | (has("string_decode") & ~meets(("int_bitwise", "string_transform", "array_table"))),
            "decoder_candidate",
        )
        .when(meets(lookup.HANDLER_FAMILIES), "handler_candidate")
        .otherwise("supporting_runtime_candidate")
    )


def _histogram(df: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """Per key the k most frequent items as an ordered array of (item, count)."""
    counted = df.groupBy(*keys, item).agg(
        F.count(F.lit(1)).alias("count"), F.min("file_index").alias("first_index")
    )
    top = top_k(counted, keys, k, F.desc("count"), F.asc("first_index"))
    return top.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", item, "count"))),
            lambda x: F.struct(x[item].alias(item), x["count"].alias("count")),
        ).alias(f"{item}_counts")
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL, keeping the left copies."""
    r = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def hotspots(inside: DataFrame, k: int = 30, histograms: bool = False) -> DataFrame:
    """Sites of a window ranked by weight * 10 + count.

    ``inside`` is the output of ``window_events``. Families per site are a bounded
    set (the family vocabulary), so collecting them stays small.
    """
    rows = lookup.with_family(inside).where(F.col("family").isNotNull())
    keys = ["trace_id", *SITE]
    sites = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("weight").alias("weight_sum"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.min("file_index").alias("first_index"),
        F.array_sort(F.collect_set("family")).alias("families"),
    )
    sites = sites.withColumn("score", F.col("weight_sum") * 10 + F.col("event_count")).withColumn(
        "role", site_role(F.col("families"))
    )
    out = top_k(sites, ["trace_id"], k, F.desc("score"), F.desc("event_count"), F.asc("first_index"))
    if histograms:
        for item in ("api", "family"):
            out = join_null_safe(out, _histogram(rows, keys, item, 12), keys)
    return out


def op_shape(total: Column, n) -> Column:
    """Shape label from API counts; ``n(api)`` gives the count of one API."""
    shl = n("Shift.left")
    shr = n("Shift.right") + n("Shift.unsignedRight")
    xor, orr, andd = n("Bitwise.xor"), n("Bitwise.or"), n("Bitwise.and")
    chars = n("String.prototype.charCodeAt") + n("String.prototype.charAt") + n("String.fromCharCode")
    calls = n("Function.prototype.call") + n("Function.prototype.apply") + n("Reflect.apply")
    tables = n("Array.prototype.push") + n("ArrayIterator.prototype.next") + n("Array.prototype.pop")
    rotate = (shl > 0) & (shr > 0) & (orr > 0)
    return (
        F.when(calls > total * 0.5, "DISPATCH")
        .when(chars > total * 0.3, "CHAR_DECODE")
        .when(rotate & (xor > 0), "ARX_MIX")
        .when(rotate, "ROTATE/SHIFT")
        .when(andd > total * 0.5, "MASK/BYTE")
        .when(xor > total * 0.4, "XOR_MIX")
        .when(orr > total * 0.4, "OR_COMBINE")
        .when(tables > total * 0.4, "TABLE_LOAD")
        .when(shl + shr > total * 0.4, "SHIFT")
        .otherwise("MIXED")
    )


# Fixed texts: why a shape was chosen.
SHAPE_BASIS = {
    "DISPATCH": "call/apply dominate",
    "CHAR_DECODE": "charCodeAt/charAt stream",
    "ARX_MIX": "rotate (shl|shr) + xor",
    "ROTATE/SHIFT": "shl|shr|or rotate",
    "MASK/BYTE": "bitwise-and dominant",
    "XOR_MIX": "xor dominant",
    "OR_COMBINE": "or dominant",
    "TABLE_LOAD": "array push/index dominant",
    "SHIFT": "shift dominant",
    "MIXED": "no single op-shape dominates",
}
SHAPE_APIS = (
    "Shift.left", "Shift.right", "Shift.unsignedRight", "Bitwise.xor", "Bitwise.or", "Bitwise.and",
    "String.prototype.charCodeAt", "String.prototype.charAt", "String.fromCharCode",
    "Function.prototype.call", "Function.prototype.apply", "Reflect.apply",
    "Array.prototype.push", "ArrayIterator.prototype.next", "Array.prototype.pop",
)


def shape_by_site(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Shape label per site, from conditional counts in one aggregation."""
    counts = [F.count_if(F.col("api") == a).alias(f"_n{i}") for i, a in enumerate(SHAPE_APIS)]
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *counts, *aggregates)
    n = lambda a: F.col(f"_n{SHAPE_APIS.index(a)}")
    shaped = grouped.withColumn("shape", op_shape(F.col("count"), n))
    return shaped.drop(*[f"_n{i}" for i in range(len(SHAPE_APIS))])


def opcode_table(
    inside: DataFrame, k: int = 40, operands: tuple[str, ...] = ("right", "left", "value", "shift"),
    snippets: DataFrame | None = None, histograms: bool = False,
) -> DataFrame:
    """Sites of a window numbered by how often they ran, with their op shape.

    ``operands`` names the numeric argument columns present; integral constants with
    1 < |x| <= 2**32 - 1 are counted per site. ``snippets`` (url, function, column,
    snippet) is attached when given.
    """
    rows = lookup.with_family(inside).where(F.col("family").isNotNull())
    keys = ["trace_id", *SITE]
    shaped = shape_by_site(
        rows, keys,
        F.array_sort(F.collect_set("family")).alias("families"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min("file_index").alias("first_index"),
    )
    table = shaped.withColumn("role", site_role(F.col("families")))
    table = top_k(table, ["trace_id"], k, F.desc("count"), F.asc("first_index"))
    table = table.withColumn("opcode", (F.col("rank") - 1).cast("bigint")).drop("rank")
    table = table.withColumn(
        "shape_basis",
        F.element_at(F.create_map(*[F.lit(x) for kv in SHAPE_BASIS.items() for x in kv]), F.col("shape")),
    )
    if histograms:
        for item in ("api", "family"):
            table = join_null_safe(table, _histogram(rows, keys, item, 6), keys)
        table = join_null_safe(table, _histogram(site_constants(rows, operands), keys, "constant", 8), keys)
    if snippets is not None:
        first = snippets.groupBy("url", "function", "column").agg(
            F.min_by("snippet", "snippet_rank").alias("snippet")
        )
        table = join_null_safe(table, first, ["url", "function", "column"]).withColumn(
            "snippet", F.substring("snippet", 1, 240)
        )
    return table


def site_constants(rows: DataFrame, operands) -> DataFrame:
    """One row per integral constant operand of each event."""
    present = [c for c in operands if c in rows.columns]
    numeric = F.array(*[F.col(c).cast("double") for c in present])
    one = F.explode(numeric).alias("_x")
    keep = (F.col("_x") == F.floor("_x")) & (F.abs("_x") > 1) & (F.abs("_x") <= 0xFFFFFFFF)
    return rows.select("trace_id", *SITE, "file_index", one).where(keep).withColumn(
        "constant", F.col("_x").cast("bigint")
    )


def densest_script(events: DataFrame, groups=lookup.DEFAULT_COMPUTE, script: str = "url") -> DataFrame:
    """Per trace the script with the most computing events; ties keep the first seen."""
    counted = (
        events.where(lookup.is_compute(F.col("api"), groups))
        .groupBy("trace_id", F.coalesce(F.col(script), F.lit("")).alias("script"))
        .agg(F.count(F.lit(1)).alias("ops"), F.min("file_index").alias("first_index"))
    )
    rank = F.struct("ops", -F.col("first_index"))
    return counted.groupBy("trace_id").agg(
        F.max_by("script", rank).alias("script"), F.max("ops").alias("ops")
    )


def window_profile(inside: DataFrame, k_api: int = 50, k_stack: int = 30) -> DataFrame:
    """API, family and stack counts of a window as one long table, in one aggregation."""
    rows = lookup.with_family(inside)
    named = F.col("family").isNotNull()
    entry = lambda kind, item, k: F.struct(
        F.lit(kind).alias("kind"), item.alias("item"), F.lit(k).alias("k")
    )
    stack = F.concat_ws(" ", "url", "function")
    entries = F.array_compact(
        F.array(
            entry("events", F.lit(""), 1),
            F.when(named, entry("family_events", F.lit(""), 1)),
            F.when(named, entry("api", F.col("api"), k_api)),
            F.when(named, entry("family", F.col("family"), k_api)),
            F.when(named, entry("stack", stack, k_stack)),
        )
    )
    counted = (
        rows.select("trace_id", "file_index", F.explode(entries).alias("e"))
        .groupBy("trace_id", F.col("e.kind").alias("kind"), F.col("e.item").alias("item"), F.col("e.k").alias("k"))
        .agg(F.count(F.lit(1)).alias("count"), F.min("file_index").alias("first_index"))
    )
    limit = max(k_api, k_stack)
    ranked = top_k(counted, ["trace_id", "kind"], limit, F.desc("count"), F.asc("first_index"))
    return ranked.where(F.col("rank") <= F.col("k")).drop("k")


def first_last(inside: DataFrame, marked: Column, key_event: Column, k: int = 80) -> DataFrame:
    """First k marked events and last k key events of each window."""
    tagged = inside.withColumn("_marked", marked).withColumn("_key", key_event)
    first = top_k(tagged.where("_marked"), ["trace_id", "session_id"], k, F.asc("file_index"))
    last = top_k(tagged.where("_key"), ["trace_id", "session_id"], k, F.desc("file_index"))
    return (
        first.withColumn("list", F.lit("marker_events"))
        .unionByName(last.withColumn("list", F.lit("last_events")))
        .drop("_marked", "_key")
    )
