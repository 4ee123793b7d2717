"""Rules on single records, on order, and on what was observed.

A rule returns violations: trace_id, stage, rule, file_index, path, message. Stages
follow the order in which a trace is judged; ``verdicts`` keeps the lowest one, and
the rest of the table says what else is wrong.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions import lookup, material, text
from traceframe.functions.nested import leaves
from traceframe.operators.causal import call_nodes, first_nodes, id_session
from traceframe.operators.sequence import non_monotonic
from traceframe.session import stored

# --- fixed values -----------------------------------------------------------
V1_FIELDS = (
    "schema_version", "event_id", "session_id", "seq", "t", "wall_time_us", "mono_time_us", "category",
    "phase", "api", "args", "stack", "pid", "tid", "frame_url", "origin", "result", "error", "truncated",
)
V2_FIELDS = V1_FIELDS + ("call_id", "parent_id", "depth", "causality_kind", "duration_us")
PHASES = ("call", "return", "exception", "get", "set", "lifecycle", "complete", "iterate")
CAUSALITY_KINDS = ("paired", "singleton", "external")
TRUNCATION_FIELDS = ("original_size", "preview", "hash")
STAGES = {
    "record": 10, "global_seq": 20, "causality": 30, "context": 40, "complete": 50, "refs": 60,
    "expected": 70, "stack": 80, "family": 90, "arg_fields": 100, "request": 110, "parameter": 120,
}
# --- end of fixed values ----------------------------------------------------

COLUMNS = ("trace_id", "stage", "rule", "file_index", "path", "message")


def _violations(df: DataFrame, stage: str, rule: Column | str, path: Column | str = "", message: Column | str = "") -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    index = F.col("file_index") if "file_index" in df.columns else F.lit(None)
    return df.select(
        "trace_id", F.lit(STAGES[stage]).alias("stage"), col(rule).alias("rule"), index.cast("bigint").alias("file_index"),
        col(path).cast("string").alias("path"), col(message).cast("string").alias("message"),
    )


def _exploded(df: DataFrame, stage: str, checks: list[tuple[str, Column, Column | str]]) -> DataFrame:
    """One pass over the records; a row for every check that fails. Records that pass all, as most do, are left first."""
    some = reduce(lambda a, b: a | b, [F.coalesce(cond, F.lit(False)) for _, cond, _ in checks])
    failed = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(name).alias("rule"), (F.lit(path) if isinstance(path, str) else path).cast("string").alias("path")))
        for name, cond, path in checks
    ]))
    rows = df.where(some).select("trace_id", "file_index", F.explode(failed).alias("f"))
    return _violations(rows, stage, F.col("f.rule"), F.col("f.path"))


def _behind(df: DataFrame, value: Column, *keep: str) -> DataFrame:
    """The kept columns and ``made``, the value, which is made behind the filters of the rows.

    Spark compiles a filter together with the scan unless it holds a lambda over an array, and puts adjacent filters together. The
    generator keeps the planner from moving a value with lambdas into the filter that leaves most rows.
    """
    return df.select(*keep, F.explode(F.array(value)).alias("made"))


def _has(key: str) -> Column:
    return F.array_contains("keys", key)


def _record_checks(version: int, fields) -> list:
    absent = F.array_except(F.array(*[F.lit(f) for f in fields]), "keys")
    number = lambda f: _has(f) & F.col(f).isNull()
    return [
        ("schema_version", F.coalesce(F.col("schema_version") != version, F.lit(True)), "schema_version"),
        ("missing_fields", F.size(absent) > 0, F.array_join(absent, ",")),
        ("phase", _has("phase") & ~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)), "phase"),
        ("truncated_type", _has("truncated") & F.col("truncated").isNull(), "truncated"),
    ], number


def record_v1(events: DataFrame) -> DataFrame:
    """Contract of one schema-1 record."""
    checks, number = _record_checks(1, V1_FIELDS)
    is_object = F.coalesce(F.schema_of_variant("truncation").startswith("OBJECT"), F.lit(False))
    cut = F.coalesce("truncated", F.lit(False))
    lacking = F.filter(
        F.array(*[F.lit(f) for f in TRUNCATION_FIELDS]),
        lambda f: ~F.array_contains(F.coalesce(F.json_object_keys(F.to_json("truncation")), F.array()), f),
    )
    checks += [
        ("integer_field", number("global_seq"), "global_seq"),
        ("integer_field", number("session_seq"), "session_seq"),
        ("truncation_missing", cut & ~is_object, "truncation"),
        ("truncation_fields", cut & is_object & (F.size(lacking) > 0), F.array_join(lacking, ",")),
    ]
    return _exploded(events, "record", checks)


def _raw_kind(name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")), F.lit(""))


def record_v2(events: DataFrame) -> DataFrame:
    """Contract of one schema-2 record: the causal fields on top of schema 1."""
    events = events.withColumn("_v", F.try_parse_json("raw"))
    checks, _ = _record_checks(2, V2_FIELDS)
    kind = F.coalesce("causality_kind", F.lit(""))
    external = kind == "external"
    null_or = lambda name, want: _raw_kind(name).isin("VOID", want)
    prefix = F.regexp_extract("call_id", "^(.*):[^:]*$", 1)
    tail = F.regexp_extract("call_id", ":([0-9]+)$", 1)
    empty_id = F.coalesce("call_id", F.lit("")) == ""
    checks += [
        ("causality_kind", _has("causality_kind") & ~kind.isin(*CAUSALITY_KINDS), "causality_kind"),
        ("depth", _has("depth") & F.coalesce(F.col("depth") < 0, F.lit(True)), "depth"),
        ("parent_id_type", _has("parent_id") & ~null_or("parent_id", "STRING"), "parent_id"),
        ("duration", _has("duration_us") & (~null_or("duration_us", "BIGINT") | F.coalesce(F.col("duration_us") < 0, F.lit(False))), "duration_us"),
        ("external_ids", external & ((_raw_kind("call_id") != "VOID") | (_raw_kind("parent_id") != "VOID") | (_raw_kind("duration_us") != "VOID")), "call_id"),
        ("external_depth", external & (F.col("depth") != 0), "depth"),
        ("call_id_missing", ~external & empty_id, "call_id"),
        ("call_id_format", ~external & ~empty_id & ((tail == "") | (prefix != F.coalesce("session_id", F.lit("")))), "call_id"),
        ("singleton_duration", (kind == "singleton") & F.col("duration_us").isNotNull(), "duration_us"),
    ]
    return _exploded(events, "record", checks)


def causality(events: DataFrame) -> DataFrame:
    """Tree and pairing invariants over all schema-2 rows.

    Every row meets the first row of its own call id and of its parent's: two
    equi-joins against one row per id, however often an id is repeated. There may be as many
    ids as rows, so the joins sort and merge: the planner's estimate of grouped rows is too low for a broadcast.
    """
    live = events.where("schema_version = 2 AND causality_kind <> 'external' AND call_id <> ''")
    first = first_nodes(events)
    own = first.select("trace_id", "call_id", F.col("node").alias("own")).hint("merge")
    parent = first.select("trace_id", F.col("call_id").alias("parent_id"), F.col("node").alias("parent")).hint("merge")
    ends = "causality_kind = 'paired' AND phase IN ('return', 'exception')"
    node = live.where(f"NOT ({ends})").join(own, ["trace_id", "call_id"], "left").join(parent, ["trace_id", "parent_id"], "left")
    paired, up = F.col("causality_kind") == "paired", F.col("parent")
    other_session = id_session(F.col("parent_id")) != F.col("session_id")
    has_parent = F.col("parent_id").isNotNull()
    gone = has_parent & ~other_session & F.coalesce(up["file_index"] >= F.col("file_index"), F.lit(True))
    nodes = _exploded(node, "causality", [
        ("paired_phase", paired & ~F.coalesce(F.col("phase") == "call", F.lit(False)), "phase"),
        ("call_duration", paired & (F.col("phase") == "call") & F.col("duration_us").isNotNull(), "duration_us"),
        ("id_reuse", F.col("own")["file_index"] < F.col("file_index"), F.col("call_id")),
        ("root_depth", ~has_parent & (F.col("depth") != 0), "depth"),
        ("cross_session", has_parent & other_session, F.col("parent_id")),
        ("missing_parent", gone, F.col("parent_id")),
        ("depth_step", has_parent & ~other_session & ~gone & (F.col("depth") != up["depth"] + 1), F.col("parent_id")),
    ])
    calls = call_nodes(events).where("causality_kind = 'paired' AND phase = 'call'").groupBy("trace_id", "call_id").agg(
        F.min(F.struct("file_index", "api", "parent_id", "depth")).alias("call")
    )
    terminal = live.where(ends)
    first_end = terminal.groupBy("trace_id", "call_id").agg(F.min("file_index").alias("first_end"))
    closed = terminal.join(calls.hint("merge"), ["trace_id", "call_id"], "left").join(first_end.hint("merge"), ["trace_id", "call_id"])
    call = F.col("call")
    orphan = F.coalesce(call["file_index"] > F.col("file_index"), F.lit(True))
    differs = ~(call["api"].eqNullSafe(F.col("api")) & call["parent_id"].eqNullSafe(F.col("parent_id")) & call["depth"].eqNullSafe(F.col("depth")))
    duplicate = F.col("file_index") > F.col("first_end")
    terminals = _exploded(closed, "causality", [
        ("terminal_duration", F.col("duration_us").isNull(), "duration_us"),
        ("orphan_terminal", orphan, F.col("call_id")),
        ("duplicate_terminal", ~orphan & duplicate, F.col("call_id")),
        ("terminal_disagrees", ~orphan & ~duplicate & differs, F.col("call_id")),
    ])
    unclosed = calls.join(first_end.hint("merge"), ["trace_id", "call_id"], "left_anti")
    open_calls = _violations(
        unclosed.select("trace_id", F.col("call.file_index").alias("file_index"), "call_id"), "causality", "unclosed_call", F.col("call_id")
    )
    return nodes.unionByName(terminals).unionByName(open_calls)


def global_sequence(events: DataFrame) -> DataFrame:
    """Coverage is all or none; values are integers and strictly rise in file order."""
    present = events.where(_has("global_seq"))
    absent = events.where(~_has("global_seq"))
    partial = absent.join(present.select("trace_id").distinct(), "trace_id", "left_semi")
    numbered = present.where("global_seq IS NOT NULL").select("trace_id", "file_index", "global_seq")
    falling = non_monotonic(numbered, ["trace_id"], ["file_index"], "global_seq")
    out = _violations(partial, "global_seq", "partial_coverage", "global_seq")
    out = out.unionByName(_violations(present.where("global_seq IS NULL"), "global_seq", "integer_field", "global_seq"))
    message = F.concat(F.col("global_seq").cast("string"), F.lit(" <= "), F.col("prev_global_seq").cast("string"))
    return out.unionByName(_violations(falling, "global_seq", "not_rising", "global_seq", message))


def _not_observed(events: DataFrame, names, column: str, stage: str, rule: str) -> DataFrame:
    """Required names each trace lacks; the required side is a short literal list."""
    required = F.array(*[F.lit(n) for n in dict.fromkeys(names)])
    seen = events.groupBy("trace_id").agg(
        F.collect_set(F.when(F.col(column).isin(*names), F.col(column))).alias("seen")
    )
    rows = seen.select("trace_id", F.explode(F.array_except(required, "seen")).alias("name"))
    return _violations(rows, stage, rule, F.col("name"))


def context(events: DataFrame, apis) -> DataFrame:
    """Each API is observed, and every one of its rows names frame and origin."""
    blank = (F.coalesce("frame_url", F.lit("")) == "") | (F.coalesce("origin", F.lit("")) == "")
    rows = events.where(F.col("api").isin(*apis) & blank)
    out = _not_observed(events, apis, "api", "context", "api_not_observed")
    return out.unionByName(_violations(rows, "context", "context_missing", F.col("api")))


def expected_apis(events: DataFrame, apis) -> DataFrame:
    return _not_observed(events, apis, "api", "expected", "api_not_observed")


def stack_presence(events: DataFrame, apis) -> DataFrame:
    """An observed API that never carries a stack."""
    rows = events.where(F.col("api").isin(*apis)).groupBy("trace_id", "api").agg(
        F.max(F.coalesce(F.size("stack"), F.lit(0))).alias("frames")
    )
    return _violations(rows.where("frames <= 0"), "stack", "no_stack", F.col("api"))


def event_leaves(events: DataFrame) -> DataFrame:
    """Leaf table of whole records, shared by the rules below."""
    return leaves(events, "raw", ["trace_id", "file_index", "api"])


def complete_values(events: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """Truncated rows, preview keys, redaction flags and redacted text at any path."""
    cut = _violations(events.where("truncated"), "complete", "truncated", F.col("api"))
    holders = F.arrays_zip(F.col("keys").alias("key"), F.col("containers").alias("holder"))
    at = lambda h: F.when(h["holder"] == "", h["key"]).otherwise(F.concat_ws(".", h["holder"], h["key"]))
    found = lambda rule, path: F.struct(F.lit(rule).alias("rule"), path.alias("path"))
    # The path holds every key, so most leaves are settled without looking at their keys one by one.
    previews = F.when(F.contains("path", F.lit("preview")), F.transform(
        F.filter(holders, lambda h: text.is_preview_key(h["key"])), lambda h: found("preview_field", at(h))
    ))
    flag = (F.col("kind") == "boolean") & (F.col("text") == "true") & (F.col("tail") == 0) & text.is_redaction_key(
        F.coalesce(F.try_element_at("keys", F.lit(-1)), F.lit(""))
    )
    marker = (F.col("kind") == "string") & text.is_redacted(F.col("text"))
    redacted = F.when(flag | marker, F.array(found("redacted", F.col("path"))))
    # One pass over the leaves, most of which have no finding. A preview key counts once for each holder, a redacted leaf as often as there is one.
    empty = F.array().cast("array<struct<rule:string,path:string>>")
    some = leaf_rows.where(F.contains("path", F.lit("preview")) | flag | marker)
    rows = _behind(some, F.concat(F.coalesce(previews, empty), F.coalesce(redacted, empty)), "trace_id", "file_index")
    rows = rows.select("trace_id", "file_index", F.explode("made").alias("f"))
    rows = rows.groupBy("trace_id", "file_index", "f.rule", "f.path").agg(F.count(F.lit(1)).alias("n"))
    times = F.when(F.col("rule") == "redacted", F.col("n")).otherwise(1)
    rows = rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return cut.unionByName(_violations(rows, "complete", F.col("rule"), F.col("path")))


def material_refs(leaf_rows: DataFrame) -> DataFrame:
    """Length-only references, and opaque ones without a raw sibling value.

    Opaque references name the members that may speak for them; raw members of a name that none asks for are left before they
    are sent, and the others meet their object's references in one group. A join of the two sides would be planned by sizes
    from before the walk. The leaves are read twice, so they should be stored; references are, when this is called.
    """
    keys = F.col("keys")
    # The text and the path, which holds every key, settle most leaves; the keys of the others are looked at one by one.
    is_summary, is_opaque = text.is_summary_ref(F.col("text")), text.is_opaque_ref(F.col("text"))
    maybe = leaf_rows.where((F.col("kind") == "string") & F.contains("path", F.lit("ref")) & (is_summary | is_opaque))
    flags = F.transform(keys, text.is_ref_key)
    at = F.array_position(flags, True).cast("int")
    none = F.lit(None).cast("array<string>")
    mark = lambda summary, siblings: F.struct(
        F.lit(summary).alias("summary"), F.try_element_at("containers", F.lit(-1)).alias("holder"), siblings.alias("siblings"))
    # The reference key is the last one: only list positions may follow it.
    marks = F.when(is_summary & F.exists(keys, text.is_ref_key), mark(True, none)).when(
        is_opaque & (at > 0) & (at == F.size(keys)), mark(False, material.raw_siblings(F.try_element_at(keys, F.lit(-1))))
    )
    marked = _behind(maybe, marks, "trace_id", "file_index", "path").where("made IS NOT NULL")
    marked = stored(marked.select("trace_id", "file_index", "path", "made.*"), "references")
    out = _violations(marked.where("summary"), "refs", "summary_ref", F.col("path"))
    asked = marked.where("NOT summary")
    # Stored, so that the planner knows how few names there are.
    names = stored(asked.select(F.explode("siblings").alias("sibling")).distinct(), "asked-names")
    named = leaf_rows.where((F.size(keys) > 0) & material.leaf_raw(F.col("kind"), F.col("text"))).select(
        "trace_id", "file_index", "path", "keys", "containers", F.posexplode(keys).alias("place", "sibling")
    ).join(names, "sibling", "left_semi")
    # A member is raw if no key below it is hidden: from the last hidden key on.
    hidden = F.array_position(F.reverse(F.transform(keys, material.hidden_key)), True).cast("int")
    shown = F.when(material.may_be_hidden(F.col("path")) & (hidden > 0), F.size(keys) - hidden).otherwise(0)
    open_ = F.struct((F.col("place") >= shown).alias("open"), F.get("containers", F.col("place")).alias("holder"))
    raw = _behind(named, open_, "trace_id", "file_index", "sibling").where("made.open").withColumn("holder", F.col("made.holder"))
    ask = F.struct("path", "siblings")
    members = asked.select("trace_id", "file_index", "holder", ask.alias("ask"), F.lit(None).cast("string").alias("sibling")).unionByName(
        raw.select("trace_id", "file_index", "holder", F.lit(None).cast(marked.select(ask).schema[0].dataType).alias("ask"), "sibling")
    )
    # What is gathered belongs to one object of one record.
    met = members.groupBy("trace_id", "file_index", "holder").agg(
        F.collect_list("ask").alias("asks"), F.collect_set("sibling").alias("have")
    ).select("trace_id", "file_index", "have", F.explode("asks").alias("ask"))
    found = met.groupBy("trace_id", "file_index", "ask.path").agg(F.bool_or(F.arrays_overlap("ask.siblings", "have")).alias("ok")).where("NOT ok")
    return out.unionByName(_violations(found, "refs", "opaque_ref", F.col("path")))


def evidence_rows(leaf_rows: DataFrame) -> DataFrame:
    """Rows whose arguments, result or error carry material."""
    top, below = F.element_at("keys", 1), F.slice("keys", F.lit(2), F.greatest(F.size("keys") - 1, F.lit(0)))
    named = leaf_rows.where(F.coalesce(F.try_element_at("keys", F.lit(1)), F.lit("")).isin("args", "result", "error"))
    kind, value = F.col("kind"), F.col("text")
    ok = F.when(top == "args", material.has_argument_material(below, kind, value)).when(
        top.isin("result", "error"), material.has_material(below, kind, value)
    )
    return named.where(ok).select("trace_id", "file_index").distinct()


def families(events: DataFrame, leaf_rows: DataFrame | None, required, evidence: bool = False) -> DataFrame:
    """Required families are seen; with ``evidence`` each also carries material."""
    unknown = sorted(set(required) - set(lookup.FAMILIES))
    if unknown:
        raise ValueError(f"unknown families {unknown}")
    named = lookup.with_family(events).where("family IS NOT NULL").select("trace_id", "file_index", "family")
    every = events.select("trace_id", F.lit(None).cast("string").alias("family")).distinct()
    base = named.select("trace_id", "family").unionByName(every)
    out = _not_observed(base, list(required), "family", "family", "family_not_observed") if required else None
    if evidence:
        seen = named.join(evidence_rows(leaf_rows).withColumn("ok", F.lit(True)).hint("merge"), ["trace_id", "file_index"], "left")
        weak = seen.groupBy("trace_id", "family").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok")).where("NOT ok")
        if required:
            weak = weak.where(F.col("family").isin(*required))
        rows = _violations(weak, "family", "family_without_evidence", F.col("family"))
        empty = every.join(named.select("trace_id").distinct(), "trace_id", "left_anti")
        rows = rows.unionByName(_violations(empty, "family", "no_family_events"))
        out = rows if out is None else out.unionByName(rows)
    return out


MAX_SPECS = 10_000


def _spec_rows(specs: DataFrame) -> list:
    """The rule list itself, a short configuration table whose size is checked."""
    rows = specs.take(MAX_SPECS + 1)
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} field specs")
    return rows


def arg_fields(events: DataFrame, leaf_rows: DataFrame, specs: DataFrame) -> DataFrame:
    """``specs`` (api, field, mode): the field is present in the arguments of the API.

    ``material``: some event has it with material, and the API is observed.
    ``observed``: if the API is observed, some event has the key. Of nested objects
    that carry the same field the outermost one decides.
    """
    positions = F.transform(
        F.sequence(F.lit(2), F.size("keys")),
        lambda i: F.struct(
            F.element_at("keys", i).alias("field"), F.element_at("containers", i).alias("holder"),
            F.slice("keys", i + 1, F.size("keys")).alias("below")),
    )
    wanted = specs.select("api", "field", "mode").distinct()
    spec_rows = _spec_rows(wanted)
    # Keys that no spec names are left before anything is asked of them.
    asked_fields = sorted({r["field"] for r in spec_rows if r["field"] is not None})
    positions = F.filter(positions, lambda p: p["field"].isin(*asked_fields))
    in_args = leaf_rows.where((F.size("keys") >= 2) & (F.col("keys")[0] == "args"))
    found = in_args.select("trace_id", "file_index", "api", "kind", "text", F.explode(positions).alias("p")).select(
        "trace_id", "file_index", "api", F.col("p.field").alias("field"), F.col("p.holder").alias("holder"),
        material.has_material(F.col("p.below"), F.col("kind"), F.col("text")).alias("ok"),
    )
    per_holder = found.join(wanted.select("api", "field").distinct(), ["api", "field"], "left_semi").groupBy(
        "trace_id", "api", "field", "file_index", "holder"
    ).agg(F.bool_or("ok").alias("ok"))
    # One record's holders: as many as that record has objects.
    per_event = per_holder.groupBy("trace_id", "api", "field", "file_index").agg(
        F.collect_list(F.struct("holder", "ok")).alias("hs")
    )
    above = lambda y, x: (y["holder"] != x["holder"]) & (
        (y["holder"] == "") | x["holder"].startswith(F.concat(y["holder"], F.lit(".")))
        | x["holder"].startswith(F.concat(y["holder"], F.lit("["))))
    decided = F.exists("hs", lambda x: x["ok"] & ~F.exists("hs", lambda y: above(y, x)))
    status = per_event.withColumn("ok", decided).groupBy("trace_id", "api", "field").agg(F.bool_or("ok").alias("ok"))
    apis = events.select("trace_id", "api").distinct()
    traces = apis.select("trace_id").distinct()
    # Every trace is asked every spec: one row per trace, unfolded in place.
    spec_list = F.array(*[
        F.struct(F.lit(r["api"]).alias("api"), F.lit(r["field"]).alias("field"), F.lit(r["mode"]).alias("mode"))
        for r in spec_rows
    ])
    asked = traces.select("trace_id", F.explode(spec_list).alias("s")).select("trace_id", "s.*")
    judged = asked.join(apis.withColumn("observed", F.lit(True)), ["trace_id", "api"], "left").join(
        status, ["trace_id", "api", "field"], "left"
    )
    observed = F.coalesce("observed", F.lit(False))
    missing = F.when(F.col("mode") == "material", ~F.coalesce("ok", F.lit(False))).otherwise(observed & F.col("ok").isNull())
    name = F.concat(F.col("api"), F.lit(":"), F.col("field"))
    return _violations(judged.where(missing), "arg_fields", F.concat(F.lit("field_"), F.col("mode")), name)


# Fields a form entry needs, by what it holds.
FORM_STRING = ("value", "value_length", "value_ref")
FORM_RESULT = ("result_length", "result_ref")
FORM_ALL_STRING = ("values", "result_value_lengths", "result_value_refs")
FORM_BLOB = (
    "filename", "filename_length", "filename_ref", "blob_type", "blob_type_length", "blob_type_ref",
    "blob_size", "blob_uuid", "blob_uuid_ref",
)
FORM_ALL_BLOB = (
    "blob_filenames", "blob_filename_lengths", "blob_filename_refs", "blob_types", "blob_type_lengths",
    "blob_type_refs", "blob_sizes", "blob_uuids", "blob_uuid_refs",
)
FORM_WRITE_APIS = ("FormData.append", "FormData.set", "FormData.iterator.next")
FORM_APIS = (*FORM_WRITE_APIS, "FormData.get", "FormData.getAll")


def form_branches(events: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """Fields required by the kind or the counts of a form entry."""
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    arg = lambda n, k: F.try_variant_get("arg0", f"$.{n}", k)
    blob = F.coalesce(arg("value_kind", "string") == "blob", F.lit(False))
    none = F.array().cast("array<string>")
    api = F.col("api")
    has_values = F.try_variant_get("arg0", "$.values", "variant").isNotNull()
    strings = (F.coalesce(arg("string_count", "double"), F.lit(0.0)) != 0) | has_values
    blobs = F.coalesce(arg("blob_count", "double"), F.lit(0.0)) != 0
    needed = (
        F.when(api.isin(*FORM_WRITE_APIS), F.when(blob, lit(FORM_BLOB)).otherwise(lit(FORM_STRING)))
        .when(api == "FormData.get", F.when(
            F.coalesce(arg("found", "boolean"), F.lit(False)), F.when(blob, lit(FORM_BLOB)).otherwise(lit(FORM_RESULT))
        ).otherwise(none))
        .when(api == "FormData.getAll", F.concat(
            F.when(strings, lit(FORM_ALL_STRING)).otherwise(none), F.when(blobs, lit(FORM_ALL_BLOB)).otherwise(none)))
    )
    forms = events.where(api.isin(*FORM_APIS) & F.col("arg0").isNotNull())
    asked = forms.select("trace_id", "file_index", "api", F.explode(needed).alias("field"))
    fields = sorted({*FORM_STRING, *FORM_RESULT, *FORM_ALL_STRING, *FORM_BLOB, *FORM_ALL_BLOB})
    have = leaf_rows.where(F.col("path").startswith("args[0].") & api.isin(*FORM_APIS)).select(
        "trace_id", "file_index", F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("field")
    ).where(F.col("field").isin(*fields))
    # The planner sizes these rows as before the walk and the unfolding: it must not gather them for a broadcast.
    lacking = asked.join(have.hint("merge"), ["trace_id", "file_index", "field"], "left_anti")
    return _violations(lacking, "arg_fields", "form_field", F.concat(F.col("api"), F.lit(":"), F.col("field")))


def verdicts(violations: DataFrame, traces: DataFrame) -> DataFrame:
    """Per trace the lowest failing stage, or a pass."""
    worst = violations.groupBy("trace_id").agg(F.min("stage").alias("stage"), F.count(F.lit(1)).alias("violations"))
    return traces.select("trace_id").distinct().join(worst, "trace_id", "left").select(
        "trace_id", "stage", F.coalesce("violations", F.lit(0)).alias("violations"), F.col("stage").isNull().alias("passed")
    )
