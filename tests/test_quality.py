import pytest
from pyspark.sql import functions as F

from conftest import record, with_families
from traceframe.operators import shape
from traceframe.quality import report, requests, rules
from traceframe.sources.ndjson import scan_ndjson


@pytest.fixture
def load(spark, write_trace):
    return lambda rows: with_families(scan_ndjson(spark, write_trace(rows)))


def named(df):
    return {r.rule for r in df.collect()}


@pytest.mark.parametrize("change,rule", [
    ({}, None), ({"schema_version": 2}, "schema_version"), ({"origin": "DROP"}, "missing_fields"), ({"phase": "later"}, "phase"),
    ({"truncated": "no"}, "truncated_type"), ({"global_seq": "1"}, "integer_field"), ({"session_seq": True}, "integer_field"),
    ({"truncated": True}, "truncation_missing"), ({"truncated": True, "truncation": {"preview": "x"}}, "truncation_fields"),
    ({"truncated": True, "truncation": {"original_size": 1, "preview": "x", "hash": "h"}}, None),
])
def test_record_v1(load, change, rule):
    assert named(rules.record_v1(load([record(1, **change)]))) == ({rule} if rule else set())


@pytest.mark.parametrize("change,rule", [
    ({}, None), ({"parent_id": "DROP"}, "missing_fields"), ({"causality_kind": "x"}, "causality_kind"), ({"depth": -1}, "depth"),
    ({"depth": True}, "depth"), ({"parent_id": 4}, "parent_id_type"), ({"duration_us": 3}, "singleton_duration"),
    ({"call_id": "other:1"}, "call_id_format"), ({"call_id": "session-1:x"}, "call_id_format"), ({"call_id": None}, "call_id_missing"),
    ({"causality_kind": "external"}, "external_ids"), ({"causality_kind": "external", "call_id": None, "depth": 1}, "external_depth"),
    ({"causality_kind": "external", "call_id": None}, None), ({"causality_kind": "paired", "duration_us": -4}, "duration"),
])
def test_record_v2(load, change, rule):
    got = named(rules.record_v2(load([record(1, 2, **change)])))
    assert (rule in got) if rule else not got


def call(i, cid, parent=None, depth=0, kind="singleton", phase="get", **over):
    return record(i, 2, call_id=f"session-1:{cid}", parent_id=parent, depth=depth, causality_kind=kind, phase=phase, **over)


def pair(*ends):
    return [call(1, 1, kind="paired", phase="call"), *ends]


END = dict(kind="paired", phase="return", duration_us=5)


@pytest.mark.parametrize("rows,rule", [
    (pair(call(2, 2, "session-1:1", 1), call(3, 1, **END)), None), (pair(), "unclosed_call"), ([call(1, 1, **END)], "orphan_terminal"),
    (pair(call(2, 1, **END), call(3, 1, **END)), "duplicate_terminal"), (pair(call(2, 1, **END, api="x")), "terminal_disagrees"),
    ([call(1, 1), call(2, 1)], "id_reuse"), ([call(1, 1, depth=1)], "root_depth"), ([call(1, 1, "other:1", 1)], "cross_session"),
    ([call(1, 1, "session-1:2", 1), call(2, 2)], "missing_parent"), ([call(1, 1), call(2, 2, "session-1:1", 2)], "depth_step"),
    ([call(1, 1, kind="paired", phase="get")], "paired_phase"), (pair(call(2, 1, kind="paired", phase="return")), "terminal_duration"),
])
def test_causality(load, rows, rule):
    got = named(rules.causality(load(rows)))
    assert (rule in got) if rule else not got


def test_global_sequence(load):
    ok = [record(i, global_seq=i) for i in (1, 2, 5)]
    assert not named(rules.global_sequence(load(ok)))
    assert not named(rules.global_sequence(load([record(1), record(2)])))
    assert named(rules.global_sequence(load([*ok, record(6)]))) == {"partial_coverage"}
    assert named(rules.global_sequence(load([*ok, record(6, global_seq=5)]))) == {"not_rising"}


def test_context_stack_expected(load):
    e = load([record(1), record(2, api="fetch", origin="")])
    assert named(rules.context(e, ["TextEncoder.encode"])) == set()
    assert named(rules.context(e, ["fetch", "gone"])) == {"context_missing", "api_not_observed"}
    assert {r.path for r in rules.stack_presence(e, ["fetch", "gone"]).collect()} == {"fetch"}
    assert {r.path for r in rules.expected_apis(e, ["fetch", "gone"]).collect()} == {"gone"}


@pytest.mark.parametrize("args,rule,path", [
    ([{"url_preview": "x"}], "preview_field", "args[0].url_preview"), ([{"a": {"redacted": True}}], "redacted", "args[0].a.redacted"),
    ([{"a": ["ok", " <REDACTED> "]}], "redacted", "args[0].a[1]"), ([{"redacted": False}], None, None), ([{"preview": {}}], "preview_field", "args[0].preview"),
])
def test_complete_values(load, args, rule, path):
    e = load([record(1, args=args)])
    got = {(r.rule, r.path) for r in rules.complete_values(e, rules.event_leaves(e)).collect()}
    assert got == ({(rule, path)} if rule else set())


def test_complete_values_walks_once(load, capsys):
    """one walk of the leaves; a preview key counts once, leaves of one path each."""
    e = load([record(1, args=[{"x_preview": ["a", "b"], "a.b": "<redacted>", "a": {"b": "<redacted>"}}])])
    found = rules.complete_values(e, rules.event_leaves(e))
    got = sorted((r.rule, r.path) for r in found.collect())
    assert got == [("preview_field", "args[0].x_preview"), ("redacted", "args[0].a.b"), ("redacted", "args[0].a.b")]
    capsys.readouterr()
    rules.complete_values(e, rules.event_leaves(e)).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == plan.count("MapInArrow flatten") == 1


@pytest.mark.parametrize("args,rule", [
    ([{"result_ref": "string:length:4"}], "summary_ref"), ([{"result_ref": "string_ref:1"}], "opaque_ref"),
    ([{"result_ref": "string_ref:1", "result": "raw"}], None), ([{"result_ref": "string_ref:1", "serialized": "raw"}], None),
    ([{"x_refs": ["string_ref:1"], "xs": ["raw"]}], None), ([{"x_refs": ["string_ref:1"], "x_preview": "raw"}], "opaque_ref"),
    ([{"result_ref": "string_ref:1", "result": {"preview": "p"}}], "opaque_ref"), ([{"result_ref": "stable-thing"}], None),
    ([{"input_ref": {"inner": "string_ref:9"}}], None), ([{"ref": "bytes_sha1:ab", "body_hex": "00"}], None),
])
def test_material_refs(load, args, rule):
    e = load([record(1, args=args)])
    assert named(rules.material_refs(rules.event_leaves(e))) == ({rule} if rule else set())


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.split("== Initial Plan ==")[0]


def test_material_refs_in_one_pass(load, capsys):
    """No join that a size estimate from before the walk could turn into a broadcast, and one walk of the leaves."""
    args = [{"x_refs": ["string_ref:1", "string_ref:2"], "y_ref": "string_ref:3", "y": {"deep": [0]}, "a": {"b_ref": "string:length:1"}, "a.b_ref": "string:length:2"}]
    got = rules.material_refs(rules.event_leaves(load([record(1, args=args)])))
    rows = sorted((r.rule, r.path) for r in got.collect())
    assert rows == [("opaque_ref", "args[0].x_refs[0]"), ("opaque_ref", "args[0].x_refs[1]"), ("summary_ref", "args[0].a.b_ref"), ("summary_ref", "args[0].a.b_ref")]
    plan = plan_of(got, capsys)
    assert plan.count("MapInArrow") == 1


def test_causality_does_not_broadcast_nodes(load, capsys):
    events = load([record(1, 2, causality_kind="paired"), record(2, 2, parent_id="session-1:1", depth=3)])
    plan = plan_of(rules.causality(events), capsys)
    assert plan.count("SortMergeJoin") == 5 and "BroadcastHashJoin [trace_id" not in plan
    assert {"depth_step", "unclosed_call"} <= {r.rule for r in rules.causality(events).collect()}


def test_form_fields_are_not_broadcast(load, capsys):
    events = load([record(1, api="FormData.append", args=[{"value_kind": "string", "value": "v", "value_ref": "r"}])])
    got = rules.form_branches(events, rules.event_leaves(events))
    assert {r.path for r in got.collect()} == {"FormData.append:value_length"}
    anti = [line for line in plan_of(got, capsys).splitlines() if "LeftAnti" in line]
    assert anti and all("SortMergeJoin" in line for line in anti)


@pytest.mark.parametrize("args,ok", [
    ([{"input": "x"}], True), ([{"input": " "}], False), ([{"algorithm": "sha", "buffer_id": 1, "x_length": 3}], False), ([{"x_ref": "string:length:3"}], False),
    ([{"x_ref": "string_ref:3"}], True), ([{"x_preview": "abc"}], False), ([{"meta": {"type": "x", "n": 0}}], True), ([], False),
])
def test_family_evidence(load, args, ok):
    e = load([record(1, args=args)])
    got = named(rules.families(e, rules.event_leaves(e), (), evidence=True))
    assert got == (set() if ok else {"family_without_evidence"})


def test_family_errors(load):
    e = load([record(1, api="nothing")])
    assert named(rules.families(e, rules.event_leaves(e), ("base64",), evidence=True)) == {"family_not_observed", "no_family_events"}
    with pytest.raises(ValueError):
        rules.families(e, None, ("no such family",))


def test_arg_fields(spark, load):
    e = load([record(1, api="A", args=[{"deep": {"f": "x"}, "empty": ""}]), record(2, api="B", args=[{"a": {"f": "x"}, "f": None}])])
    specs = spark.createDataFrame(
        [("A", "f", "material"), ("A", "empty", "material"), ("A", "empty", "observed"), ("A", "gone", "observed"), ("B", "f", "material"), ("C", "f", "material"), ("C", "f", "observed")],
        "api STRING, field STRING, mode STRING",
    )
    got = {(r.rule, r.path) for r in rules.arg_fields(e, rules.event_leaves(e), specs).collect()}
    # In B the outer, empty field hides the inner one.
    assert got == {("field_material", "A:empty"), ("field_observed", "A:gone"), ("field_material", "B:f"), ("field_material", "C:f")}


def test_form_branches(load):
    e = load([
        record(1, api="FormData.append", args=[{"value": "v", "value_length": 1, "value_ref": "r"}]),
        record(2, api="FormData.set", args=[{"value_kind": "blob", "filename": "f"}]),
        record(3, api="FormData.get", args=[{"found": False}]), record(4, api="FormData.get", args=[{"found": True, "result_ref": "r"}]),
        record(5, api="FormData.getAll", args=[{"string_count": 1, "values": [], "result_value_lengths": [], "result_value_refs": []}]),
    ])
    got = {r.path for r in rules.form_branches(e, rules.event_leaves(e)).collect()}
    assert "FormData.set:blob_uuid_ref" in got and len([p for p in got if p.startswith("FormData.set")]) == 8
    assert got - {p for p in got if p.startswith("FormData.set")} == {"FormData.get:result_length"}


def test_parameter_materialisation(load):
    carrier = record(1, api="fetch", args=[{"url": "https://h/p?sig=1"}])
    shaped = record(2, api="URLSearchParams.set", args=[{"name": "sig", "value": "v", "value_ref": "string_ref:1"}])
    inner = record(3, api="String.prototype.concat", args=[{"result": "a&sig=1", "result_ref": "string_ref:2"}])
    bare = record(4, api="URLSearchParams.set", args=[{"name": "sig", "value": "v"}])

    def run(*rows):
        e = load(list(rows))
        return named(requests.parameter_materialisation(e, rules.event_leaves(e), ["sig"]))

    assert run(carrier, shaped) == set() and run(carrier, inner) == set()
    assert run(carrier, bare) == {"no_materialisation"} and run(shaped) == {"no_request_carrier"}


PATH = "/api/list/"
CONTRACT = requests.RequestContract(PATH, ("sig",), ("sig", "cursor"), ("x-token",), ("content-type",), ("accept",), ("content-type",))


def conforming():
    g, p = f"https://h{PATH}?sig=1", f"https://h{PATH}?sig=1&cursor=2"
    head = lambda *n: [{"name": x, "value": "v", "name_length": 1, "value_length": 1} for x in n]
    st = [{"function": "f", "url": "u", "line": 1, "column": 1}]
    ref = {"url_ref": "r", "method_ref": "r"}
    rows = [
        ("BrowserNetwork.request", {"method": "GET", "url": g, "headers": head("X-Token", "Accept"), "network_correlation_key": "k1"}),
        ("BrowserNetwork.request", {"method": "POST", "url": p, "headers": head("Content-Type", "accept"), "network_correlation_key": "k2", "upload_body": {"total_bytes": 3, "body_hex": "00"}}),
        ("Request.constructor", {"method": "GET", "url": g, **ref, "input_type": "s", "headers_id": "h1", "has_init": True, "has_body": False, "body_byte_length": 0, "network_correlation_key": "k1"}),
        ("Request.url.get", {"method": "GET", "url": g, **ref, "network_correlation_key": "k1"}),
        ("fetch", {"method": "GET", "url": g, **ref, "headers_id": "h1", "has_body": False, "body_byte_length": 0, "network_correlation_key": "k1"}),
        ("Request.headers.get", {"method": "GET", "url": g, **ref, "headers_id": "h1", "network_correlation_key": "k1"}),
        ("Headers.get", {"headers_id": "h1", "name": "x-token", "name_length": 7, "result": "v", "result_length": 1, "name_ref": "r", "result_ref": "r"}),
        ("Headers.get", {"headers_id": "h2", "name": "content-type", "name_length": 7, "result": "v", "result_length": 1, "name_ref": "r", "result_ref": "r"}),
        ("Headers.iterator.next", {"headers_id": "h2", "name": "content-type", "iteration_index": 0, "name_length": 7, "value": "v", "value_length": 1, "name_ref": "r", "value_ref": "r"}),
        ("Body.json", {"result": "{}", "result_length": 2, "result_ref": "r"}), ("Response.status.get", {"response_id": 1, "status": 200, "status_ref": "r"}),
        ("Response.url.get", {"response_id": 1, "url": g, "url_ref": "r"}), ("Response.headers.get", {"response_id": 1, "headers_id": "h2"}),
        ("URLSearchParams.set", {"name": "sig", "value": "1", "value_ref": "r"}), ("URLSearchParams.set", {"name": "cursor", "value": "2", "value_ref": "r"}),
        ("URL.search.set", {"href": g, "href_ref": "r", "value_ref": "r", "search_ref": "r"}), ("Headers.set", {"name": "X-Token", "value": "v", "value_ref": "r"}),
        ("XMLHttpRequest.setRequestHeader", {"name": "Content-Type", "value": "v", "value_ref": "r", "network_correlation_key": "k2"}),
        ("XMLHttpRequest.open", {"method": "POST", "url": p, **ref, "async": True, "network_correlation_key": "k2"}),
        ("XMLHttpRequest.send", {"method": "POST", "url": p, **ref, "xhr_id": 1, "network_correlation_key": "k2", "form_data_id": 1, "body_search_params_id": 1, "body_type": "t", "body_array_buffer_id": 1, "body_typed_array_id": 1, "body_byte_offset": 0, "body_size": 3, "body": "b", "body_ref": "r"}),
        ("XMLHttpRequest.responseText", {"url": p, **ref, "xhr_id": 1, "network_correlation_key": "k2", "status": 200, "value": "v", "value_length": 1, "value_ref": "r"}),
    ]
    return [record(i, api=a, args=[x], stack=st) for i, (a, x) in enumerate(rows, 1)]


def test_request_conformance(load):
    assert [r.path for r in requests.request_conformance(load(conforming()), CONTRACT).collect()] == []


@pytest.mark.parametrize("drop,label", [
    ("Request.constructor", "GET Request.constructor"), ("Body.json", "Body.json"), ("XMLHttpRequest.send", "POST send evidence"),
    ("URL.search.set", "URL.search.set refs"), ("Response.headers.get", "response Headers.get: content-type"), ("Headers.set", "fetch header refs: x-token"),
])
def test_request_conformance_reports(load, drop, label):
    rows = [r for r in conforming() if r["api"] != drop]
    assert label in {r.path for r in requests.request_conformance(load(rows), CONTRACT).collect()}


def test_report_verdict(load):
    e = load([record(1, global_seq=1), record(2, global_seq=1, args=[{"x_preview": "p"}])])
    found = report.check(e, report.strict(report.RuleSet(expected=("gone",)), generic=True))
    assert {"not_rising", "preview_field", "api_not_observed"} <= named(found)
    verdict = rules.verdicts(found, e).first()
    assert verdict.stage == rules.STAGES["global_seq"] and not verdict.passed
    good = load([record(1, args=[{"input": "x"}])])
    clean = report.check(good, report.strict(report.RuleSet(), generic=True))
    assert rules.verdicts(clean, good).first().passed
    assert report.expected_for("business-api", ["fetch", "x"])[-1] == "x"


def test_value_shape_walks_events_once(load, capsys):
    shape.event_value_shape(load([record(1)]), ["file_index"], ["sig"]).explain()
    plan = capsys.readouterr().out
    assert "/shape-leaves-" in plan and "MapInArrow" not in plan


def test_report_stores_leaves_as_columns(load, capsys):
    """Each rule reads the columns of the leaves that it needs, not whole rows of a checkpoint."""
    report.check(load([record(1)]), report.strict(report.RuleSet(), generic=True)).explain()
    plan = capsys.readouterr().out
    assert "/leaves-" in plan and "ExistingRDD[trace_id" not in plan


def test_spread_bounds_the_rows_of_a_task(spark):
    from traceframe.plans import driverviews

    few = spark.range(0, 100, 1, 2)
    assert driverviews.spread(few, 100).rdd.getNumPartitions() == 4
    assert driverviews.spread(few, 9 * driverviews.SPREAD_ROWS + 1).rdd.getNumPartitions() == 10


REF_ARGS = [
    [{"a_ref": "string_ref:1", "a": "raw"}, {"a_ref": "string_ref:2"}, {"b": 1, "b_refs": ["string_ref:3", "string_ref:4"]}],
    [{"a_ref": "string_ref:1", "a": {"preview": "raw"}}, {"c_ref": "string_ref:2", "c": {"d": {"e": "raw"}}}],
    [{"a_ref": "string:length:4", "f_ref": {"g_ref": "bytes_sha1:5"}, "h": "string_ref:6", "ref": "string_ref:7", "value": "string_ref:8"}],
    [{"f_ref": [{"g": ["string:length:9"], "g_ref": ["bytes_sha1:5"]}], "k_preview": {"k_ref": "string_ref:1", "k": "raw"}}],
    [{"m": {"n_ref": "string_ref:1", "o.n": "raw", "redacted": {"n": "raw"}}, "m.n": 3}, {"result_ref": "string_ref:2", "serialized": None, "result": []}],
]


def test_raw_members_speak_for_references_of_their_object_only(load, capsys):
    events = load([record(i, args=args) for i, args in enumerate(REF_ARGS)])
    rows = rules.material_refs(rules.event_leaves(events))
    number = events.select("file_index", F.get_json_object("raw", "$.seq").cast("int").alias("seq"))
    found = sorted((r.seq, r.rule, r.path) for r in rows.join(number, "file_index").collect())
    assert found == [
        (0, "opaque_ref", "args[1].a_ref"), (1, "opaque_ref", "args[0].a_ref"), (2, "opaque_ref", "args[0].ref"), (2, "summary_ref", "args[0].a_ref"),
        (3, "summary_ref", "args[0].f_ref[0].g[0]"), (4, "opaque_ref", "args[0].m.n_ref"), (4, "opaque_ref", "args[1].result_ref"),
    ]
    # Raw members of names that no reference asks for are left before they are sent.
    assert "LeftSemi" in plan_of(rows, capsys)
