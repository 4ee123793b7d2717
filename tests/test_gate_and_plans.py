import io
import json
import random
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from conftest import record, with_families
from traceframe.operators import evidence, gate
from traceframe.plans import explain as plan
from traceframe.plans.summary import trace_summary
from traceframe.sources import requests as req
from traceframe.sources import sinks
from traceframe.sources.ndjson import scan_ndjson
from traceframe.streaming import live, tail


def net(i, url, api="BrowserNetwork.request", **arg):
    return record(i, api=api, category="network", args=[{"url": url, **arg}])


NOISE = [
    net(1, "https://www.example.test/", request_destination="document"), net(2, "https://cdn.example.test/runtime-sdk.js", request_destination="script"),
    net(3, "https://telemetry.example.test/monitor_browser/collect?batch=1", api="XMLHttpRequest.send"),
]
API = net(4, "https://www.example.test/api/items/?q=1")


def test_gate_vectors(spark, write_trace):
    counts = gate.endpoint_counts(gate.network_rows(scan_ndjson(spark, write_trace(NOISE))))
    g = gate.capture_gate(counts, start_url="https://www.example.test/").first()
    assert (g.status, g.observed_actionable_endpoint_count, g.missing) == ("pending", 0, ["business_api_anchor_not_captured"])
    assert g.target_endpoint_patterns == ["https://www.example.test/api/*", "fetch/XMLHttpRequest non-static endpoint"]
    assert [(x.resource_class, x.endpoint_count, x.event_count) for x in g.rejected] == [
        ("document_request", 1, 1), ("static_resource", 1, 1), ("telemetry_endpoint", 1, 1)]
    examples = {r.resource_class: r.examples for r in gate.rejected_endpoints(counts).collect()}
    assert examples["telemetry_endpoint"] == ["https://telemetry.example.test/monitor_browser/collect"]
    counts = gate.endpoint_counts(gate.network_rows(scan_ndjson(spark, write_trace([*NOISE, API, API]))))
    g = gate.capture_gate(counts).first()
    assert g.status == "passed" and g.matched_endpoints == ["https://www.example.test/api/items"]


@pytest.mark.parametrize("url", ["https://x.test/web/resource", "https://x.test/probe?x=1", "https://x.test/a/privacy_headers", "https://x.test/login"])
def test_gate_rejects(spark, write_trace, url):
    counts = gate.endpoint_counts(gate.network_rows(scan_ndjson(spark, write_trace([net(1, url)]))))
    assert gate.capture_gate(counts).first().status == "pending"


def test_streaming_gate_equals_batch(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()
    rows = [*NOISE, API, net(5, "https://www.example.test/api/other"), API]
    for n in range(3):
        (folder / f"part{n}.ndjson").write_text("\n".join(json.dumps(r) for r in rows[n * 2 : n * 2 + 2]) + "\n{bad line\n")
    seen = []

    def publish(state, batch_id):
        seen.append([tuple(r) for r in state.withColumn("trace_id", F.lit("t")).select("status", "observed_actionable_endpoint_count").collect()])

    tail = live.tail_ndjson(spark, str(folder))
    events = live.live_events(tail).withColumn("trace_id", F.lit("t"))
    query = live.start_gate(events, str(tmp_path / "cp"), publish, poll=None)
    query.awaitTermination()
    batch = gate.capture_gate(gate.endpoint_counts(gate.network_rows(scan_ndjson(spark, str(folder), mode="quarantine")[0].withColumn("trace_id", F.lit("t")))))
    want = [tuple(r) for r in batch.select("status", "observed_actionable_endpoint_count").collect()]
    assert seen[-1] == want == [("passed", 2)]


def test_tail_markers_and_progress(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()

    def drain():
        q = live.tail_ndjson(spark, str(folder)).select("line", "status").writeStream.option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
            lambda df, _: got.extend((r.status, r.line) for r in df.collect())).start()
        q.awaitTermination()

    got = []
    (folder / "a.ndjson").write_text('{"api":"a"}\n')
    drain()
    (folder / "b.ndjson").write_text('{"api":"b"}\nbroken\n')
    drain()
    assert sorted(got) == [("malformed", "broken"), ("ok", '{"api":"a"}'), ("ok", '{"api":"b"}')]


def test_files_that_grow_shrink_and_restart(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()
    got = []

    def drain():
        got.clear()
        q = live.tail_ndjson(spark, str(folder)).select("line", "status", "file_index").writeStream.option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
            lambda df, _: got.extend((r.line, r.file_index) for r in df.collect())).start()
        q.awaitTermination()
        return sorted(got)

    a = folder / "a.ndjson"
    a.write_text('{"n":1}\n{"n":')
    assert drain() == [('{"n":1}', 0)]  # the second line is not ended yet
    with a.open("a") as f:
        f.write('2}\n{"n":3}\n')
    (folder / "b.ndjson").write_text('{"n":9}\n')
    assert drain() == [('{"n":2}', 8), ('{"n":3}', 16), ('{"n":9}', 0)]
    assert drain() == []
    a.write_text('{"m":1}\n')  # smaller than before: written anew
    assert drain() == [('{"m":1}', 0)]


def test_ranges_of_a_file_hold_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BACK", 7)
    data = b"\n".join([b"x" * n for n in (0, 3, 50, 1, 0, 0, 20, 9)] + ["é".encode() * 9, b"rest"])
    whole = [(at, line) for at, line in tail.lines_between(io.BytesIO(data), 0, len(data))]
    assert [x for _, x in whole] == data.split(b"\n")[:-1]
    assert all(data[at : at + len(line)] == line for at, line in whole)
    for step in (1, 2, 5, 33, 1000):
        cuts = [(k, min(k + step, len(data))) for k in range(0, len(data), step)]
        assert [x for a, b in cuts for x in tail.lines_between(io.BytesIO(data), a, b)] == whole


def test_a_poll_can_be_bounded(tmp_path):
    for n in "ab":
        (tmp_path / n).write_text("x" * 9 + "\n")
    reader = tail.TailReader(str(tmp_path), 12)
    first = reader.latestOffset()
    assert sum(json.loads(first["files"]).values()) == 12
    second = reader.latestOffset()
    assert sum(json.loads(second["files"]).values()) == 20
    lines = [r for one, two in ((reader.initialOffset(), first), (first, second)) for p in reader.partitions(one, two) for b in reader.read(p) for r in b.to_pylist()]
    assert len(lines) == 2


def test_gate_rows_of_a_batch_are_its_changed_traces(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()
    batches = []

    def drain():
        events = live.live_events(live.tail_ndjson(spark, str(folder))).withColumn("trace_id", F.element_at(F.split("trace_id", "/"), -1))
        live.start_gate(events, str(tmp_path / "cp"), lambda df, _: batches.append({r.trace_id: r for r in df.collect()}), poll=None).awaitTermination()

    for n in range(3):
        (folder / f"t{n}").write_text("\n".join(json.dumps(r) for r in [*NOISE, API]) + "\n")
    drain()
    with (folder / "t1").open("a") as f:
        f.write("\n".join(json.dumps(r) for r in [API, net(7, "https://www.example.test/api/second"), *NOISE]) + "\n")
    drain()
    assert set(batches[0]) == {"t0", "t1", "t2"} and set(batches[-1]) == {"t1"}
    row = batches[-1]["t1"]
    assert row.matched_endpoints == ["https://www.example.test/api/items", "https://www.example.test/api/second"]
    assert [(x.resource_class, x.endpoint_count, x.event_count) for x in row.rejected] == [("document_request", 1, 2), ("static_resource", 1, 2), ("telemetry_endpoint", 1, 2)]


def test_replays_are_dropped(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()
    (folder / "a.ndjson").write_text("\n".join(json.dumps(record(i)) for i in (1, 2, 1)) + "\n")
    kept = []
    q = live.without_replays(live.live_events(live.tail_ndjson(spark, str(folder)))).select("event_id").writeStream.option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
        lambda df, _: kept.extend(r.event_id for r in df.collect())).start()
    q.awaitTermination()
    assert sorted(kept) == ["session-1:1", "session-1:2"]


TOKEN = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"  # sha256 of "test"


def burst_trace():
    rows = []
    for i in range(12):
        rows.append(record(i, api="Bitwise.xor", mono_time_us=1_000_000 + i * 1000, args=[{
            "left": i, "left_ref": f"number:{i}", "right": 2, "right_ref": "number:2", "result": i ^ 2, "result_ref": f"r{i}",
            "callsite_script": "https://cdn/sign.js", "callsite_function": "doFinal" if i % 2 else "parseHex"}]))
    rows.append(record(20, api="TextEncoder.encode", category="inject", mono_time_us=1_012_500, args=[{"value": "test material 1", "callsite_script": "https://cdn/sign.js"}]))
    rows.append(record(21, api="Navigator.platform", category="fingerprint", mono_time_us=1_012_600, args=[{"value": "MacIntel"}]))
    rows.append(record(22, api="SubtleCrypto.digest.ret", category="inject", mono_time_us=1_012_700, args=[{"hex": TOKEN}]))
    rows.append(record(30, api="BrowserNetwork.request", category="network", mono_time_us=1_013_000, args=[{"url": f"https://h/api?sig={TOKEN}&page=2", "method": "GET"}]))
    return rows


def test_explain_one_anchor(spark, write_trace, tmp_path):
    e = scan_ndjson(spark, write_trace(burst_trace()))
    tables = plan.explain(e, req.requests(e), None, 300_000)
    s = tables["summary"].first()
    assert s.signer_script == "https://cdn/sign.js" and s.window_ops == 13 and s.window_ops_all_scripts == 15
    assert (s.fields_total, s.direct_fields) == (1, 1)
    assert {r.phase for r in tables["phases"].collect()} == {"block_cipher", "wordarray_in", "emit"}
    assert [r.api for r in tables["env"].collect()] == ["Navigator.platform"]
    assert [r.full_value for r in tables["candidate_inputs"].collect()] == ["test material 1"]
    assert tables["dag_edges"].count() == 24
    art = plan.artifact(tables).first()
    assert art.evidence == "direct" and len(art.outputs) == 1 and art.materials == []
    status = plan.verify(tables, pair_values=24, digests=("md5", "sha1", "sha256")).first()
    assert status.status == "observed_output"
    paths = sinks.write_artefacts({k: tables[k] for k in ("tokens", "phases", "summary")}, str(tmp_path / "out"))
    assert spark.read.parquet(paths["tokens"]).first().token == "sig"


def test_window_scan_and_material(spark, write_trace):
    e = scan_ndjson(spark, write_trace(burst_trace()))
    ops, network, strings = req.window_scan(e, 1_011_000, 1_013_000)
    assert (ops.count(), network.count()) == (4, 1)
    assert {"test material 1", "MacIntel", TOKEN} <= {r.value for r in strings.collect()}
    assert req.compute_events(e).count() == 14  # encoder and digest calls compute as well
    assert req.material_events(e).count() == 1
    with pytest.raises(ValueError):
        req.compute_events(e, ("no such group",))


def test_trace_summary(spark, write_trace):
    e = with_families(scan_ndjson(spark, write_trace(burst_trace()))).withColumn("raw_args", F.to_json("args"))
    r = trace_summary(e, 15_000_000, markers=("sig",)).first()
    assert r.event_count == 16 and r.network_signed_url_count == 1 and not r.available
    assert "signed_url_reached_network" in r.conclusions and "no_focus" not in r.gaps
    bare = trace_summary(e, 15_000_000, generic=False).first()
    assert "no_targets_configured" in bare.gaps


def dense_trace(seed, seconds=40):
    """Operations of three scripts, strings and references around requests whose fields are equal to, inside, or around them."""
    rng = random.Random(seed)
    long = [f"material-{i:02d}-text" for i in range(6)]
    rows, t = [], 1_000_000
    for i in range(seconds * 5):
        t += rng.choice([0, 20_000, 300_000])
        name = f"https://cdn/{rng.choice('abc')}.js"
        if rng.random() < 0.25:
            sig = rng.choice([*long, "text", "material", f"<{long[0]}>", f"<{long[1]}|{long[2]}>"])
            other = rng.choice([long[0], long[3], "a", f"({long[4]})"])
            url = f"https://h/api?sig={quote(sig)}&token={quote(other)}"
            rows.append(record(i, api="BrowserNetwork.request", category="network", mono_time_us=t, args=[{"url": url, "method": "GET"}]))
            continue
        args = {"value": rng.choice([*long, "short", f"[{long[5]}]"]), "left_ref": f"r{rng.randrange(40)}", "right_ref": f"r{rng.randrange(40)}"}
        if rng.random() < 0.7:
            args["result_ref"] = f"r{rng.randrange(40)}"
        if rng.random() < 0.9:
            args["callsite_script"] = name
        rows.append(record(i, api=rng.choice(["Bitwise.xor", "Navigator.platform"]), mono_time_us=t, args=[args]))
    return rows


@pytest.mark.parametrize("script", ["auto", "https://cdn/a.js"])
def test_summary_is_that_of_the_tables(spark, write_trace, script):
    e = scan_ndjson(spark, write_trace(dense_trace(7, 24), "a.ndjson")).unionByName(scan_ndjson(spark, write_trace(dense_trace(8, 12), "b.ndjson"))).cache()
    tables = plan.explain(e, req.requests(e), "sig", 900_000, script=script)
    count = lambda name, column: tables[name].groupBy("anchor_id").agg(F.count(F.lit(1)).alias(column))
    want = tables["anchors"].select("anchor_id")
    for name, column in (("ops", "window_ops"), ("dag_edges", "dag_edges"), ("dag_inputs", "dag_inputs")):
        want = want.join(count(name, column), "anchor_id", "left")
    want = want.join(evidence.pairing_summary(tables["pairing"]), "anchor_id", "left")
    got = tables["summary"].select(*want.columns, "signer_script").collect()
    assert len(got) > 30
    assert sorted(tuple(r)[:-1] for r in got) == sorted(tuple(r) for r in want.collect())
    assert len({(r.direct_fields, r.composite_fields, r.context_only_fields) for r in got}) > 4
    if script == "auto":
        assert len({r.signer_script for r in got}) >= 3


def test_summary_joins_no_anchors_with_events(spark, write_trace, monkeypatch):
    e = scan_ndjson(spark, write_trace(burst_trace()))
    monkeypatch.setattr(plan, "window_join", lambda *a: pytest.fail("rows of anchors and events"))
    row = plan.explain(e, req.requests(e), "sig", 300_000)["summary"].first()
    assert (row.window_ops, row.window_ops_all_scripts, row.direct_fields, row.dag_edges, row.dag_inputs) == (13, 15, 1, 24, 12)
