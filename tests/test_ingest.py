import json

import pytest
from pyspark.sql import functions as F

from conftest import record
from traceframe.functions import nested
from traceframe.functions.order import with_order
from traceframe.sources import merge, ndjson, sinks
from traceframe.sources.assets import asset_keys, scan_assets, sha1_ref


def test_strict_scan_types_and_order(spark, write_trace):
    rows = [record(i, global_seq=True if i == 2 else i) for i in range(1, 6)]
    df = ndjson.scan_ndjson(spark, write_trace(["", *rows, "   "]))
    got = df.orderBy("file_index").select("seq", "global_seq", "truncated", "wall_time_us").collect()
    assert [r.seq for r in got] == [1, 2, 3, 4, 5]
    assert got[1].global_seq is None and got[0].global_seq == 1  # a boolean is no integer
    assert got[0].truncated is False


@pytest.mark.parametrize("bad", ['{"api": ', "[1]", "3"])
def test_strict_scan_fails(spark, write_trace, bad):
    with pytest.raises(Exception, match="line in|raise_error|malformed|not_object"):
        ndjson.scan_ndjson(spark, write_trace([record(1), bad])).collect()


def test_strict_scan_fails_whatever_is_read(spark, write_trace):
    path = write_trace([record(1), "", "{broken", record(2), "[1]"])
    events = ndjson.scan_ndjson(spark, path)
    for query in (events, events.groupBy("trace_id").count(), events.select("api")):
        with pytest.raises(Exception, match="malformed line in|not_object line in"):
            query.count() if query is events else query.collect()
    bad = ndjson.bad_lines(spark, path).orderBy("line_number").collect()
    assert [(r.line_number, r.status, r.line) for r in bad] == [(3, "malformed", "{broken"), (5, "not_object", "[1]")]


def test_empty_input_fails(spark, write_trace):
    with pytest.raises(ValueError, match="no events"):
        ndjson.scan_ndjson(spark, write_trace(["", " "]))


def test_quarantine_repairs_and_rejects(spark, write_trace):
    lost = '{"api":"a","x":"string:length:2""result":"$0"}'
    events, rejects = ndjson.scan_ndjson(spark, write_trace([record(1), lost, "{oops", "[1,2]"]), mode="quarantine")
    assert [r.api for r in events.orderBy("file_index").collect()] == ["TextEncoder.encode", "a"]
    assert [r.line for r in rejects.collect()] == ["{oops"]
    still_bad = '{"a":"1""result":2,'
    assert [r.line for r in ndjson.scan_ndjson(spark, write_trace([record(1), still_bad]), mode="quarantine")[1].collect()] == [still_bad]


def test_line_order_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.ndjson"
    path.write_text("\n".join(json.dumps({"seq": i, "pad": "x" * 200}) for i in range(3000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = ndjson.scan_ndjson(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        assert [r.seq for r in df.orderBy("file_index").select("seq").collect()] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_event_order_and_time(spark):
    df = spark.createDataFrame(
        [(5, 9, 100.0, None), (None, 9, None, 50.0), (None, None, None, None)],
        "file_index BIGINT, global_seq BIGINT, mono_time_us DOUBLE, ts DOUBLE",
    )
    got = [(r.event_order, r.event_time_us) for r in with_order(df).collect()]
    assert got == [(5.0, 100.0), (9.0, 50.0), (0.0, 0.0)]


def test_leaves(spark):
    value = {"args": [{"url": "u", "n": 1, "b": True, "e": {}, "x": None}], "a.b": {"k": [1.5, "s"]}}
    df = spark.createDataFrame([(1, json.dumps(value)), (2, "no json"), (3, '"top"')], "id INT, j STRING")
    got = nested.leaves(df, "j", ["id"]).orderBy("id", "leaf_no").collect()
    assert [(r.path, r.kind, r.text) for r in got if r.id == 1] == [
        ("args[0].url", "string", "u"), ("args[0].n", "integer", "1"), ("args[0].b", "boolean", "true"),
        ("args[0].e", "empty", None), ("args[0].x", "null", None), ("a.b.k[0]", "number", "1.5"), ("a.b.k[1]", "string", "s"),
    ]
    assert got[0]["keys"] == ["args", "url"] and got[0].containers == ["", "args[0]"] and got[0].tail == 0
    assert [r.path for r in got if r.id == 3] == [""]


def test_places_are_spelled_once(monkeypatch):
    """values of one shape share their places; only numbers and texts are made for each leaf."""
    spelled, real = [], nested._Place.spelled
    monkeypatch.setattr(nested._Place, "spelled", lambda self: spelled.append(real(self)) or spelled[-1])
    found = nested._Collector(None)
    for row in range(50):
        found.add(row, {"a": [{"é.x": row}, [], None], "": {"": True}})
    assert spelled == [
        ("a[0].é.x", ["a", "é.x"], ["", "a[0]"], 0, 3), ("a[1]", ["a"], [""], 1, 2), ("a[2]", ["a"], [""], 1, 2), ("", ["", ""], ["", ""], 0, 2),
    ]
    assert found.numbers == [0, 1, 2, 3] * 50 and found.texts[:8] == ["0", None, None, "true", "1", None, None, "true"]


def test_mined_leaves_limits(spark):
    deep = {"a": {"b": {"c": {"d": {"e": "too deep"}, "ok": "four levels"}}}, "s": "abc", "n": 12345}
    many = {f"k{i}": f"value-{i}" for i in range(50)}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(many)), (3, '"plain"')], "id INT, j STRING")
    got = nested.mined_leaves(df, "j", ["id"], per_value=32).collect()
    assert [(r.json_path, r.leaf) for r in got if r.id == 1] == [("a.b.c.ok", "four levels")]
    assert sorted(r.leaf_rank for r in got if r.id == 2) == list(range(32))
    assert nested.mined_leaves(df, "j", ["id"]).where("id = 2").count() == 50


def test_leaves_of_deep_values_and_many(spark, monkeypatch):
    deep = '{"k":[' * 30_000 + '"x", 1.5, {"a": null}' + "]}" * 30_000
    assert nested._parse(deep)["k"][0]["k"] and nested._parse('[{"a": [1, "b"], "c": {}}]') == [{"a": [1, "b"], "c": {}}]
    for broken in (deep[:-1], deep + "]", deep + "1"):
        with pytest.raises(ValueError):
            nested._parse(broken)
    nest = "[" * 4000 + '"x"' + "]" * 4000
    monkeypatch.setattr(nested, "OUT_ROWS", 3)
    df = spark.createDataFrame([(1, nest), (2, json.dumps(list(range(10)))), (3, "[1")], "id INT, j STRING")
    got = nested.leaves(df, "j", ["id"]).collect()
    assert [r.depth for r in got if r.id == 1] == [4000] and [r.text for r in got if r.id == 2] == [str(i) for i in range(10)]
    assert not [r for r in got if r.id == 3]


def _merge_inputs(spark, with_global=True):
    m0, w0 = 400_000_000_000.0, 1_783_000_000_000_000.0
    native = spark.createDataFrame(
        [("t", 0, "A", m0, w0, 1 if with_global else None), ("t", 1, "B", m0 + 100, w0 + 100, 2 if with_global else None)],
        "trace_id STRING, file_index BIGINT, api STRING, mono_time_us DOUBLE, wall_time_us DOUBLE, global_seq BIGINT",
    )
    injected = spark.createDataFrame(
        [("t", 0, "TextEncoder.encode", "inject", w0 + 50), ("t", 1, "no clock", "inject", None)],
        "trace_id STRING, file_index BIGINT, api STRING, category STRING, wall_time_us DOUBLE",
    )
    return native, injected, m0


def test_merge_appends_on_native_clock(spark):
    native, injected, m0 = _merge_inputs(spark)
    rows = merge.append_injected(native, injected).where("category = 'inject'").collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.mono_time_us == m0 + 50 and r.global_seq == 3 and r.seq == 1 and r.phase == "call"
    assert r.session_id.startswith("inject:") and r.event_id == f"{r.session_id}:1"


def test_merge_without_global_and_schema_two(spark):
    native, injected, _ = _merge_inputs(spark, with_global=False)
    r = merge.append_injected(native, injected, 2).where("category = 'inject'").first()
    assert r.global_seq is None and r.causality_kind == "external" and r.depth == 0 and r.call_id is None


def test_upper_median(spark):
    rows = [("t", float(i), 2e12) for i in (1, 2, 3, 4)]
    native = spark.createDataFrame(rows, "trace_id STRING, mono_time_us DOUBLE, wall_time_us DOUBLE")
    assert merge.clock_offsets(native).first().offset_us == 3 - 2e12


def test_assets(spark, tmp_path):
    import hashlib

    root = tmp_path / "run"
    (root / "assets").mkdir(parents=True)
    (root / "assets" / "b.js").write_text("line one\nline two")
    good = "sha1:" + hashlib.sha1(b"inline").hexdigest().upper()
    manifest = tmp_path / "manifest.ndjson"
    manifest.write_text("\n".join(json.dumps(r) for r in [
        {"asset_id": "a", "url": "https://x/a.js", "sha1": good, "source": "inline"},
        {"asset_id": "b", "url": "https://x/b.js", "sha1": "sha1:00", "content_path": "assets/b.js"},
        {"asset_id": "c", "url": "https://x/a.js", "content_path": "assets/none.js"},
    ]))
    rows = {r.asset_id: r for r in scan_assets(spark, str(manifest), str(root)).collect()}
    assert set(rows) == {"a", "b"}
    assert not rows["a"].source_unverified and rows["b"].source_unverified
    assert rows["b"].source == "line one\nline two"
    by_id, by_hash, by_url = asset_keys(scan_assets(spark, str(manifest), str(root)))
    assert {r.key for r in by_url.collect()} == {"https://x/a.js", "https://x/b.js"}
    manifest.write_text("{bad")
    assert scan_assets(spark, str(manifest), str(root), tolerant=True).first().bad_line == "{bad"


def test_sinks(spark, tmp_path):
    ops = spark.createDataFrame([(1, "a", ["x"]), (2, "b", [])], "i INT, api STRING, tags ARRAY<STRING>")
    out = sinks.write_ops(ops, str(tmp_path / "ops"))
    assert spark.read.parquet(out["parquet"]).count() == 2
    assert spark.read.option("header", "true").csv(out["csv"]).where("api = 'a'").first().tags == '["x"]'
    sinks.write_summary(ops.withColumn("_hidden", F.lit(1)), str(tmp_path / "sum"))
    assert "_hidden" not in spark.read.json(str(tmp_path / "sum" / "summary")).columns
