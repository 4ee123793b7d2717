import pytest
from conftest import with_families
from pyspark.sql import functions as F

from traceframe.functions import lookup, text
from traceframe.operators import profile, provenance, sequence

SCHEMA = (
    "trace_id STRING, session_id STRING, file_index BIGINT, seq BIGINT, mono_time_us BIGINT, api STRING, "
    "url STRING, function STRING, line BIGINT, column BIGINT, right BIGINT, left BIGINT, shift BIGINT"
)


def events(spark, rows):
    full = []
    for i, r in enumerate(rows):
        r = {"trace_id": "t", "session_id": "s", "file_index": i, "url": "u", "function": "f", "line": None, "column": 1, **r}
        r.setdefault("mono_time_us", r.get("seq", 0) * 100)
        full.append(tuple(r.get(c.split()[0]) for c in SCHEMA.split(", ")))
    return with_families(spark.createDataFrame(full, SCHEMA))


FOCUS = [
    {"api": a, "seq": s} for a, s in [
        ("Date.now", 1), ("String.prototype.slice", 2), ("Function.prototype.call", 100),
        ("Function.prototype.apply", 101), ("Reflect.apply", 102), ("Bitwise.xor", 103),
    ]
]


def test_focus_window(spark):
    r = profile.focus_by_session(events(spark, FOCUS), 350).first()
    assert (r.focus_seq, r.window_event_count, r.window_score) == (103, 4, 18)


def test_focus_ties_and_sessions(spark):
    rows = [
        {"api": "Bitwise.xor", "seq": 1}, {"api": "Bitwise.xor", "seq": 50}, {"api": "Bitwise.xor", "seq": 51, "mono_time_us": 5000},
        {"api": "Reflect.apply", "seq": 9, "session_id": "r"}, {"api": "Date.now", "seq": 10, "session_id": None},
    ]
    got = {r.session_id: r for r in profile.focus_by_session(events(spark, rows), 10).collect()}
    assert got["s"].focus_seq == 51 and got["s"].window_event_count == 2  # the last event of an instant completes it
    assert got["missing-session:4"].window_event_count == 1
    best = profile.focus_by_trace(profile.focus_by_session(events(spark, rows), 10)).first()
    assert best.session_id == "s"


def test_opcode_table(spark):
    rows, seq = [], 100
    for _ in range(4):
        for api, right, shift in (("Shift.left", 13, 13), ("Shift.unsignedRight", 19, 19), ("Bitwise.or", 4, None), ("Bitwise.xor", 255, None)):
            rows.append({"api": api, "seq": seq, "function": "mix", "column": 100, "right": right, "shift": shift, "left": 1})
            seq += 1
    for _ in range(3):
        rows.append({"api": "Function.prototype.call", "seq": seq, "function": "disp", "column": 200})
        seq += 1
    e = events(spark, rows)
    focus = profile.focus_by_trace(profile.focus_by_session(e, 100_000))
    inside = profile.window_events(e, focus, 100_000)
    table = {r.function: r for r in profile.opcode_table(inside, histograms=True).collect()}
    assert table["mix"].shape == "ARX_MIX" and table["mix"].opcode == 0 and table["disp"].shape == "DISPATCH"
    assert {13, 19, 255} <= {c.constant for c in table["mix"].constant_counts}
    assert 1 not in {c.constant for c in table["mix"].constant_counts}
    assert table["mix"].shape_basis == "rotate (shl|shr) + xor"
    labels = sequence.label_sequence(inside, profile.opcode_table(inside))
    pairs = {(r["from"], r["to"]): r["count"] for r in sequence.bigrams(labels, ["trace_id"], ["file_index"], "label").collect()}
    assert pairs == {("0:ARX_MIX", "0:ARX_MIX"): 15, ("0:ARX_MIX", "1:DISPATCH"): 1, ("1:DISPATCH", "1:DISPATCH"): 2}
    hot = profile.hotspots(inside, histograms=True).orderBy("rank").first()
    assert hot.function == "mix" and hot.score == 16 * 3 * 10 + 16 and hot.api_counts[0]["count"] == 4


@pytest.mark.parametrize("families,role", [
    (["dynamic_dispatch", "hash_crypto"], "dispatcher_candidate"), (["stack_probe", "typed_array"], "anti_debug_candidate"),
    (["byte_buffer", "base64"], "state_table_candidate"), (["random_source", "int_bitwise"], "crypto_mix_candidate"),
    (["hash_crypto"], "crypto_mix_candidate"), (["string_decode"], "decoder_candidate"),
    (["string_decode", "int_bitwise"], "handler_candidate"), (["array_table"], "handler_candidate"), (["async_flow"], "supporting_runtime_candidate"),
])
def test_site_role(spark, families, role):
    df = spark.createDataFrame([(families,)], "f ARRAY<STRING>")
    assert df.select(profile.site_role(F.col("f"))).first()[0] == role


def test_catalogue_is_used_by_operators(spark):
    events = spark.createDataFrame([("t", 1, "Reflect.get"), ("t", 2, "Own.call"), ("t", 3, "Own.call")], "trace_id STRING, file_index BIGINT, api STRING")
    listed = spark.createDataFrame([("Own.call", "int_bitwise"), ("Own.call", "int_bitwise")], "api STRING, family STRING")
    named = lookup.with_family(events, listed)
    assert sorted((r.file_index, r.family, r.weight) for r in named.collect()) == [(1, None, 0), (2, "int_bitwise", 3), (3, "int_bitwise", 3)]
    again = lookup.with_family(named)
    assert again.columns == named.columns and sorted(r.weight for r in again.collect()) == [0, 3, 3]


def test_families(spark):
    listed = {"btoa": "base64", "Function.prototype.call": "dynamic_dispatch", "DataView.getInt8": "byte_buffer", "Map": None}
    catalogue = spark.createDataFrame(list(listed.items()), "api STRING, family STRING")
    names = [*listed, "Function.prototype.notAnApi", "Function.prototype", "DataView", "fetch", None]
    df = spark.createDataFrame([(k,) for k in names], "api STRING")
    got = {r.api: (r.family, r.weight) for r in lookup.with_family(df, catalogue).collect()}
    weights = {"btoa": 1, "Function.prototype.call": 5, "DataView.getInt8": 3}
    assert got == {k: (listed.get(k), weights.get(k, 0)) for k in names}
    with pytest.raises(ValueError, match="catalogue"):
        lookup.with_family(df)


def test_catalogue_is_the_broadcast_side(spark):
    """Events of any estimate stay where they are: a list of unknown size is sent to them."""
    few = spark.range(10).selectExpr("CAST(id AS STRING) AS api")
    catalogue = spark.createDataFrame([("1", "base64")], "api STRING, family STRING")
    plan = lookup.with_family(few, catalogue).where("weight > 0")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan


def test_utf16_and_lines(spark):
    df = spark.createDataFrame([("a😀b", i) for i in range(6)], "s STRING, i BIGINT")
    got = [r[0] for r in df.select(text.utf16_index(F.col("s"), F.col("i"))).collect()]
    assert got == [0, 1, 1, 2, 3, 3]
    src = "ab\ncdé\n\nx"
    for at in range(len(src) + 2):
        df = spark.createDataFrame([(src, at)], "s STRING, i BIGINT")
        lc = df.select(text.line_column(F.col("s"), F.col("i")).alias("p")).first().p
        cut = src[: min(at, len(src))]
        assert (lc.line, lc.column) == (cut.count("\n") + 1, len(cut) - cut.rfind("\n") - 1)
        back = spark.createDataFrame([(src, lc.line, lc.column)], "s STRING, l BIGINT, c BIGINT")
        assert back.select(text.line_column_index(F.col("s"), F.col("l"), F.col("c"))).first()[0] == min(at, len(src))
    gone = spark.createDataFrame([(src, 9, 0)], "s STRING, l BIGINT, c BIGINT")
    assert gone.select(text.line_column_index(F.col("s"), F.col("l"), F.col("c"))).first()[0] is None


@pytest.mark.parametrize("ref,txt,number", [
    ("number:22.0", "22.0", 22.0), ("handler_arg:124/number:22.5", "22.5", 22.5), ("string_ref:abc", "abc", None), ("plain", "plain", None), ("x:", "x:", None),
])
def test_ref_literal(spark, ref, txt, number):
    df = spark.createDataFrame([(ref,)], "r STRING")
    got = df.select(text.ref_literal(F.col("r")).alias("l")).first().l
    assert (got.text, got.number) == (txt, number)


def test_registry_scopes(spark):
    cols = "trace_id STRING, file_index BIGINT, session_id STRING, isolate_id BIGINT, script_id BIGINT, script_url STRING, asset_id STRING, source_hash STRING, source_length BIGINT, seq BIGINT"
    rows = [
        ("t", 0, "s", 1, 7, None, None, None, 99, 1),       # names nothing: dropped with its length
        ("t", 1, "s", 1, 7, "one.js", None, None, None, 2),
        ("t", 2, "s", 2, 7, "two.js", None, None, 5, 3),
        ("t", 3, "s", 2, 7, "", "asset", None, None, 4),
        ("t", 4, "s", 1, 0, "zero.js", None, None, None, 5),
    ]
    reg = provenance.script_registry(spark.createDataFrame(rows, cols))
    by_isolate = {r.isolate_id: r for r in reg.collect()}
    assert by_isolate[1].source_length is None and by_isolate[1].seq == 2
    assert (by_isolate[2].script_url, by_isolate[2].asset_id, by_isolate[2].source_length) == ("two.js", "asset", 5)
    calls = spark.createDataFrame(
        [("t", "s", 1, 7, "a"), ("t", "s", 2, 7, "b"), ("t", "other", 5, 7, "c"), ("t", "s", 1, 8, "d")],
        "trace_id STRING, session_id STRING, isolate_id BIGINT, script_id BIGINT, name STRING",
    ).withColumn("callsite_mode", F.lit("dispatch_light"))
    got = {r.name: r for r in provenance.dispatch_callsites(calls, reg).collect()}
    assert (got["a"].resolved_url, got["b"].resolved_url, got["c"].resolved_url) == ("one.js", "two.js", "one.js")
    assert not got["d"].resolved


def test_locate_positions(spark):
    assets = spark.createDataFrame([(1, "var a;\nfunction q(){😀 return 1}")], "manifest_index BIGINT, source STRING")
    sites = spark.createDataFrame([(1, 20, 7), (1, 0, 7)], "manifest_index BIGINT, source_position BIGINT, function_start_position BIGINT")
    got = {r.source_position: (r.line, r.column, r.source_index) for r in provenance.locate_positions(sites, assets).collect()}
    assert got[0] == (2, 0, 7) and got[20] == (2, 13, 20)
