import base64
import hashlib
import hmac
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceframe.operators import carriers, causal, containment, derive, diff, evidence, lineage
from traceframe.plans import evidence_queries, load_queries


@pytest.mark.parametrize("longest", [40, 5000])
def test_containment_equals_brute_force(spark, longest):
    rng = random.Random(longest)
    texts = {i: "".join(rng.choice("ab é😀\n") for _ in range(rng.choice([0, 3, 40, 700, 1400]))) for i in range(25)}
    needles = {}
    for j in range(60):
        t = texts[rng.randrange(25)]
        n = rng.choice([1, 2, 3, 5, 7, 8, 9, 20, 40])
        at = rng.randrange(len(t)) if t else 0
        needles[j] = t[at : at + n] if rng.random() < 0.8 else "ab" * n
    needles[99] = "x" * longest
    a = spark.createDataFrame([("k", i, t) for i, t in texts.items()], "k STRING, text_id INT, text STRING")
    b = spark.createDataFrame([("k", j, n) for j, n in needles.items()], "k STRING, needle_id INT, needle STRING")
    got = {(r.text_id, r.needle_id) for r in containment.containment_pairs(a, b, ["k"]).collect()}
    assert got == {(i, j) for i, t in texts.items() for j, n in needles.items() if n and n in t}


@pytest.mark.parametrize("block", [1, 7, 33, 1000])
def test_windows_do_not_depend_on_blocks(monkeypatch, block):
    """Every window of every text once, equal fingerprints for equal bytes under equal keys, wherever blocks are cut."""
    rng = random.Random(block)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 1, 40, 0, 3, 65, 32, 31)]
    keys = np.array([5, 5, 5, 5, 9, 9, 5, 5], np.uint64)
    offsets = np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(containment, "BLOCK", block)
    seen, prints = [], {}
    for size, rows, places, found in containment._prints(np.frombuffer(b"".join(texts), np.uint8), offsets, keys):
        for row, place, value in zip(rows.tolist(), places.tolist(), found.tolist()):
            seen.append((size, row, place))
            prints.setdefault((int(keys[row]), texts[row][place : place + size]), set()).add(value)
    assert sorted(seen) == sorted((n, i, k) for n in containment.SIZES for i, t in enumerate(texts) for k in range(len(t) - n + 1))
    assert all(len(v) == 1 for v in prints.values()) and len(set.union(*prints.values())) == len(prints)


def test_only_window_lengths_that_needles_use_are_made(spark):
    """F16: lengths that no needle uses are neither made nor counted; the others as if all were."""
    data, offsets, keys = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 2, np.uint8), np.array([0, 20, 52]), np.array([1, 2], np.uint64)
    every = {size: found.tolist() for size, _, _, found in containment._prints(data, offsets, keys)}
    assert {size: found.tolist() for size, _, _, found in containment._prints(data, offsets, keys, 4 + 16)} == {n: every[n] for n in (4, 16)}
    needles = spark.createDataFrame([("abcde",), ("x" * 20,), ("y" * 31,)], "n STRING")
    assert containment._asked_sizes(needles.select(F.encode("n", "UTF-8").alias("_data"))) == 4 + 16
    assert containment._asked_sizes(needles.where("n = ''").select(F.encode("n", "UTF-8").alias("_data"))) == 0


def test_containment_is_not_broadcast(spark, capsys):
    a = spark.createDataFrame([("k", 1, "some text")], "k STRING, text_id INT, text STRING")
    b = spark.createDataFrame([("k", 1, "text")], "k STRING, needle_id INT, needle STRING")
    capsys.readouterr()
    containment.containment_pairs(a, b, ["k"]).explain()
    plan = capsys.readouterr().out
    assert "BroadcastExchange" not in plan and "MapInArrow" in plan


def strings(spark, rows):
    full = [("a", i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "anchor_id STRING, file_index BIGINT, d_ms DOUBLE, api STRING, key STRING, value STRING").withColumns(
        {"category": F.lit("inject"), "function": F.lit("fn"), "script": F.lit("https://x/y/app.js")}
    )


def tokens(spark, value):
    return spark.createDataFrame([("a", "tok", value)], "anchor_id STRING, token STRING, value STRING")


def test_matches_are_searched_once(spark, capsys):
    """Rows and matches are stored: no reader of them searches or gathers the strings again."""
    s = strings(spark, [(-5.0, "StringAdd", "left", "field-zero-1234"), (-4.0, "StringAdd", "left", "a field-zero-1234 inside")])
    leaf = evidence.leaf_fields(tokens(spark, "field-zero-1234;none"), ";")
    rows, matches = evidence.timeline(s, leaf)
    capsys.readouterr()
    evidence.pairing(rows, matches, leaf).explain()
    rows.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    assert {(r.kind, r.label) for r in matches.collect()} == {("equal", "tok.f0"), ("field_substring", "tok.f0")}


def test_timeline_and_pairing(spark):
    value = "field-zero-1234;whole-material-xyz-tail;none"
    s = strings(spark, [
        (-5.0, "TextEncoder.encode", "input", "plain material text"), (-9.0, "TextEncoder.encode", "input", "plain material text"),
        (-3.0, "StringAdd", "left", "field-zero-1234"), (-2.0, "StringAdd", "left", "whole-material-xyz"),
        (-1.0, "StringAdd", "left", value), (-1.0, "StringAdd", "callsite_script", "field-zero-1234"), (-1.0, "StringAdd", "left", "short"),
    ])
    leaf = evidence.leaf_fields(tokens(spark, value), ";")
    rows, matches = evidence.timeline(s, leaf)
    got = {r.value: r for r in rows.collect()}
    assert len(got) == 4
    plain = got["plain material text"]
    assert (plain["count"], plain.d_ms, plain.role, plain.script) == (2, -9.0, "input", "app.js")
    assert got["field-zero-1234"].token_match_kind == "equal" and got["whole-material-xyz"].token_match_kind == "value_substring"
    assert got[value].token_match_kind == "field_substring" and got[value].match_count == 3
    paired = {r.label: r.evidence for r in evidence.pairing(rows, matches, leaf).collect()}
    assert paired == {"tok.f0": "direct", "tok.f1": "composite", "tok.f2": "context_only"}
    total = evidence.pairing_summary(evidence.pairing(rows, matches, leaf)).first()
    assert (total.fields_total, total.fields_paired, total.pairing_rate) == (3, 2, 0.667)


def test_a_value_is_searched_only_below_its_best_match(spark, monkeypatch):
    """values that equal a field are not searched in all fields, and a repeated label keeps its texts apart."""
    s = strings(spark, [
        (-1.0, "f", "x", "abcdefghijkl"), (-2.0, "f", "x", "abcdefghijkl and more"), (-3.0, "f", "x", "nothing like this"), (-4.0, "f", "x", "cdefghijklmn"),
    ])
    fields = spark.createDataFrame(
        [("a", "u", "abcdefghijkl"), ("a", "v", "abcdefghijkl"), ("a", "w", "cdefghijklmnop"), ("a", "w", "other"), ("a", "e", "")],
        "anchor_id STRING, label STRING, field_value STRING",
    )
    calls, real = [], evidence.containment_pairs

    def pairs(texts, needles, keys, text, needle, *ids):
        calls.append(({r[text] for r in texts.collect()}, {r[needle] for r in needles.collect()}))
        return real(texts, needles, keys, text, needle, *ids)

    monkeypatch.setattr(evidence, "containment_pairs", pairs)
    _, matches = evidence.timeline(s, fields)
    names = {r.value_sha: r.value for r in evidence.deduped_strings(s).collect()}
    assert sorted((names[r.value_sha], r.kind, r.label, r.field_len) for r in matches.collect()) == [
        ("abcdefghijkl", "equal", "u", 12), ("abcdefghijkl", "equal", "v", 12),
        ("abcdefghijkl and more", "field_substring", "u", 12), ("abcdefghijkl and more", "field_substring", "v", 12),
        ("cdefghijklmn", "value_substring", "w", 14),
    ]
    texts = {"abcdefghijkl", "cdefghijklmnop", "other"}
    assert calls == [
        (texts, {"abcdefghijkl and more", "nothing like this", "cdefghijklmn"}), ({"abcdefghijkl and more", "nothing like this"}, texts),
    ]


def test_phases(spark):
    names = ["WordArray.init", "_doProcessBlock", "finalize", "stringify", "other"]
    ops = spark.createDataFrame([("a", float(-i), n) for i, n in enumerate(names)], "anchor_id STRING, d_ms DOUBLE, function STRING")
    emit = spark.createDataFrame([("a", -0.5)], "anchor_id STRING, emit_d_ms DOUBLE")
    got = {r.phase for r in evidence.phases(ops, emit).collect()}
    assert got == {"wordarray_in", "block_cipher", "hash", "encode_out", "emit"}


def test_burst_and_rank(spark):
    compute = spark.createDataFrame([("t", i, float(1_000_000 + i * 100)) for i in range(12)], "trace_id STRING, file_index BIGINT, mono_time_us DOUBLE")
    token = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7"
    reqs = spark.createDataFrame(
        [("t", 1, 1_002_000.0, f"https://h/p?q={token}&page=2", "", None), ("t", 2, 9_000_000.0, "https://h/p", json.dumps({"a": {"k": token[::-1]}}), None),
         ("t", 3, 9_000_000.0, "https://h/p", "raw " + token.lower() + " body", [("X-Sign", "s")])],
        "trace_id STRING, file_index BIGINT, mono_time_us DOUBLE, url STRING, body STRING, headers ARRAY<STRUCT<name: STRING, value: STRING>>",
    )
    found = carriers.request_carriers(reqs, 4.0, ("x-sign",))
    assert {(r.name, r.where) for r in found.collect()} == {("q", "query"), ("body.a.k", "body"), (f"body:{token.lower()[:8]}", "body"), ("X-Sign", "header")}
    ranked = carriers.rank_carriers(carriers.with_burst(found, compute, 300_000))
    first = ranked.orderBy("rank").first()
    assert first.name == "q" and first.max_compute_burst == 12
    assert carriers.request_carriers(reqs.where("false")).count() == 0


def test_anchor_by_material(spark):
    cols = "trace_id STRING, file_index BIGINT, mono_time_us DOUBLE"
    anchors = spark.createDataFrame([("t", 1, 100.0), ("t", 2, 900.0), ("t", 3, 950.0)], cols)
    material = spark.createDataFrame([("t", 8, 850.0), ("t", 9, 880.0)], cols)
    r = carriers.anchor_by_material(anchors, material, 100, ["trace_id"]).first()
    assert (r.anchor_index, r.material_events) == (2, 2)


def _verify(spark, pool_rows, targets, **kw):
    pool = derive.candidate_pool(spark.createDataFrame([("a", i, v) for i, v in enumerate(pool_rows)], "anchor_id STRING, file_index BIGINT, value STRING"), ["anchor_id"])
    t = spark.createDataFrame([("a", n, v) for n, v in targets.items()], "anchor_id STRING, field STRING, target STRING")
    return {r.field: r for r in derive.verify_fields(pool, t, ["anchor_id"], **kw).collect()}


def test_derivations(spark):
    key, msg = "secret-key-value", "message to be signed"
    hexed = lambda b: b.hex()
    targets = {
        "plain": hashlib.sha256(msg.encode()).hexdigest(), "sha3": hashlib.sha3_256(msg.encode()).hexdigest()[:20],
        "blake": hashlib.blake2b(msg.encode()).hexdigest().upper(), "inner": hashlib.md5(msg.encode()).hexdigest()[4:20],
        "chain": hashlib.sha1(hashlib.md5(msg.encode()).digest()).hexdigest(), "enc": hashlib.md5(msg.encode().hex().encode()).hexdigest(),
        "mac": hexed(hmac.new(key.encode(), msg.encode(), "sha256").digest()), "concat": hashlib.sha1((key + msg).encode()).hexdigest(),
        "wrong": hexed(hmac.new(b"other key", msg.encode(), "sha256").digest()), "crc": "%08x" % __import__("zlib").crc32(msg.encode()), "short": "abc",
    }
    got = _verify(spark, [key, msg], targets, pair_values=24)
    assert {f for f, r in got.items() if r.status == "unresolved"} == {"wrong", "short"}
    assert got["plain"].spec == "hex(sha256(input))" and got["sha3"].spec == "hex(sha3_256(input))[:20]"
    assert got["inner"].spec == "hex(md5(input))[4:20]" and got["chain"].spec == "hex(sha1(md5(input)[digest]))"
    assert got["enc"].spec == "hex(md5(hex_lower(input)))" and got["mac"].spec == "hex(HMAC_sha256(key, msg))"
    assert {r.pair_values_left_out for r in got.values()} == {0}
    fewer = _verify(spark, [key, msg], {"mac": targets["mac"]}, pair_values=1)["mac"]
    assert (fewer.status, fewer.pair_values_left_out) == ("unresolved", 1)
    assert got["concat"].spec == "hex(sha1(input || salt))" and got["crc"].algo == "crc32"


def test_pairs_of_late_values(spark):
    values = [f"value number {i}" for i in range(70)] + ["0123456789abcdef"]
    aes = spark.range(1).select(F.lower(F.hex(F.aes_encrypt(F.lit(values[60].encode()), F.lit(values[70].encode()), F.lit("ECB"), F.lit("PKCS"))))).first()[0]
    targets = {
        "mac": hmac.new(values[69].encode(), values[30].encode(), "sha256").hexdigest(), "back": hmac.new(values[2].encode(), values[66].encode(), "md5").hexdigest(),
        "concat": hashlib.sha512((values[50] + values[49]).encode()).hexdigest()[8:40], "aes": aes, "self": hmac.new(values[5].encode(), values[5].encode(), "md5").hexdigest(),
    }
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "anchor_id STRING, first_order BIGINT, value STRING")
    asked = spark.createDataFrame([("a", n, v) for n, v in targets.items()], "anchor_id STRING, field STRING, target STRING")
    for block in (7, 64, 1000):
        got = sorted((r.field, r.structure, r.algo, r.key_value, r.input) for r in derive.pair_matches(rows, asked, ["anchor_id"], block=block).collect())
        assert got == [
            ("back", "HMAC(key, msg)", "md5", values[2], values[66]), ("concat", "H(a||b)", "sha512", values[49], values[50]),
            ("mac", "HMAC(key, msg)", "sha256", values[69], values[30]),
        ]
    hits = derive.match_derivations(derive.aes_pairs(rows, ["anchor_id"]), asked, ["anchor_id"])
    assert {(r.field, r.key_value, r.input) for r in hits.collect()} == {("aes", values[70], values[60])}
    got = _verify(spark, values, {k: targets[k] for k in ("mac", "self")})
    assert {f: (r.status, r.pair_values_left_out) for f, r in got.items()} == {"mac": ("derived", 0), "self": ("unresolved", 0)}


def test_derivation_from_json_leaves_and_outputs(spark):
    envelope = json.dumps({"key": "k-123456", "body": {"msg": "hello world"}})
    mac = hmac.new(b"k-123456", b"hello world", "sha1").hexdigest()
    outputs = spark.createDataFrame([("a", "xx" + "9" * 12 + "yy", "SubtleCrypto.sign.ret", -1.0, "sha")], "anchor_id STRING, value STRING, api STRING, d_ms DOUBLE, value_sha STRING")
    got = _verify(spark, [envelope], {"mac": mac, "seen": "9" * 12}, outputs=outputs, pair_values=24)
    assert got["mac"].status == "derived" and got["seen"].status == "observed_output" and got["seen"].edge.match_kind == "substring"


def test_aes_standard_vector(spark):
    # FIPS-197 appendix C.1 with the key written in hexadecimal.
    key, plain = "000102030405060708090a0b0c0d0e0f", bytes.fromhex("00112233445566778899aabbccddeeff")
    df = spark.range(1).select(F.hex(F.aes_encrypt(F.lit(bytearray(plain)), F.unhex(F.lit(key)), F.lit("ECB"), F.lit("PKCS"))).alias("c"))
    assert df.first().c[:32] == "69C4E0D86A7B0430D8CDB78070B4C55A"
    pool = spark.createDataFrame([("a", key), ("a", "sixteen byte msg")], "anchor_id STRING, value STRING")
    made = derive.aes_pairs(pool, ["anchor_id"])
    modes = {r.cipher_mode for r in made.collect()}
    assert {"ECB/hex128/pkcs7", "ECB/hex128/nopad", "CBC/hex128/pkcs7", "CBC/hex128/nopad"} <= modes
    size = {r.cipher_mode: len(r.produced) for r in made.where("encoding = 'hex_lower' AND input = 'sixteen byte msg'").collect()}
    assert size["CBC/hex128/pkcs7"] == 64 and size["ECB/hex128/nopad"] == 32


def test_dag_and_closure(spark):
    rows = [
        (1, "left_ref", "number:1"), (1, "left", "1"), (1, "result_ref", "r1"), (1, "result", "11"),
        (2, "left_ref", "r1"), (2, "right_source_ref", "string_ref:z"), (2, "result_ref", "r2"), (2, "result", "token"),
        (3, "left_ref", "lonely"), (4, "input_ref", "r2"), (4, "result_ref", "r2"),
    ]
    refs = spark.createDataFrame([("a", *r) for r in rows], "anchor_id STRING, op BIGINT, key STRING, value STRING")
    edges, producers, inputs, values = lineage.dag(refs, ["anchor_id"])
    assert {(r["from"], r["to"], r.role) for r in edges.collect()} == {("number:1", "r1", "left"), ("r1", "r2", "left"), ("string_ref:z", "r2", "right_source")}
    assert {r.ref for r in inputs.collect()} == {"number:1", "string_ref:z", "lonely"}
    assert {r.ref: r.op for r in producers.collect()} == {"r1": 1, "r2": 2}
    fields = spark.createDataFrame([("a", "sig", "token")], "anchor_id STRING, field STRING, value STRING")
    sub = lineage.field_subdag(fields, values, edges)
    assert {(r["from"], r["to"]) for r in sub.collect()} == {("number:1", "r1"), ("r1", "r2"), ("string_ref:z", "r2")}
    lit = {r.ref: r.value for r in lineage.ref_materials(inputs, values, ["anchor_id"]).collect()}
    assert lit == {"number:1": "1", "string_ref:z": "z", "lonely": "lonely"}


def test_inputs_and_values_gather_no_members(spark, capsys):
    """inputs need no list per operation; null references and results as the gathered members say."""
    rows = [
        (1, "left_ref", "p"), (1, "left", "5"), (1, "right_source_ref", None), (1, "result_ref", "o1"), (2, "left_ref", "o1"), (2, "left", None), (2, "result_ref", "o1"),
        (3, "left_ref", "p"), (3, "left", "1"), (3, "result_ref", None), (4, "left_ref", None), (4, "left_ref_ref", "q"), (5, "result_ref", "a"), (5, "result_ref", "b"),
        (6, "input_ref", "a"), (6, "result_register_ref", "z"), (0, "value", "7"), (0, "value_ref", "p"), (0, "left", "9"), (0, "left_ref", "p"), (0, "left_ref", "o"),
    ]
    refs = spark.createDataFrame([("t", *r) for r in rows], "trace_id STRING, op BIGINT, key STRING, value STRING").repartition(3)
    _, producers, inputs, values = lineage.dag(refs, ["trace_id"])
    capsys.readouterr()
    inputs.explain()
    assert "collect_list" not in capsys.readouterr().out
    assert sorted((r.ref for r in inputs.collect()), key=str) == [None, "a", "o", "p", "q"]
    assert {r.ref: r.op for r in producers.collect()} == {"o1": 1, "b": 5}
    assert {r.ref: r.value for r in values.collect()} == {"p": "9"}


def test_closure_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from STRING, to STRING")
    anchors = spark.createDataFrame([(1, "a")], "anchor_id INT, node STRING")
    assert {(r.node, r.hop) for r in lineage.closure(anchors, edges).collect()} == {("a", 0), ("c", 1), ("b", 2)}


def test_universe_equals_hashlib(spark):
    values = ["abc", "é😀" * 40, "x" * 300]
    made = derive.universe(spark.createDataFrame([(v,) for v in values], "value STRING"), ["value"]).collect()

    def forms(raw):
        b64 = base64.b64encode(raw).decode()
        url = b64.translate(str.maketrans("+/", "-_"))
        return dict(zip(derive.ENCODINGS, (raw.hex(), raw.hex().upper(), b64, b64.rstrip("="), url, url.rstrip("="))))

    h = lambda a, raw: hashlib.new(a, raw).digest()
    want = set()
    for v in values:
        raw = v.encode()
        out = [("H(input)", a, None, None, None, h(a, raw)) for a in derive.DIGESTS] + [("H(input)", "identity", None, None, None, raw)]
        out += [("H(enc(input))", a, pre, None, None, h(a, t.encode())) for pre, t in forms(raw).items() for a in derive.CHAIN_DIGESTS]
        for one in derive.CHAIN_DIGESTS:
            inner = h(one, raw)
            out += [("H2(H1(input))", a, None, one, f, h(a, x)) for f, x in (("digest", inner), ("hex", inner.hex().encode())) for a in derive.CHAIN_DIGESTS]
        want |= {(v, *x[:2], enc, *x[2:5], p) for x in out for enc, p in forms(x[5]).items()}
        crc = zlib.crc32(raw).to_bytes(4, "big").hex()
        want |= {(v, "H(input)", "crc32", n, None, None, None, p) for n, p in (("hex_lower", crc), ("hex_upper", crc.upper()))}
    got = {(r.value, r.structure, r.algo, r.encoding, r.pre_encoding, r.inner_algo, r.inner_form, r.produced) for r in made}
    assert got == want


def test_fingerprints_of_forms_are_made_in_place(spark, tmp_path, capsys):
    """forms of whole texts are not shuffled; those of an id that occurs again still meet."""
    rows = [(1, "x>?y"), (2, "a"), (2, "é>"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    capsys.readouterr()
    evidence_queries._fingerprints(docs, False).explain()
    assert "Exchange" not in capsys.readouterr().out
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = evidence_queries.digest_structures(spark, str(tmp_path)).collect()
    got = {r.doc_id: r.produced for r in made if r.algo == "identity"}

    def forms(text):
        raw = text.encode()
        b64 = [base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode()]
        return [raw.hex(), raw.hex().upper(), *b64, *[b.rstrip("=") for b in b64]]

    want = {i: hashlib.md5(" ".join(sorted(f for j, t in rows if j == i for f in forms(t))).encode()).hexdigest() for i in (1, 2, None)}
    assert got == want and len(made) == 3 * 37


def test_copies_meet_a_field_once(spark, tmp_path, monkeypatch):
    """F16: matches do not grow with the square of a text's copies, and every field still counts all of them."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, f"text {i % 3}") for i in range(1, 91)] + [(5, "again"), (95, None), (None, "no id"), (200, "")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(1, 1, "text 1"), (1, 2, None)]
    spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, text STRING").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    match, met = derive.match_derivations, []

    def counted(*args):
        out = match(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(derive, "match_derivations", counted)
    got = evidence_queries.spec_status(spark, str(tmp_path)).collect()
    assert met[0] < 100
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(load_queries()[1]["spec_status"]).fetchall()
    assert {tuple(r) for r in got} == set(want)


def test_a_long_chain_takes_few_rounds(spark):
    edges = spark.range(10_000).selectExpr("id as `from`", "id + 1 as `to`")
    anchors = spark.createDataFrame([(1, 10_000), (2, 3)], "anchor_id INT, node BIGINT")
    reached, rounds = lineage.reach(anchors, edges)
    assert rounds <= 15 and {(r.anchor_id, r.node, r.hop) for r in reached.collect()} == {(1, n, 10_000 - n) for n in range(10_001)} | {(2, n, 3 - n) for n in range(4)}


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_taken_out_get_the_same_hops(spark, seed):
    """chains, trees, cycles, side ways and null ends, with all lone nodes taken out or none."""
    rng = random.Random(seed)
    pairs = {(i, i + 1) for i in range(40) if i != 20} | {(100 + i, 100 + (i + 1) % 7) for i in range(7)}
    pairs |= {(200 + i, 200 + (i - 1) // 2) for i in range(1, 40)} | {(rng.randrange(45), rng.randrange(45)) for _ in range(6)} | {(5, 5)}
    pairs |= {(300 + i, 300 + (i + 1) % 5) for i in range(5)} | {(None, 30), (31, None), (None, 203)}
    anchors = [(1, 40), (2, 12), (2, 103), (3, 200), (3, 40), (4, 999)]
    into = {}
    for a, b in pairs:
        into.setdefault(b, set()).add(a)
    want = set()
    for anchor in {a for a, _ in anchors}:
        hops = {n: 0 for a, n in anchors if a == anchor}
        todo = list(hops)
        for node in todo:
            for new in into.get(node, ()) if node is not None else ():
                if new not in hops:
                    hops[new] = hops[node] + 1
                    todo.append(new)
        want |= {(anchor, n, h) for n, h in hops.items()}
    edges = spark.createDataFrame(sorted(pairs, key=str), "from BIGINT, to BIGINT")
    starts = spark.createDataFrame(anchors, "anchor_id INT, node BIGINT")
    for few in (0, 10, 1000):
        rows = lineage.reach(starts, edges, few=few)[0].collect()
        assert {(r.anchor_id, r.node, r.hop) for r in rows} == want and len(rows) == len(want)
    marks = lineage.shared_reach(starts.selectExpr("cast(anchor_id as bigint) as number", "node"), edges, few=0).collect()
    assert {(b, r.node) for r in marks for b in range(64) if r.bits >> b & 1} == {(a, n) for a, n, _ in want} and len(marks) == len({n for _, n, _ in want})


def test_a_long_chain_is_not_walked_whole_in_each_round(spark, monkeypatch):
    """the jumps of all rounds together are no more than the edges."""
    made, cut = [], lineage.cut_lineage

    def counted(df):
        made.append(df.count() if "_length" in df.columns else 0)
        return cut(df)

    monkeypatch.setattr(lineage, "cut_lineage", counted)
    edges = spark.range(3_000).selectExpr("id as `from`", "id + 1 as `to`")
    reached, _ = lineage.reach(spark.createDataFrame([(1, 3_000)], "anchor_id INT, node BIGINT"), edges, few=100)
    assert reached.count() == 3_001 and sum(made) < 3_000


def test_shared_reach_equals_plain_walks(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(110)}
    starts = [(n, rng.randrange(60)) for n in range(200)] + [(1 << 40, 5)]
    into = {t: {a for a, b in pairs if b == t} for t in range(60)}
    want = set()
    for number, node in starts:
        seen, todo = {node}, [node]
        while todo:
            new = into[todo.pop()] - seen
            seen |= new
            todo += new
        want |= {(number, x) for x in seen}
    marks = lineage.shared_reach(spark.createDataFrame(starts, "number BIGINT, node INT"), spark.createDataFrame(sorted(pairs), "from INT, to INT"))
    rows = marks.collect()
    assert len({(r.node, r.word) for r in rows}) == len(rows)
    assert {(64 * r.word + b, r.node) for r in rows for b in range(64) if r.bits >> b & 1} == want


def test_subdags_of_different_keys_stay_apart(spark):
    edges = spark.createDataFrame([("a", "x", "y", "left", 1), ("b", "z", "y", "left", 1)], "anchor_id STRING, from STRING, to STRING, role STRING, op BIGINT")
    values = spark.createDataFrame([("a", "y", "v"), ("b", "y", "v")], "anchor_id STRING, ref STRING, value STRING")
    fields = spark.createDataFrame([("a", "f", "v"), ("a", "g", "v")], "anchor_id STRING, field STRING, value STRING")
    got = lineage.field_subdag(fields, values, edges, ["anchor_id"]).collect()
    assert {(r.anchor_id, r.field, r["from"]) for r in got} == {("a", "f", "x"), ("a", "g", "x")}


def test_field_diff(spark):
    rows = [("g", 1, "tok", "aaaa;bbbb;cccc"), ("g", 2, "tok", "aaaa;bXbb;dddd"), ("g", 1, "gone", "x;y")]
    df = spark.createDataFrame(rows, "group_id STRING, run_id INT, token STRING, value STRING")
    assert [(r.i, r.same, r.hamming) for r in diff.field_diff(df, ";").orderBy("i").collect()] == [(0, True, None), (1, False, 1), (2, False, 4)]


def test_run_diff(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (1, "b"), (2, "c"), (2, "c")]
    got = {r.api: (r.min_count, r.max_count, r.constant) for r in diff.run_diff(spark.createDataFrame(rows, "run_id INT, api STRING")).collect()}
    assert got == {"a": (2, 2, True), "b": (0, 1, False), "c": (0, 2, False)}


def test_causality_summary_and_tree(spark):
    cols = "trace_id STRING, session_id STRING, file_index BIGINT, schema_version BIGINT, call_id STRING, parent_id STRING, depth BIGINT, causality_kind STRING, phase STRING, api STRING"
    rows = [
        ("t", "s", 0, 2, "s:1", None, 0, "paired", "call", "A"), ("t", "s", 1, 2, "s:2", "s:1", 1, "singleton", "get", "B"),
        ("t", "s", 2, 2, "s:1", None, 0, "paired", "return", "A"), ("t", "s", 3, 2, None, None, 0, "external", "call", "C"),
        ("u", "s", 0, 1, None, None, None, None, "call", "A"),
    ]
    e = spark.createDataFrame(rows, cols)
    got = {r.trace_id: r for r in causal.causality_summary(e).collect()}
    r = got["t"]
    assert (r.paired_activations, r.singleton_nodes, r.external_nodes, r.unclosed_count, r.max_depth, r.root_count) == (1, 1, 1, 0, 1, 1)
    assert not got["u"].available
    assert [(n.call_id, n.level) for n in causal.call_tree(e).orderBy("preorder").collect()] == [("s:1", 0), ("s:2", 1)]
    assert causal.call_tree(e, max_nodes=1).count() == 1


def test_call_tree_looks_below_kept_nodes_only(spark, capsys):
    """levels are stored one by one, and the first nodes in pre-order are those of the whole tree."""
    rng = random.Random(3)
    parents = {i: rng.choice([None, *range(max(0, i - 6), i)]) if i else None for i in range(60)}
    cols = "trace_id STRING, session_id STRING, file_index BIGINT, schema_version BIGINT, call_id STRING, parent_id STRING, depth BIGINT, causality_kind STRING, phase STRING, api STRING"
    rows = [("t", "s", i, 2, f"s:{i}", None if p is None else f"s:{p}", 0, "singleton", "call", "A") for i, p in parents.items()]
    tree = causal.call_tree(spark.createDataFrame(rows, cols), max_depth=3, max_nodes=11)
    path = lambda i: ((*path(parents[i]), i) if parents[i] is not None else (i,))
    want = sorted(p for p in map(path, parents) if len(p) <= 4)[:11]
    assert [tuple(r.path) for r in tree.orderBy("preorder").collect()] == want
    capsys.readouterr()
    tree.explain()
    assert "Join" not in capsys.readouterr().out
