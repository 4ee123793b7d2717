"""Queries over containment, anchor evidence and derivations."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from traceframe.functions import text
from traceframe.operators import derive, evidence, lineage, profile
from traceframe.operators.containment import containment_pairs
from traceframe.plans import explain as explain_plan
from traceframe.plans.catalogue import query
from traceframe.plans.driverviews import FOCUS_WINDOW_US, V_EVENTS, spread, table, v_events
from traceframe.plans.nested_queries import LEAVES_SQL, _json_events
from traceframe.plans.profile_queries import FOCUS_SQL
from traceframe.session import stored

W = FOCUS_WINDOW_US


@query(
    "containment_match",
    """WITH n AS (SELECT trim(unnest(string_split(text, '.'))) AS needle FROM benchmark),
u AS (SELECT DISTINCT needle FROM n WHERE needle <> '')
SELECT d.doc_id, u.needle FROM documents d JOIN u ON contains(d.text, u.needle)""",
)
def containment_match(spark, d):
    b = table(spark, d, "benchmark")
    needles = b.select(F.explode(F.split("text", r"\.")).alias("needle")).select(F.trim("needle").alias("needle"))
    needles = needles.where("needle <> ''").distinct()
    needles = needles.withColumn("needle_id", F.col("needle"))
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))
    return containment_pairs(docs, needles, []).select(
        F.col("text_id").alias("doc_id"), F.col("needle_id").alias("needle")
    )


def _strings(spark, d):
    """Strings seen in each conversation: every turn whole, and its sentences."""
    c = table(spark, d, "conversations")
    anchor = F.col("conv_id").alias("anchor_id")
    at = F.col("turn").cast("double")
    order = F.col("turn") * 1000
    none = F.lit(None).cast("string")
    base = [F.concat(F.lit("app/"), "role").alias("script"), none.alias("function"), F.col("role").alias("category")]
    whole = c.select(anchor, order.alias("file_index"), at.alias("d_ms"), F.lit("JSON.stringify").alias("api"),
                     F.lit("value").alias("key"), F.col("text").alias("value"), *base)
    parts = c.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\.")).alias("i", "value"))
    parts = parts.select(anchor, (order + 1 + F.col("i")).alias("file_index"), at.alias("d_ms"), F.lit("StringAdd").alias("api"),
                         F.lit("left").alias("key"), "value", *base)
    return whole.unionByName(parts)


def _tokens(spark, d):
    """Every turn is a token of its conversation."""
    c = table(spark, d, "conversations")
    token = F.concat(F.lit("t"), F.col("turn").cast("string"))
    return c.select(F.col("conv_id").alias("anchor_id"), token.alias("token"), F.col("text").alias("value"))


STRINGS_SQL = """raw AS (
  SELECT conv_id AS a, turn * 1000 AS fi, turn AS d, 'JSON.stringify' AS api, role, text AS v FROM conversations
  UNION ALL SELECT conv_id, turn * 1000 + i, turn, 'StringAdd', role, parts[i] FROM (
    SELECT conv_id, turn, role, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT *, string_split(text, '.') AS parts FROM conversations))),
rows_ AS (SELECT a, api, v, count(*) AS n, min(d) AS d, arg_min(role, fi) AS role FROM raw WHERE length(v) >= 12 GROUP BY a, api, v),
f0 AS (SELECT conv_id AS a, 't' || CAST(turn AS VARCHAR) AS tok, string_split(text, '.') AS parts, text FROM conversations),
fields AS (SELECT a, CASE WHEN contains(text, '.') THEN tok || '.f' || CAST(i - 1 AS VARCHAR) ELSE tok END AS label,
    CASE WHEN contains(text, '.') THEN parts[i] ELSE text END AS fv
  FROM (SELECT a, tok, parts, text, unnest(range(1, len(parts) + 1)) AS i FROM f0)),
m0 AS (SELECT r.a, r.v, f.label, length(f.fv) AS fl, CASE WHEN r.v = f.fv THEN 0 WHEN contains(f.fv, r.v) THEN 1 ELSE 2 END AS k
  FROM (SELECT DISTINCT a, v FROM rows_) r JOIN fields f ON r.a = f.a AND f.fv <> '' AND (contains(f.fv, r.v) OR contains(r.v, f.fv))),
m AS (SELECT * FROM (SELECT *, min(k) OVER (PARTITION BY a, v) AS best FROM m0) WHERE k = best)"""


def _timeline(spark, d):
    fields = evidence.leaf_fields(_tokens(spark, d), ".")
    rows, matches = evidence.timeline(_strings(spark, d), fields)
    return rows, matches, fields


@query(
    "timeline_dedup",
    f"""WITH {STRINGS_SQL}, best AS (SELECT a, v, min(k) AS k, count(*) AS n, arg_min(label, fl * 100000 + CAST(substr(label || '.f0', 6) AS INTEGER) % 1) AS label FROM
    (SELECT a, v, k, fl, label FROM m) GROUP BY a, v)
SELECT r.a AS anchor_id, substr(sha256(r.v), 1, 8) AS value_sha, r.api, r.n AS count, CAST(r.d AS DOUBLE) AS d_ms, r.role AS category,
  CASE b.k WHEN 0 THEN 'equal' WHEN 1 THEN 'value_substring' WHEN 2 THEN 'field_substring' END AS token_match_kind,
  coalesce(b.n, 0) AS match_count,
  CASE WHEN b.k IS NOT NULL THEN 'output' WHEN r.api = 'JSON.stringify' THEN 'intermediate' ELSE 'intermediate' END AS role
FROM rows_ r LEFT JOIN best b ON r.a = b.a AND r.v = b.v""".replace(
        ", arg_min(label, fl * 100000 + CAST(substr(label || '.f0', 6) AS INTEGER) % 1) AS label", ""),
)
def timeline_dedup(spark, d):
    rows, _, _ = _timeline(spark, d)
    return rows.select(
        "anchor_id", "value_sha", "api", "count", "d_ms", "category", "token_match_kind", "match_count", "role"
    )


@query(
    "pairing",
    f"""WITH {STRINGS_SQL}, e AS (
  SELECT m.a, m.label, min(m.k) AS k, count(*) AS n, min(r.d) AS d FROM m JOIN rows_ r ON r.a = m.a AND r.v = m.v GROUP BY m.a, m.label)
SELECT f.a AS anchor_id, f.label, CASE e.k WHEN 0 THEN 'direct' WHEN 1 THEN 'composite' WHEN 2 THEN 'context_only' ELSE 'unpaired' END AS evidence,
  coalesce(e.n, 0) AS material_events, CAST(e.d AS DOUBLE) AS first_d_ms, length(f.fv) AS length
FROM fields f LEFT JOIN e ON f.a = e.a AND f.label = e.label""",
)
def pairing(spark, d):
    out = evidence.pairing(*_timeline(spark, d))
    return out.select("anchor_id", "label", "evidence", "material_events", "first_d_ms", "length")


@query(
    "artifact",
    f"""WITH RECURSIVE {STRINGS_SQL},
mat AS (SELECT m.a, m.label, r.api, r.d, substr(sha256(r.v), 1, 8) AS sha FROM m JOIN rows_ r ON r.a = m.a AND r.v = m.v),
g AS (SELECT a, label, count(*) AS materials, arg_min(sha, (d, sha, api)) AS first_sha FROM mat GROUP BY a, label),
ops AS (SELECT conv_id AS a, turn AS op, split_part(text, '.', 1) AS v FROM conversations),
e AS (SELECT x.a, x.op - 1 AS f, x.op AS t FROM ops x),
walk AS (SELECT fields.a, label, op AS node FROM fields JOIN ops ON ops.a = fields.a AND ops.v = fields.fv
  UNION SELECT walk.a, label, e.f FROM walk JOIN e ON e.a = walk.a AND e.t = walk.node),
s AS (SELECT walk.a, label, count(*) AS n FROM walk JOIN e ON e.a = walk.a AND e.t = walk.node GROUP BY 1, 2)
SELECT fields.a AS anchor_id, fields.label, CAST(least(coalesce(materials, 0), {explain_plan.POOL_ROWS}) AS INTEGER) AS materials, first_sha,
  coalesce(s.n, 0) AS subdag_edges
FROM fields LEFT JOIN g ON g.a = fields.a AND g.label = fields.label LEFT JOIN s ON s.a = fields.a AND s.label = fields.label""",
)
def artifact(spark, d):
    """Fields of every turn of a conversation; each turn's first sentence is made from the turn before."""
    rows, matches, fields = _timeline(spark, d)
    c = table(spark, d, "conversations")
    ref = lambda c: F.concat(F.lit("turn:"), c.cast("string"))
    member = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    members = F.array(
        member("left_ref", ref(F.col("turn") - 1)), member("result_ref", ref(F.col("turn"))),
        member("result", F.substring_index("text", ".", 1)),
    )
    refs = c.select(F.col("conv_id").alias("anchor_id"), F.col("turn").alias("op"), F.explode(members).alias("m"))
    edges, _, _, values = lineage.dag(refs.select("anchor_id", "op", "m.key", "m.value"), ["anchor_id"])
    named = fields.select("anchor_id", F.col("label").alias("field"), F.col("field_value").alias("value"))
    made = explain_plan.artifact({
        "materials_timeline": rows, "field_matches": matches, "pairing": evidence.pairing(rows, matches, fields),
        "field_subdag": lineage.field_subdag(named, values, edges, ["anchor_id"]),
    })
    first = F.col("materials")[0]["value_sha"]
    return made.select("anchor_id", "label", F.coalesce(F.size("materials"), F.lit(0)).alias("materials"), first.alias("first_sha"), "subdag_edges")


@query(
    "token_provenance",
    """WITH t AS (SELECT conv_id, text AS v FROM conversations
  WHERE (conv_id, turn) IN (SELECT conv_id, max(turn) FROM conversations GROUP BY conv_id))
SELECT t.conv_id AS anchor_id, CAST(min(c.turn) AS DOUBLE) AS earliest_d_ms FROM t LEFT JOIN conversations c
  ON c.conv_id = t.conv_id AND contains(c.text, t.v) AND t.v <> '' GROUP BY t.conv_id""",
)
def token_provenance(spark, d):
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    tokens = last.select(F.col("conv_id").alias("anchor_id"), F.lit("tok").alias("token"), F.col("t").alias("value"))
    strings = c.select(F.col("conv_id").alias("anchor_id"), F.col("turn").cast("double").alias("d_ms"), F.col("text").alias("value"))
    return evidence.token_visibility(strings, tokens).select("anchor_id", "earliest_d_ms")


PHASE_FN_SQL = """CASE user_id % 5 WHEN 0 THEN '_doFinal' WHEN 1 THEN 'parseHex' WHEN 2 THEN 'update'
  WHEN 3 THEN 'toBase64' ELSE 'other' END"""


def _anchored(spark, d):
    e = v_events(spark, d)
    focus = profile.focus_by_session(e, W)
    inside = profile.window_events(e, focus, W)
    m = F.col("user_id") % 5
    fn = F.when(m == 0, "_doFinal").when(m == 1, "parseHex").when(m == 2, "update").when(m == 3, "toBase64").otherwise("other")
    d_ms = F.bround((F.col("mono_time_us") - F.col("focus_time_us")) / 1000.0, 3)
    return inside.withColumn("anchor_id", F.col("session_id")).withColumn("function", fn).withColumn("d_ms", d_ms)


ANCHORED_SQL = f"""{V_EVENTS}, {FOCUS_SQL}, anch AS (
  SELECT e.session_id AS anchor_id, e.api, e.category, {PHASE_FN_SQL} AS fn,
    round((e.mono_time_us - f.focus_time_us) / 1000.0, 3) AS d_ms
  FROM v_events e JOIN session_focus f ON e.session_id = f.session_id
  WHERE e.mono_time_us BETWEEN f.focus_time_us - {W} AND f.focus_time_us)"""


@query(
    "phases",
    f"""WITH {ANCHORED_SQL}, p AS (SELECT *, CASE fn WHEN 'parseHex' THEN 'wordarray_in' WHEN '_doFinal' THEN 'block_cipher'
    WHEN 'update' THEN 'hash' WHEN 'toBase64' THEN 'encode_out' END AS phase FROM anch)
SELECT anchor_id, phase, min(d_ms) AS start_ms, max(d_ms) AS end_ms, count(*) AS ops, min(fn) AS functions
FROM p WHERE phase IS NOT NULL GROUP BY anchor_id, phase""",
)
def phases(spark, d):
    return evidence.phases(_anchored(spark, d)).withColumn("functions", F.array_join("functions", ","))


@query(
    "env_reads",
    f"""WITH {ANCHORED_SQL} SELECT anchor_id, api, count(*) AS count, min(d_ms) AS first_d_ms
FROM anch WHERE category = 'fingerprint' GROUP BY anchor_id, api""",
)
def env_reads(spark, d):
    return evidence.env_reads(_anchored(spark, d))


@query(
    "truncation_stats",
    """SELECT lang, CAST(count_if(strlen(text) > length(text)) AS BIGINT) AS truncated_events,
  max(strlen(text)) AS max_input_len FROM documents GROUP BY lang""",
)
def truncation_stats(spark, d):
    """The bytes of a text are the length it states, its characters what was captured."""
    docs = table(spark, d, "documents")
    none = F.lit(None)
    inputs = docs.select(
        "lang", F.octet_length("text").cast("bigint").alias("len"), F.col("text").alias("value"),
        none.cast("bigint").alias("byte_length"), none.cast("string").alias("hex"),
    )
    return evidence.truncation_stats(inputs, ["lang"])


@query(
    "candidate_pool",
    f"""WITH {V_EVENTS}, {LEAVES_SQL}, x AS (SELECT l.*, e.session_id FROM lv l JOIN v_events e ON l.file_index = e.file_index)
SELECT session_id, text AS value, min(file_index) AS first_order, true AS mined FROM x WHERE length(text) >= 4 GROUP BY session_id, text
UNION ALL SELECT session_id, '{{"name":"' || api || '","items":[{{"sid":"' || session_id || '"' || coalesce(',"k":' || CAST(rgt AS VARCHAR), '')
  || '}},{{"sid":"' || url || '","k":' || CAST(file_index AS VARCHAR) || '}}],"inner":{{"source":{{"fn":"' || fn || '"}},"phase":"call"}}}}', file_index, false FROM v_events""",
)
def candidate_pool(spark, d):
    sessions = v_events(spark, d).select("file_index", "session_id")
    inputs = _json_events(spark, d).join(sessions, "file_index").select("session_id", "file_index", F.col("j").alias("value"))
    pool = derive.candidate_pool(inputs, ["session_id"])
    return pool.select("session_id", "value", "first_order", F.col("leaf_of").isNotNull().alias("mined"))


DIGEST_SQL = """raw AS (
  SELECT doc_id, 'md5' AS algo, unhex(md5(text)) AS b FROM documents
  UNION ALL SELECT doc_id, 'sha1', unhex(sha1(text)) FROM documents
  UNION ALL SELECT doc_id, 'sha256', unhex(sha256(text)) FROM documents),
uni AS (
  SELECT doc_id, algo, 'hex_lower' AS encoding, lower(hex(b)) AS produced FROM raw
  UNION ALL SELECT doc_id, algo, 'hex_upper', upper(hex(b)) FROM raw
  UNION ALL SELECT doc_id, algo, 'base64', base64(b) FROM raw
  UNION ALL SELECT doc_id, algo, 'base64_nopad', rtrim(base64(b), '=') FROM raw
  UNION ALL SELECT doc_id, algo, 'base64url', translate(base64(b), '+/', '-_') FROM raw
  UNION ALL SELECT doc_id, algo, 'base64url_nopad', rtrim(translate(base64(b), '+/', '-_'), '=') FROM raw)"""


def _universe(spark, d, unfold=True):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    made = derive.universe(
        docs, ["doc_id"], "text", digests=("md5", "sha1", "sha256"), structures=("H(input)",), unfold=unfold
    )
    return made.where("algo NOT IN ('crc32', 'identity')")


@query(
    "digest_structures",
    """WITH d AS (SELECT doc_id, CAST(encode(text) AS BLOB) AS b FROM documents),
e AS (SELECT doc_id, 'hex_lower' AS pre, lower(hex(b)) AS t FROM d UNION ALL SELECT doc_id, 'hex_upper', hex(b) FROM d UNION ALL SELECT doc_id, 'base64', base64(b) FROM d
  UNION ALL SELECT doc_id, 'base64_nopad', rtrim(base64(b), '=') FROM d UNION ALL SELECT doc_id, 'base64url', translate(base64(b), '+/', '-_') FROM d
  UNION ALL SELECT doc_id, 'base64url_nopad', rtrim(translate(base64(b), '+/', '-_'), '=') FROM d),
h AS (SELECT doc_id, 'md5' AS h1, unhex(md5(b)) AS raw FROM d UNION ALL SELECT doc_id, 'sha1', unhex(sha1(b)) FROM d UNION ALL SELECT doc_id, 'sha256', unhex(sha256(b)) FROM d),
s AS (SELECT doc_id, 'H(enc(input))' AS structure, pre AS detail, encode(t) AS b FROM e
  UNION ALL SELECT doc_id, 'H2(H1(input))', h1 || ' digest', raw FROM h UNION ALL SELECT doc_id, 'H2(H1(input))', h1 || ' hex', encode(lower(hex(raw))) FROM h),
r AS (SELECT doc_id, structure, detail, 'md5' AS algo, unhex(md5(b)) AS b FROM s UNION ALL SELECT doc_id, structure, detail, 'sha1', unhex(sha1(b)) FROM s
  UNION ALL SELECT doc_id, structure, detail, 'sha256', unhex(sha256(b)) FROM s UNION ALL SELECT doc_id, 'H(input)', '', 'identity', b FROM d)
SELECT doc_id, structure, detail, algo, md5(string_agg(p, ' ' ORDER BY p)) AS produced FROM (
  SELECT doc_id, structure, detail, algo, unnest([lower(hex(b)), hex(b), base64(b), rtrim(base64(b), '='), translate(base64(b), '+/', '-_'),
    rtrim(translate(base64(b), '+/', '-_'), '=')]) AS p FROM r) GROUP BY 1, 2, 3, 4""",
)
def digest_structures(spark, d):
    """Digests of encoded values and of digests, and the encodings of values themselves; each one's six forms as one fingerprint."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    again = docs.groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again")
    is_again = docs["doc_id"].eqNullSafe(again["again"])
    return _fingerprints(spread(docs.join(again, is_again, "left_anti")), False).unionByName(
        _fingerprints(docs.join(again, is_again, "left_semi"), True)
    )


def _fingerprints(docs, gather):
    """The forms of a transform are made in one row and leave it as their fingerprint; with ``gather`` those of all rows of an id meet first."""
    made = derive.universe(docs, ["doc_id"], "text", digests=("md5", "sha1", "sha256"), unfold=False)
    made = made.where("structure <> 'H(input)' OR algo = 'identity'")
    detail = F.coalesce("pre_encoding", F.concat_ws(" ", "inner_algo", "inner_form"))
    made = made.select("doc_id", "structure", detail.alias("detail"), "algo", F.col("forms.produced").alias("forms"))
    if gather:
        made = made.groupBy("doc_id", "structure", "detail", "algo").agg(F.flatten(F.collect_list("forms")).alias("forms"))
    produced = F.md5(F.encode(F.array_join(F.sort_array("forms"), " "), "UTF-8"))
    return made.select("doc_id", "structure", "detail", "algo", produced.alias("produced"))


@query("digest_universe", f"WITH {DIGEST_SQL} SELECT doc_id, algo, encoding, produced FROM uni")
def digest_universe(spark, d):
    return _universe(spark, d).select("doc_id", "algo", "encoding", "produced")


#: How long a digest of so many bytes is in each encoding.
FORM_SQL = """f AS (SELECT 'hex_lower' AS encoding UNION ALL SELECT 'hex_upper' UNION ALL SELECT 'base64' UNION ALL SELECT 'base64_nopad'
  UNION ALL SELECT 'base64url' UNION ALL SELECT 'base64url_nopad'),
b AS (SELECT sum(strlen(text)) AS bytes, count(*) AS n, sum((strlen(text) + 2) // 3 * 4) AS b64, sum((strlen(text) * 4 + 2) // 3) AS bare FROM documents)"""
_CHAIN = ", ".join(f"('{a}', {hashlib.new(a).digest_size})" for a in derive.CHAIN_DIGESTS)
_ALL = ", ".join(f"('{a}', {hashlib.new(a).digest_size})" for a in derive.DIGESTS)
_LENGTH = "CASE WHEN encoding LIKE 'hex%' THEN 2 * size WHEN encoding LIKE '%nopad' THEN (4 * size + 2) // 3 ELSE (size + 2) // 3 * 4 END"


@query(
    "derivation_universe",
    f"""WITH {FORM_SQL}, c AS (SELECT * FROM (VALUES {_CHAIN}) t(algo, size)), a AS (SELECT * FROM (VALUES {_ALL}) t(algo, size)),
k AS (SELECT count(*) AS k FROM c),
m AS (SELECT 'H(input)' AS structure, algo, size, 1 AS times FROM a
  UNION ALL SELECT 'H(enc(input))', algo, size, 6 FROM c UNION ALL SELECT 'H2(H1(input))', algo, size, 2 * k FROM c, k),
rows_ AS (SELECT structure, algo, encoding, b.n * times AS n, b.n * times * ({_LENGTH}) AS chars FROM m, f, b
  UNION ALL SELECT 'H(input)', 'crc32', encoding, b.n, 8 * b.n FROM f, b WHERE encoding LIKE 'hex%'
  UNION ALL SELECT 'H(input)', 'identity', encoding, b.n, CASE WHEN encoding LIKE 'hex%' THEN 2 * bytes WHEN encoding LIKE '%nopad' THEN bare ELSE b64 END FROM f, b)
SELECT structure, algo, encoding, CAST(n AS BIGINT) AS n, CAST(chars AS BIGINT) AS chars FROM rows_""",
)
def derivation_universe(spark, d):
    """Number and total length of all single-input transforms, by structure and algorithm."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    made = derive.universe(docs, ["doc_id"], "text")
    return made.groupBy("structure", "algo", "encoding").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("produced")).alias("chars")
    )


TARGET_SQL = """targets AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) AS field,
    CASE WHEN doc_id % 20 = 0 THEN sha256(text) WHEN doc_id % 30 = 0 THEN substr(sha1(text), 9, 20)
    ELSE substr(sha256(text), 1, 16) END AS target FROM documents)"""
MATCH_SQL = """hits AS (SELECT t.field, t.target, u.doc_id, u.algo, u.encoding, u.produced,
    instr(u.produced, t.target) AS at_ FROM uni u JOIN targets t ON contains(u.produced, t.target)),
kinds AS (SELECT *, CASE WHEN produced = target THEN 'exact' WHEN at_ = 1 THEN 'prefix' ELSE 'substring' END AS match_kind FROM hits)"""


def _targets(spark, d):
    docs = table(spark, d, "documents")
    full = F.sha2("text", 256)
    target = (
        F.when(F.col("doc_id") % 20 == 0, full)
        .when(F.col("doc_id") % 30 == 0, F.substring(F.sha1("text"), 9, 20))
        .otherwise(F.substring(full, 1, 16))
    )
    return docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("field"), target.alias("target"))


@query(
    "derivation_match",
    f"WITH {DIGEST_SQL}, {TARGET_SQL}, {MATCH_SQL} SELECT field, doc_id, algo, encoding, match_kind FROM kinds",
)
def derivation_match(spark, d):
    hits = derive.match_derivations(_universe(spark, d), _targets(spark, d), [])
    return hits.select("field", "doc_id", "algo", "encoding", "match_kind")


@query(
    "spec_status",
    f"""WITH {DIGEST_SQL}, {TARGET_SQL}, {MATCH_SQL},
all_t AS (SELECT * FROM targets UNION ALL SELECT 'conv' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR),
  substr(sha256(text), 1, 24) FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY CASE match_kind WHEN 'exact' THEN 0 WHEN 'prefix' THEN 1 ELSE 2 END,
    algo, encoding, doc_id) AS rn, count(*) OVER (PARTITION BY field) AS n FROM kinds)
SELECT t.field, CASE WHEN r.field IS NULL THEN 'unresolved' ELSE 'derived' END AS status, coalesce(r.n, 0) AS derivation_count,
  CASE r.encoding WHEN 'hex_lower' THEN 'hex' WHEN 'hex_upper' THEN 'HEX' ELSE r.encoding END || '(' || r.algo || '(input))' ||
  CASE r.match_kind WHEN 'prefix' THEN '[:' || CAST(length(t.target) AS VARCHAR) || ']'
    WHEN 'substring' THEN '[' || CAST(r.at_ - 1 AS VARCHAR) || ':' || CAST(r.at_ - 1 + length(t.target) AS VARCHAR) || ']' ELSE '' END AS spec
FROM all_t t LEFT JOIN r ON r.field = t.field AND r.rn = 1""",
)
def spec_status(spark, d):
    c = table(spark, d, "conversations")
    other = c.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("field"),
        F.substring(F.sha2("text", 256), 1, 24).alias("target"),
    )
    targets = stored(_targets(spark, d), "targets")
    # Copies of a text give equal transforms and equal targets: each meets once, and the fields of a target get its hits.
    made = stored(derive.folded(_universe(spark, d, unfold=False), [], "doc_id"), "universe")
    asked = targets.select("target", F.col("target").alias("field")).where("target IS NOT NULL").distinct()
    hits = stored(derive.match_derivations(made, asked, []), "derivations")
    tie = ["algo", "encoding", "doc_id"]
    first = derive.rank_derivations(hits, [], tie).drop("field", "rank")
    ranked = derive.rank_derivations(first.join(targets, "target"), [], tie)
    times = hits.groupBy("target").agg(F.sum("copies").alias("n"))
    counts = targets.join(times, "target").groupBy("field").agg(F.sum("n").alias("derivation_count"))
    out = derive.field_status(targets.unionByName(other), ranked, counts, [])
    return out.select("field", "status", "derivation_count", "spec")


PAIR_SQL = """u AS (SELECT conv_id, text, min(turn) AS t FROM conversations WHERE text <> '' GROUP BY conv_id, text),
pool AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, text) AS rn FROM u),
tg AS (SELECT a.conv_id, substr(sha256(a.text || b.text), 5, 24) AS target FROM pool a JOIN pool b
  ON a.conv_id = b.conv_id AND a.rn = 1 AND b.rn = 2)"""


def _pair_case(spark, d, target):
    c = table(spark, d, "conversations")
    pool = derive.candidate_pool(c, ["conv_id"], "text", "turn").where("leaf_of IS NULL")
    ranked = profile.top_k(pool, ["conv_id"], 2, F.asc("first_order"), F.asc("value"))
    two = ranked.groupBy("conv_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("b")
    ).where("b IS NOT NULL")
    targets = two.select("conv_id", F.lit("sig").alias("field"), target.alias("target"))
    return pool, targets


@query(
    "concat_digest",
    f"""WITH {PAIR_SQL}
SELECT t.conv_id, t.target, substr(sha256(a.text), 1, 8) AS input_sha, substr(sha256(b.text), 1, 8) AS salt_sha
FROM tg t JOIN pool a ON a.conv_id = t.conv_id JOIN pool b ON b.conv_id = t.conv_id AND a.rn <> b.rn
WHERE contains(sha256(a.text || b.text), t.target)""",
)
def concat_digest(spark, d):
    pool, targets = _pair_case(spark, d, F.substring(F.sha2(F.concat("a", "b"), 256), 5, 24))
    hits = derive.pair_matches(pool, targets, ["conv_id"]).where("structure = 'H(a||b)'")
    # ``input`` is the left part of a concatenation, ``key_value`` the right one.
    return hits.select(
        "conv_id", "target", text.sha8(F.col("input")).alias("input_sha"), text.sha8(F.col("key_value")).alias("salt_sha")
    )


# SQL has no HMAC: the planted field of each conversation with two values has to be found, once.
@query(
    "hmac_match",
    """SELECT conv_id, 'sig' AS field, 'HMAC(key, msg)' AS structure, 'sha1' AS algo, 'hex_lower' AS encoding
FROM conversations WHERE text <> '' GROUP BY conv_id HAVING count(DISTINCT text) > 1""",
)
def hmac_match(spark, d):
    """Fields that are the HMAC-SHA1 of two turns, found among all pair transforms."""
    pool, targets = _pair_case(spark, d, derive.hmac_sha1_hex("a", "b"))
    hits = derive.pair_matches(pool, targets, ["conv_id"])
    return hits.select("conv_id", "field", "structure", "algo", "encoding")
