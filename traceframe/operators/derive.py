"""Does a standard transform of an observed input give an observed output?

Nothing is guessed: every input, key and salt comes from the capture, and the result
only says which transform of which input equals, starts with or contains a field.
"""

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceframe.functions.nested import mined_leaves
from traceframe.operators.containment import containment_pairs
from traceframe.operators.profile import top_k

# --- fixed values -----------------------------------------------------------
DIGESTS = (
    "md5", "sha1", "sha224", "sha256", "sha384", "sha512", "sha3_256", "sha3_512", "blake2b", "blake2s",
)
CHAIN_DIGESTS = ("md5", "sha1", "sha256", "sha512")
ENCODINGS = ("hex_lower", "hex_upper", "base64", "base64_nopad", "base64url", "base64url_nopad")
ENCODING_NAMES = {"hex_lower": "hex", "hex_upper": "HEX"}
MIN_MATCH_LEN = 8
SHOWN_DERIVATIONS = 12
# --- end of fixed values ----------------------------------------------------

# Fields looked up beside one anchor's values at a time.
BATCH_TARGETS = 1024
# Values of one anchor in a block; a task combines two blocks.
BLOCK_VALUES = 64

_OUTSIDE_JVM = ("sha3_256", "sha3_512", "blake2b", "blake2s")


@F.pandas_udf(T.StringType())
def hmac_sha1_hex(key: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([hmac.new(k.encode(), m.encode(), hashlib.sha1).hexdigest() for k, m in zip(key, message)])


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _other_digests(values: pd.Series) -> pd.Series:
    """Digests Spark has no built-in for, in the order of ``_OUTSIDE_JVM``."""
    def one(v):
        raw = v.encode("utf-8", "surrogatepass") if v is not None else None
        return None if raw is None else [hashlib.new(a, raw).digest() for a in _OUTSIDE_JVM]

    return values.map(one)


def digest(algo: str, data: Column) -> Column:
    """Built-in digest of a BINARY value, as BINARY."""
    if algo == "md5":
        return F.unhex(F.md5(data))
    if algo == "sha1":
        return F.unhex(F.sha1(data))
    return F.unhex(F.sha2(data, int(algo[3:])))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The value as a column that is computed once: the generator keeps the planner from writing it again into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def base_forms(raw: Column) -> Column:
    """The two encodings of a BINARY value from which the others are made."""
    # The built-in may break lines after 76 characters.
    b64 = F.replace(F.replace(F.base64(raw), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    return F.struct(F.hex(raw).alias("hex"), b64.alias("b64"))


def _spelled(base: Column) -> tuple[Column, ...]:
    """All encodings, in the order of ``ENCODINGS``, of a value's base forms."""
    b64 = base["b64"]
    url = F.replace(F.replace(b64, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    return F.lower(base["hex"]), base["hex"], b64, F.rtrim(b64, F.lit("=")), url, F.rtrim(url, F.lit("="))


def _named_forms(base: Column, count: int = len(ENCODINGS)) -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("encoding"), f.alias("produced")) for n, f in list(zip(ENCODINGS, _spelled(base)))[:count]
    ])


def encodings(raw: Column) -> Column:
    """Array of (encoding, produced) of a BINARY value."""
    return _named_forms(base_forms(raw))


def candidate_pool(inputs: DataFrame, keys: list[str], value: str = "value", order: str = "file_index") -> DataFrame:
    """Distinct captured inputs, then string leaves mined from those that are JSON.

    Columns: keys, value, first_order, leaf_of (fingerprint of the envelope) and
    json_path; a leaf that was itself captured stays a captured input.
    """
    named = inputs.where(F.length(value) > 0).groupBy(*keys, F.col(value).alias("value")).agg(F.min(order).alias("first_order"))
    named = named.withColumn("envelope", F.substring(F.sha2(F.encode("value", "UTF-8"), 256), 1, 8))
    mined = mined_leaves(named.withColumn("_doc", F.col("value")), "_doc", [*keys, "first_order", "envelope"])
    leaves = mined.groupBy(*keys, F.col("leaf").alias("value")).agg(
        F.min(F.struct("first_order", "leaf_rank", "envelope", "json_path")).alias("m")
    ).select(
        *keys, "value", F.col("m.first_order").alias("first_order"),
        F.col("m.envelope").alias("leaf_of"), F.col("m.json_path").alias("json_path"),
    )
    fresh = leaves.join(named.select(*keys, "value"), [*keys, "value"], "left_anti")
    none = F.lit(None).cast("string")
    return named.select(*keys, "value", "first_order", none.alias("leaf_of"), none.alias("json_path")).unionByName(fresh)


def _made(structure: str, algo: str, raw: Column, pre: str | None = None, inner: str | None = None, form: str | None = None):
    text = lambda x: F.lit(x).cast("string")
    return F.struct(
        F.lit(structure).alias("structure"), F.lit(algo).alias("algo"), text(pre).alias("pre_encoding"),
        text(inner).alias("inner_algo"), text(form).alias("inner_form"), raw.alias("raw"),
    )


def universe(
    pool: DataFrame, keep: list[str], value: str = "value", digests: tuple[str, ...] = DIGESTS,
    structures: tuple[str, ...] = ("H(input)", "H(enc(input))", "H2(H1(input))"), unfold: bool = True,
) -> DataFrame:
    """Every single-input transform of each value, one row each.

    A value unfolds in its own task: first into the raw bytes of each transform, then
    into their encodings, so every digest is computed once and nothing is shuffled. Without ``unfold`` the encodings
    of a transform stay in its row, as the array ``forms``.
    """
    chain = [a for a in CHAIN_DIGESTS if a in digests]
    outside = [a for a in digests if a in _OUTSIDE_JVM]
    rows = _once(pool, "_data", F.encode(F.col(value), "UTF-8"))
    if outside:
        rows = rows.withColumn("_other", _other_digests(F.col(value)))
    if "H(enc(input))" in structures:
        rows = _once(rows, "_base", base_forms(F.col("_data")))
        rows = _once(rows, "_pre", F.array(*[F.encode(f, "UTF-8") for f in _spelled(F.col("_base"))]))
    if "H2(H1(input))" in structures:
        rows = _once(rows, "_first", F.array(*[digest(a, F.col("_data")) for a in chain]))
    made = []
    if "H(input)" in structures:
        for algo in digests:
            raw = F.col("_other")[_OUTSIDE_JVM.index(algo)] if algo in _OUTSIDE_JVM else digest(algo, F.col("_data"))
            made.append(_made("H(input)", algo, raw))
        crc = F.unhex(F.lpad(F.hex(F.crc32(F.col("_data"))), 8, "0"))
        made += [_made("H(input)", "crc32", crc), _made("H(input)", "identity", F.col("_data"))]
    if "H(enc(input))" in structures:
        for i, pre in enumerate(ENCODINGS):
            made += [_made("H(enc(input))", a, digest(a, F.col("_pre")[i]), pre=pre) for a in chain]
    if "H2(H1(input))" in structures:
        for i, first in enumerate(chain):
            hexed = F.encode(F.lower(F.hex(F.col("_first")[i])), "UTF-8")
            for form, inner in (("digest", F.col("_first")[i]), ("hex", hexed)):
                made += [_made("H2(H1(input))", a, digest(a, inner), inner=first, form=form) for a in chain]
    opened = rows.select(*keep, F.explode(F.array(*made)).alias("d")).select(*keep, "d.*")
    opened = _once(opened, "_base", base_forms(F.col("raw")))
    # A checksum is written in hexadecimal only.
    forms = F.when(F.col("algo") == "crc32", _named_forms(F.col("_base"), 2)).otherwise(_named_forms(F.col("_base")))
    named = [*keep, "structure", "algo", "pre_encoding", "inner_algo", "inner_form"]
    if not unfold:
        return opened.select(*named, forms.alias("forms"))
    return opened.withColumn("e", F.explode(forms)).select(
        *keep, "structure", "algo", "e.encoding", "pre_encoding", "inner_algo", "inner_form", "e.produced"
    )


def folded(made: DataFrame, keys: list[str], least: str) -> DataFrame:
    """Transforms that give the same, as one row each: of a universe that was not unfolded, unfolded here.

    ``least`` is the smallest of that column, ``copies`` how many values gave this. Copies of a value, however many, meet
    a field once.
    """
    by = [*keys, "structure", "algo", "pre_encoding", "inner_algo", "inner_form", "forms"]
    one = made.groupBy(*by).agg(F.min(least).alias(least), F.count(F.lit(1)).alias("copies"))
    return one.withColumn("e", F.explode("forms")).select(*by[:-1], "e.encoding", "e.produced", least, "copies")


def match_kind(target: Column, produced: Column) -> Column:
    """exact, prefix or substring; the last two need a target of eight characters."""
    at = F.instr(produced, target)
    long = F.length(target) >= MIN_MATCH_LEN
    return (
        F.when((target == "") | (produced == ""), F.lit(None))
        .when(target == produced, "exact").when(long & (at == 1), "prefix").when(long & (at > 1), "substring")
    )


def match_derivations(produced: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Join a universe with the fields it reproduces.

    ``targets``: keys, field, target. Short targets meet by equality; longer ones
    through shared grams, which finds equal, leading and inner slices alike.
    """
    short = targets.where(F.length("target") < MIN_MATCH_LEN).withColumn("produced", F.col("target"))
    whole = produced.join(short, [*keys, "produced"])
    distinct = produced.select(*keys, "produced").distinct().withColumn("text_id", F.col("produced"))
    named = targets.where(F.length("target") >= MIN_MATCH_LEN).select(
        *keys, F.col("target").alias("needle"), F.col("target").alias("needle_id")
    ).distinct()
    pairs = containment_pairs(distinct.withColumnRenamed("produced", "text"), named, keys).select(
        *keys, F.col("text_id").alias("produced"), F.col("needle_id").alias("target")
    )
    sliced = produced.join(pairs, [*keys, "produced"]).join(targets, [*keys, "target"])
    out = sliced.unionByName(whole)
    at = F.instr("produced", F.col("target")).cast("bigint") - 1
    return out.withColumn("match_kind", match_kind(F.col("target"), F.col("produced"))).withColumn(
        "slice_start", at
    ).withColumn("slice_end", at + F.length("target"))


def aes_pairs(pool: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Encryptions of observed texts under observed keys of the same anchor.

    Only values that are a key (16, 24 or 32 bytes, or that many in hex) act as one.
    """
    v = F.col(value)
    size = F.octet_length(v)
    utf8 = F.when(size.isin(16, 24, 32), F.struct(
        F.concat(F.lit("utf8"), (size * 8).cast("string")).alias("name"), F.encode(v, "UTF-8").alias("key")))
    hexed = F.when(F.length(v).isin(32, 48, 64) & v.rlike("^[0-9A-Fa-f]+$"), F.struct(
        F.concat(F.lit("hex"), (F.length(v) * 4).cast("string")).alias("name"), F.unhex(v).alias("key")))
    keyed = pool.select(*keys, v.alias("key_value"), F.explode(F.array_compact(F.array(utf8, hexed))).alias("k"))
    # The values that a key meets are dealt into blocks, so one anchor's pairs do not share a task.
    inputs = _blocks(pool.select(*keys, v.alias("value")), keys, BLOCK_VALUES).withColumnRenamed("value", "input")
    keyed = keyed.join(inputs.select(*keys, "_block").distinct(), keys)
    pairs = keyed.join(inputs.drop("_blocks"), [*keys, "_block"]).where("key_value <> input")
    msg = F.encode("input", "UTF-8")
    blocks = (F.octet_length(msg) % 16 == 0) & (F.octet_length(msg) > 0)
    ecb = F.aes_encrypt(msg, F.col("k.key"), F.lit("ECB"), F.lit("PKCS"))
    cbc = F.aes_encrypt(msg, F.col("k.key"), F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit("00" * 16)))
    cbc = F.substr(cbc, F.lit(17), F.octet_length(cbc))  # the built-in puts the IV first
    mode = lambda name, pad: F.concat(F.lit(name + "/"), F.col("k.name"), F.lit("/" + pad))
    variants = []
    for name, out in (("ECB", ecb), ("CBC", cbc)):
        variants.append(F.struct(mode(name, "pkcs7").alias("mode"), out.alias("raw")))
        cut = F.substr(out, F.lit(1), F.octet_length(msg))
        variants.append(F.when(blocks, F.struct(mode(name, "nopad").alias("mode"), cut.alias("raw"))))
    opened = pairs.select(*keys, "key_value", "input", F.explode(F.array_compact(F.array(*variants))).alias("x"))
    return opened.select(
        *keys, "key_value", "input", F.lit("AES(key, msg)").alias("structure"), F.lit("aes").alias("algo"),
        F.col("x.mode").alias("cipher_mode"), F.explode(encodings(F.col("x.raw"))).alias("e"),
    ).select(*keys, "key_value", "input", "structure", "algo", "cipher_mode", "e.encoding", "e.produced")


def _forms(raw: bytes):
    b64 = base64.b64encode(raw).decode("ascii")
    url = b64.replace("+", "-").replace("/", "_")
    return zip(ENCODINGS, (raw.hex(), raw.hex().upper(), b64, b64.rstrip("="), url, url.rstrip("=")))


def _pair_digests(a: bytes, b: bytes):
    made = [("HMAC(key, msg)", n, hmac.digest(a, b, n)) for n in DIGESTS]
    return made + [("H(a||b)", n, hashlib.new(n, a + b).digest()) for n in CHAIN_DIGESTS]


def _blocks(pool: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The pool with each anchor's number of blocks of about ``size`` values, and the block of each value."""
    sizes = pool.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))
    return pool.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64("value"), F.col("_blocks")).cast("int"))


def pair_matches(
    pool: DataFrame, targets: DataFrame, keys: list[str], pair_values: int | None = None, order: str = "first_order",
    block: int = BLOCK_VALUES,
) -> DataFrame:
    """HMAC(key, msg) and H(a||b) over all ordered pairs of each anchor's values, matches only.

    Pairs grow with the square of the values. A caller may name a bound, ``pair_values``, on the
    values by ``order``; ``pairs_left_out`` counts what then stays outside. Each anchor's values
    are dealt into blocks, and a row holds two blocks and a batch of fields, combined
    inside a task; only combinations that reproduce a field leave it.
    """
    picked = pool.select(*keys, "value", order).where("value IS NOT NULL")
    if pair_values is not None:
        picked = top_k(picked, keys, pair_values, F.asc(order), F.asc("value"))
    dealt = _blocks(picked.select(*keys, "value"), keys, block)
    sets = dealt.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list("value")).alias("values"), F.first("_blocks").alias("_blocks"))
    # An anchor's fields are dealt over as many rows as they need, so a row stays small
    # and an anchor of few fields makes its digests once.
    distinct = targets.select(*keys, "target").where("target <> ''").distinct()
    sizes = distinct.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BATCH_TARGETS).alias("_batches"))
    batch = F.pmod(F.xxhash64("target"), F.col("_batches"))
    wanted = distinct.join(sizes, keys).groupBy(*keys, batch.alias("_batch")).agg(F.collect_list("target").alias("targets"))
    left = sets.withColumn("_other", F.explode(F.sequence("_block", F.col("_blocks") - 1))).drop("_blocks")
    right = sets.select(*keys, F.col("_block").alias("_other"), F.col("values").alias("others"))
    rows = left.join(right, [*keys, "_other"]).join(wanted, keys)
    # By a number, so that rows, small beside their work, are not gathered in a few tasks again.
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys, "_block", "_other", "_batch")
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType(fields + [
        T.StructField(n, T.StringType())
        for n in ("structure", "algo", "encoding", "produced", "key_value", "input", "target")
    ])

    def hits(first, second, asked):
        a, b = first.encode("utf-8", "surrogatepass"), second.encode("utf-8", "surrogatepass")
        made = [(s, n, list(_forms(raw))) for s, n, raw in _pair_digests(a, b)]
        # One look at all forms at once; which form it was is asked only after a hit.
        everything = "\n".join([produced for _, _, forms in made for _, produced in forms])
        for target in asked:
            if target not in everything:
                continue
            for structure, algo, forms in made:
                # Concatenation names the left part input and the right part salt.
                named = (first, second) if structure.startswith("HM") else (second, first)
                for encoding, produced in forms:
                    if target in produced:
                        yield (structure, algo, encoding, produced, *named, target)

    def search(batches):
        for pdf in batches:
            found = []
            for rec in pdf.to_dict("records"):
                own = [rec[k] for k in keys]
                same = rec["_block"] == rec["_other"]
                # Every form is longer than a target that may only match as a whole.
                asked = [t for t in rec["targets"] if len(t) >= MIN_MATCH_LEN]
                for i, a in enumerate(rec["values"] if asked else ()):
                    for j, b in enumerate(rec["others"]):
                        if same and i == j:
                            continue
                        found += [(*own, *hit) for hit in hits(a, b, asked)]
                        if not same:
                            found += [(*own, *hit) for hit in hits(b, a, asked)]
            yield pd.DataFrame(found, columns=schema.fieldNames())

    return rows.mapInPandas(search, schema).join(targets, [*keys, "target"])


def pairs_left_out(pool: DataFrame, keys: list[str], pair_values: int | None) -> DataFrame:
    """Per anchor: the values that ``pair_matches`` of the same bound does not combine."""
    left = F.greatest(F.count(F.lit(1)) - pair_values, F.lit(0)) if pair_values is not None else F.lit(0)
    return pool.groupBy(*keys).agg(left.cast("bigint").alias("pair_values_left_out"))


def derivation_expr(df: DataFrame) -> Column:
    """Readable form of a match, such as ``hex(sha256(input))[:16]``."""
    have = set(df.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    algo, st = F.col("algo"), F.col("structure")
    enc = F.coalesce(
        F.create_map(*[F.lit(x) for kv in ENCODING_NAMES.items() for x in kv])[F.col("encoding")], F.col("encoding")
    )
    core = (
        F.when(st == "HMAC(key, msg)", F.concat(F.lit("HMAC_"), algo, F.lit("(key, msg)")))
        .when(st == "AES(key, msg)", F.concat(F.lit("AES-"), F.substring_index(col("cipher_mode"), "/", 1), F.lit("(key, msg)")))
        .when(st == "H(a||b)", F.concat(algo, F.lit("(input || salt)")))
        .when(st == "H(enc(input))", F.concat(algo, F.lit("("), col("pre_encoding"), F.lit("(input))")))
        .when(st == "H2(H1(input))", F.concat(algo, F.lit("("), col("inner_algo"), F.lit("(input)["), col("inner_form"), F.lit("])")))
        .when(algo == "identity", F.lit("input"))
        .otherwise(F.concat(algo, F.lit("(input)")))
    )
    cut = (
        F.when(F.col("match_kind") == "prefix", F.concat(F.lit("[:"), F.col("slice_end").cast("string"), F.lit("]")))
        .when(F.col("match_kind") == "substring", F.concat(
            F.lit("["), F.col("slice_start").cast("string"), F.lit(":"), F.col("slice_end").cast("string"), F.lit("]")))
        .otherwise("")
    )
    return F.concat(enc, F.lit("("), core, F.lit(")"), cut)


def rank_derivations(matches: DataFrame, keys: list[str], tie: list[str], k: int = SHOWN_DERIVATIONS) -> DataFrame:
    """First k derivations per field: exact before prefix before substring."""
    rank = F.when(F.col("match_kind") == "exact", 0).when(F.col("match_kind") == "prefix", 1).otherwise(2)
    return top_k(matches, [*keys, "field"], k, rank.asc(), *[F.asc(t) for t in tie])


def observed_edges(targets: DataFrame, outputs: DataFrame, keys: list[str], order: str = "d_ms") -> DataFrame:
    """First captured output (``<api>.ret``) that equals or contains each field."""
    produced = outputs.select(*keys, F.col("value").alias("produced"), "api", "d_ms", "value_sha")
    hits = match_derivations(produced, targets, keys)
    return hits.groupBy(*keys, "field").agg(
        F.min_by(F.struct("api", "d_ms", "value_sha", "match_kind"), order).alias("edge")
    )


def field_status(targets: DataFrame, ranked: DataFrame, counts: DataFrame, keys: list[str], edges: DataFrame | None = None) -> DataFrame:
    """Per field: derived, observed_output or unresolved, with the best derivation."""
    best = ranked.where("rank = 1").withColumn("spec", derivation_expr(ranked)).select(
        *keys, "field", "spec", "algo", "encoding", "match_kind"
    )
    out = targets.select(*keys, "field", "target").distinct().join(best, [*keys, "field"], "left").join(
        counts, [*keys, "field"], "left"
    )
    if edges is not None:
        out = out.join(edges, [*keys, "field"], "left")
        seen = F.col("edge").isNotNull()
    else:
        seen = F.lit(False)
    status = F.when(F.col("spec").isNotNull(), "derived").when(seen, "observed_output").otherwise("unresolved")
    return out.withColumn("status", status).withColumn(
        "derivation_count", F.coalesce("derivation_count", F.lit(0)).cast("bigint")
    )


def verify_fields(
    pool: DataFrame, targets: DataFrame, keys: list[str], outputs: DataFrame | None = None,
    digests: tuple[str, ...] = DIGESTS, *, pair_values: int | None = None,
) -> DataFrame:
    """All checks of every field, over observed material only.

    Pair transforms combine all values of each pool, or its first ``pair_values`` (0: none);
    ``pair_values_left_out`` says how many of the pool's values they did not see.
    """
    single = universe(pool, [*keys, "value"], digests=digests).withColumnRenamed("value", "input")
    found = match_derivations(single, targets, keys)
    if pair_values is None or pair_values:
        two = pair_matches(pool, targets, keys, pair_values)
        at = F.instr("produced", F.col("target")).cast("bigint") - 1
        two = two.withColumn("match_kind", match_kind(F.col("target"), F.col("produced"))).withColumn(
            "slice_start", at).withColumn("slice_end", at + F.length("target"))
        picked = pool if pair_values is None else top_k(pool, keys, pair_values, F.asc("first_order"), F.asc("value"))
        aes = match_derivations(aes_pairs(picked.select(*keys, "value"), keys), targets, keys)
        found = found.unionByName(two, allowMissingColumns=True).unionByName(aes, allowMissingColumns=True)
    counts = found.groupBy(*keys, "field").agg(F.count(F.lit(1)).alias("derivation_count"))
    ranked = rank_derivations(found, keys, ["structure", "algo", "encoding", "input"])
    edges = observed_edges(targets, outputs, keys) if outputs is not None else None
    status = field_status(targets, ranked, counts, keys, edges).join(pairs_left_out(pool, keys, pair_values), keys, "left")
    return status.fillna(0, ["pair_values_left_out"])


def resolution_summary(status: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    out = status.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fields_total"), n("derived").alias("derived"),
        n("observed_output").alias("observed_output"), n("unresolved").alias("unresolved"),
    )
    solved = F.col("fields_total") - F.col("unresolved")
    return out.withColumn("resolution_rate", F.bround(solved / F.col("fields_total"), 3))
