"""Rules on requests: parameter materialisation and conformance to a contract."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions import material, text
from traceframe.quality.rules import _violations

# APIs that carry a parameter out, and APIs in which it takes shape.
CARRIER_APIS = (
    "Request.constructor", "Request.url.get", "fetch", "XMLHttpRequest.open", "XMLHttpRequest.send",
    "BrowserNetwork.request",
)
SHAPING_APIS = (
    "String.fromCharCode", "String.fromCodePoint", "String.prototype.codePointAt", "String.prototype.charAt",
    "String.prototype.concat", "String.prototype.slice", "String.prototype.substring", "String.prototype.substr",
    "String.prototype.repeat", "String.prototype.replace", "String.prototype.toLowerCase",
    "String.prototype.toUpperCase", "StringAdd", "StringAdd.constant_lhs", "StringAdd.constant_rhs",
    "Array.prototype.join", "TypedArray.join", "Number.prototype.toString", "BigInt.prototype.toString",
    "encodeURI", "encodeURIComponent", "decodeURI", "decodeURIComponent", "URLSearchParams.constructor",
    "URLSearchParams.append", "URLSearchParams.delete", "URLSearchParams.get", "URLSearchParams.getAll",
    "URLSearchParams.has", "URLSearchParams.set", "URLSearchParams.iterator.next", "URLSearchParams.toString",
    "URL.href.set", "URL.search.set", "Location.href.set", "Location.search.set", "Location.assign",
    "Location.replace", "Headers.constructor", "Headers.append", "Headers.get", "Headers.iterator.next",
    "Headers.set", "XMLHttpRequest.setRequestHeader", "CookieStore.get", "CookieStore.getAll", "CookieStore.set",
    "FormData.constructor", "FormData.append", "FormData.delete", "FormData.get", "FormData.getAll",
    "FormData.has", "FormData.set", "FormData.iterator.next",
)


def _arg(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("arg0", f"$.{name}", kind)


def _text(name: str) -> Column:
    return F.coalesce(_arg(name), F.lit(""))


def has(name: str) -> Column:
    """The member carries material."""
    value = _arg(name, "variant")
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    string = F.coalesce(_arg(name), F.lit(""))
    return F.when(kind == "STRING", (F.trim(string) != "") & ~text.is_redacted(string)).otherwise(
        ~kind.isin("VOID", "OBJECT<>", "ARRAY<VOID>")
    )


def ref_of(name: str) -> Column:
    return has(f"{name}_ref") | has(f"{name}_refs") | has("ref")


def value_ref() -> Column:
    out = F.lit(False)
    for key in material.VALUE_REF_KEYS:
        out = out | has(key)
    return out


_HEADER = "array<struct<name:string,value:string,name_length:string,value_length:string>>"


def header_names(need_value: bool = False, need_lengths: bool = False) -> Column:
    """Lower-cased header names, optionally only complete ones."""
    filled = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "") & ~text.is_redacted(F.coalesce(c, F.lit("")))

    def keep(h):
        ok = F.coalesce(h["name"], F.lit("")) != ""
        if need_value:
            ok = ok & filled(h["value"])
        if need_lengths:
            ok = ok & h["name_length"].isNotNull() & h["value_length"].isNotNull()
        return ok

    headers = F.coalesce(_arg("headers", _HEADER), F.array().cast(_HEADER))
    return F.array_distinct(F.transform(F.filter(headers, keep), lambda h: F.lower(h["name"])))


def parameter_materialisation(events: DataFrame, leaf_rows: DataFrame, params) -> DataFrame:
    """Each parameter leaves in a request and takes shape, with a reference, before it."""
    params = list(params)
    listed = F.array(*[F.lit(p) for p in params])
    url = F.when(_text("url") != "", _text("url")).otherwise(_text("href"))
    carriers = events.where(F.col("api").isin(*CARRIER_APIS) & F.col("arg0").isNotNull())
    direct = carriers.select("trace_id", F.explode(F.filter(
        listed, lambda p: F.array_contains(text.query_keys(url), p) | F.array_contains(header_names(), F.lower(p))
    )).alias("param"))
    arg_leaves = leaf_rows.where(F.col("path").startswith("args[0]") & (F.col("kind") == "string"))
    mentioned = arg_leaves.where(F.col("api").isin(*CARRIER_APIS)).select(
        "trace_id", F.explode(F.filter(listed, lambda p: F.contains(F.col("text"), p))).alias("param")
    )
    carried = direct.unionByName(mentioned).distinct()

    shaped_leaves = leaf_rows.where(
        F.col("api").isin(*SHAPING_APIS) & F.col("path").startswith("args[0]") & (F.size("keys") >= 2)
    )
    # Members of each object, one row per (object, key): its text and whether it has material.
    hidden = F.exists(F.slice("keys", F.size("keys"), F.lit(1)), material.hidden_key)
    members = shaped_leaves.select(
        "trace_id", "file_index", F.element_at("containers", -1).alias("holder"), F.element_at("keys", -1).alias("key"),
        F.when((F.col("kind") == "string") & (F.col("tail") == 0) & ~hidden, F.col("text")).alias("text"),
        material.leaf_material(F.col("kind"), F.col("text")).alias("ok"),
    )
    # One object's members are gathered: as many as that object has.
    objects = members.groupBy("trace_id", "file_index", "holder").agg(
        F.collect_list(F.struct("key", "text")).alias("m"),
        F.collect_set(F.when(F.col("ok"), F.col("key"))).alias("filled"),
    )
    named = lambda p: F.exists("m", lambda x: x["key"].isin("name", "key") & (x["text"] == p))
    refs = F.array(*[F.lit(k) for k in material.VALUE_REF_KEYS])
    beside = lambda k: F.arrays_overlap("filled", F.array(F.concat(k, F.lit("_ref")), F.concat(k, F.lit("_refs")), F.lit("ref")))
    inner = lambda p: F.exists("m", lambda x: F.coalesce(F.contains(x["text"], p), F.lit(False)) & beside(x["key"]))
    hit = lambda p: F.when(named(p), F.arrays_overlap("filled", refs)).otherwise(inner(p))
    shaped = objects.select("trace_id", F.explode(F.filter(listed, hit)).alias("param")).distinct()

    asked = events.select("trace_id").distinct().select("trace_id", F.explode(listed).alias("param"))
    keys = ["trace_id", "param"]
    out = _violations(asked.join(carried, keys, "left_anti"), "parameter", "no_request_carrier", F.col("param"))
    return out.unionByName(_violations(asked.join(shaped, keys, "left_anti"), "parameter", "no_materialisation", F.col("param")))


def _labelled(label: str):
    return lambda name: F.concat(F.lit(f"{label}: "), name)


@dataclass(frozen=True)
class RequestContract:
    """What a capture of one endpoint must show; all lists are the caller's."""

    path: str
    get_query: tuple[str, ...]
    post_query: tuple[str, ...]
    get_headers: tuple[str, ...]
    post_headers: tuple[str, ...]
    browser_headers: tuple[str, ...] = ()
    response_headers: tuple[str, ...] = ()
    apis: tuple[str, ...] = field(default=(
        "BrowserNetwork.request", "Request.constructor", "Request.url.get", "Request.headers.get", "fetch",
        "Headers.get", "Headers.set", "Headers.append", "Headers.iterator.next", "Body.json",
        "Response.status.get", "Response.url.get", "Response.headers.get", "URLSearchParams.set", "URL.search.set",
        "XMLHttpRequest.open", "XMLHttpRequest.setRequestHeader", "XMLHttpRequest.send", "XMLHttpRequest.responseText",
    ))


def request_conformance(events: DataFrame, contract: RequestContract) -> DataFrame:
    """Evidence for a GET and a POST to the endpoint of the contract.

    Three bounded passes over the events of the listed APIs: the first GET and POST
    per trace, the header objects they link to, and one aggregation of all checks.
    """
    rows = events.where(F.col("api").isin(*contract.apis)).withColumn(
        "arg0", F.coalesce("arg0", F.parse_json(F.lit("{}")))
    ).withColumn("stacked", F.coalesce(F.size("stack") > 0, F.lit(False)))
    at_endpoint = lambda n: text.url_path(_text(n)) == contract.path
    network = (F.col("api") == "BrowserNetwork.request") & at_endpoint("url")
    pick = lambda m: F.min(F.when(network & (_text("method") == m), F.struct("file_index", _arg("network_correlation_key").alias("key"))))
    anchors = rows.groupBy("trace_id").agg(pick("GET").alias("get_row"), pick("POST").alias("post_row"))

    links = rows.where(
        ((F.col("api") == "Response.headers.get") & has("response_id") & has("headers_id"))
        | ((F.col("api") == "Request.headers.get") & (F.upper(_text("method")) == "GET") & at_endpoint("url")
           & has("headers_id") & has("network_correlation_key") & ref_of("method") & ref_of("url"))
    ).select("trace_id", _text("headers_id").alias("_hid"), (F.col("api") == "Request.headers.get").alias("_req"))
    links = links.groupBy("trace_id", "_hid").agg(F.bool_or("_req").alias("request_object"), F.bool_or(~F.col("_req")).alias("response_object"))
    reads = rows.join(anchors, "trace_id").withColumn("_hid", _text("headers_id")).join(links, ["trace_id", "_hid"], "left")
    linked_request = F.coalesce("request_object", F.lit(False))
    linked_response = F.coalesce("response_object", F.lit(False))

    api = F.col("api")
    key = _arg("network_correlation_key")
    get_key, post_key = F.col("get_row.key"), F.col("post_row.key")
    same = lambda k: k.isNull() | key.eqNullSafe(k)
    is_get, is_post = F.upper(_text("method")) == "GET", F.upper(_text("method")) == "POST"
    stacked = F.col("stacked")

    def all_of(*names):
        out = F.lit(True)
        for n in names:
            out = out & has(n)
        return out

    name = F.lower(_text("name"))
    header_read = (_arg("found", "boolean").isNull() | _arg("found", "boolean")) & all_of("name_length", "result", "result_length") & ref_of("name") & ref_of("result")
    header_step = all_of("iteration_index", "name_length", "value", "value_length") & ref_of("name") & ref_of("value")
    keys_in_href = F.size(F.array_except(F.array(*[F.lit(q) for q in contract.get_query]), text.query_keys(_text("href")))) == 0
    upload = _arg("upload_body", "variant")
    sub = lambda n: F.coalesce(F.try_variant_get(upload, f"$.{n}", "string"), F.lit(""))
    body_ok = (sub("body_hex") != "") | (sub("body_sha256") != "") | ((sub("body") != "") & ((sub("body_ref") != "") | (sub("ref") != "")))
    truthy = lambda c: ~F.coalesce(c, F.lit("")).isin("", "0", "false")
    xhr_body = has("body") & ref_of("body")
    first_get = F.col("file_index") == F.col("get_row.file_index")
    first_post = F.col("file_index") == F.col("post_row.file_index")
    # (label, needs: get / post / both present, condition met by some row)
    flags = [
        ("GET request", "", network & (_text("method") == "GET")),
        ("POST request", "", network & (_text("method") == "POST")),
        ("GET network_correlation_key", "get", first_get & truthy(key)),
        ("GET Request.constructor", "", (api == "Request.constructor") & stacked & is_get & at_endpoint("url") & all_of("input_type", "headers_id", "has_init", "has_body", "body_byte_length", "network_correlation_key") & ref_of("url") & same(get_key)),
        ("GET Request.url.get", "", (api == "Request.url.get") & is_get & at_endpoint("url") & has("network_correlation_key") & ref_of("method") & ref_of("url") & same(get_key)),
        ("GET fetch", "", (api == "fetch") & stacked & is_get & at_endpoint("url") & all_of("headers_id", "has_body", "body_byte_length", "network_correlation_key") & ref_of("url") & same(get_key)),
        ("GET Request.headers.get link", "", (api == "Request.headers.get") & is_get & at_endpoint("url") & has("headers_id") & has("network_correlation_key") & ref_of("method") & ref_of("url")),
        ("POST upload_body", "post", first_post & truthy(sub("total_bytes")) & body_ok),
        ("POST network_correlation_key", "post", first_post & truthy(key)),
        ("Body.json", "", (api == "Body.json") & all_of("result", "result_length") & ref_of("result")),
        ("Response.status.get", "", (api == "Response.status.get") & all_of("response_id", "status") & ref_of("status")),
        ("Response.url.get", "", (api == "Response.url.get") & all_of("response_id", "url") & ref_of("url")),
        ("Response.headers.get link", "", (api == "Response.headers.get") & all_of("response_id", "headers_id")),
        ("URL.search.set source", "", (api == "URL.search.set") & stacked & at_endpoint("href") & keys_in_href),
        ("URL.search.set refs", "", (api == "URL.search.set") & stacked & at_endpoint("href") & keys_in_href & has("href") & ref_of("value") & ref_of("search") & ref_of("href")),
        ("GET source correlation", "get_key", api.isin("Request.constructor", "fetch") & key.eqNullSafe(get_key) & stacked),
        ("POST XMLHttpRequest.open", "post_key", (api == "XMLHttpRequest.open") & stacked & is_post & at_endpoint("url") & all_of("async", "network_correlation_key") & ref_of("url") & same(post_key)),
        ("POST setRequestHeader correlation", "post_key", (api == "XMLHttpRequest.setRequestHeader") & key.eqNullSafe(post_key) & stacked),
        ("POST send correlation", "post_key", (api == "XMLHttpRequest.send") & key.eqNullSafe(post_key) & truthy(_arg("body_size")) & stacked),
        ("POST send evidence", "post_key", (api == "XMLHttpRequest.send") & stacked & is_post & at_endpoint("url") & all_of("xhr_id", "network_correlation_key", "form_data_id", "body_search_params_id", "body_type", "body_array_buffer_id", "body_typed_array_id", "body_byte_offset", "body_size") & ref_of("url") & xhr_body & same(post_key)),
        ("POST send body refs", "post_key", (api == "XMLHttpRequest.send") & key.eqNullSafe(post_key) & truthy(_arg("body_size")) & xhr_body & stacked),
        ("POST responseText", "post_key", (api == "XMLHttpRequest.responseText") & stacked & at_endpoint("url") & all_of("xhr_id", "network_correlation_key", "status", "value", "value_length") & ref_of("url") & ref_of("value") & same(post_key)),
    ]
    both_headers = tuple(dict.fromkeys(contract.get_headers + contract.browser_headers))
    post_all = tuple(dict.fromkeys(contract.post_headers + contract.browser_headers))
    queries = tuple(dict.fromkeys(contract.get_query + contract.post_query))
    one = lambda c: F.array(c)
    # (label, needs, names required, names a row contributes, condition)
    sets = [
        ("GET query", "get", contract.get_query, text.query_keys(_text("url")), first_get),
        ("GET headers", "get", both_headers, header_names(), first_get),
        ("GET header values", "get", both_headers, header_names(True), first_get),
        ("GET complete headers", "get", both_headers, header_names(True, True), first_get),
        ("POST query", "post", contract.post_query, text.query_keys(_text("url")), first_post),
        ("POST headers", "post", post_all, header_names(), first_post),
        ("POST header values", "post", post_all, header_names(True), first_post),
        ("POST complete headers", "post", post_all, header_names(True, True), first_post),
        ("request Headers.get", "", contract.get_headers, one(name), (api == "Headers.get") & linked_request & header_read),
        ("response Headers.get", "", contract.response_headers, one(name), (api == "Headers.get") & linked_response & header_read),
        ("response Headers.iterator", "", contract.response_headers, one(name), (api == "Headers.iterator.next") & linked_response & header_step),
        ("URLSearchParams.set source", "", queries, one(_text("name")), (api == "URLSearchParams.set") & stacked),
        ("URLSearchParams.set refs", "", queries, one(_text("name")), (api == "URLSearchParams.set") & stacked & has("value") & value_ref()),
        ("fetch header source", "", contract.get_headers, one(name), api.isin("Headers.set", "Headers.append") & stacked),
        ("fetch header refs", "", contract.get_headers, one(name), api.isin("Headers.set", "Headers.append") & stacked & has("value") & value_ref()),
        ("XHR header source", "", contract.post_headers, one(name), (api == "XMLHttpRequest.setRequestHeader") & stacked),
        ("XHR header refs", "", contract.post_headers, one(name), (api == "XMLHttpRequest.setRequestHeader") & stacked & has("value") & value_ref()),
    ]
    # A row answers with the short list of checks it meets; answers are de-duplicated
    # in the tasks before they are shuffled.
    met = [F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(label))) for label, _, cond in flags]
    for label, _, names, given, cond in sets:
        if names:
            known = F.array_intersect(given, F.array(*[F.lit(n) for n in names]))
            met.append(F.when(F.coalesce(cond, F.lit(False)), F.transform(known, _labelled(label))))
    answers = reads.select("trace_id", F.explode(F.flatten(F.array_compact(F.array(*met)))).alias("check")).distinct()

    need = {
        "": F.lit(True), "get": F.col("get_row").isNotNull(), "post": F.col("post_row").isNotNull(),
        "get_key": truthy(F.col("get_row.key")), "post_key": truthy(F.col("post_row.key")),
    }
    asked = [F.when(need[n], F.array(F.lit(label))) for label, n, _ in flags]
    asked += [F.when(need[n], F.array(*[F.lit(f"{label}: {x}") for x in names])) for label, n, names, _, _ in sets if names]
    traces = events.select("trace_id").distinct().join(anchors, "trace_id", "left")
    wanted = traces.select("trace_id", F.explode(F.flatten(F.array_compact(F.array(*asked)))).alias("check"))
    return _violations(wanted.join(answers, ["trace_id", "check"], "left_anti"), "request", "evidence_missing", F.col("check"))
