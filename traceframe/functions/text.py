"""String, URL and regular-expression functions, all built-in Spark expressions."""

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceframe.functions import lookup

# --- fixed values -----------------------------------------------------------
TOKEN = r"[A-Za-z0-9_\-+/=.]{16,}"
URL = r"https?://[^\s\"'<>\\]+"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
STATIC_EXTENSIONS = (
    ".js", ".mjs", ".css", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico",
    ".woff", ".woff2", ".ttf", ".otf", ".mp4", ".webm",
)
STATIC_DESTINATIONS = ("script", "style", "image", "font", "media")
RESOURCE_PATH = r"(/web/resource|/resource$)"
TELEMETRY = r"(telemetry|analytics|monitor|collect|beacon|log|report|metrics|probe|privacy_headers)"
REDACTED_MARKERS = ("redacted", "<redacted>", "[redacted]", "(redacted)", "***redacted***")
SUMMARY_REF_PREFIXES = (
    "string:length:", "js-string:length", "bytes:length:", "byte:length:",
    "array:length:", "object:length:",
)
OPAQUE_REF_PREFIXES = ("string_ref:", "bytes_sha1:")
ANY_REF_PREFIXES = ("string_ref:", "string:", "bytes_sha", "register:")
# --- end of fixed values ----------------------------------------------------


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string.

    The count of a character is what removing it takes off the length, so nothing
    is exploded and no row leaves its task.
    """
    n = F.length(s).cast("double")
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    terms = F.transform(F.array_distinct(F.split(s, "")), lambda c: share(c) * F.log2(share(c)))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n == 0, F.lit(0.0)).otherwise(-total)


@F.pandas_udf(T.DoubleType())
def text_entropy(values: pd.Series) -> pd.Series:
    """The same measure for long texts, counted in one pass per text.

    ``entropy`` costs text length times alphabet, right for tokens; on 24 million
    characters of prose it took 34 s on one core.
    """
    def one(value):
        if value is None:
            return None
        n = len(value)
        return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0

    return values.map(one)


def is_token_like(s: Column) -> Column:
    return s.rlike("^" + TOKEN + "$")


def token_scan(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(" + TOKEN + ")"), F.lit(1))


def extract_urls(s: Column) -> Column:
    """The whole value when it is a URL, otherwise every URL inside it."""
    whole = s.startswith("http://") | s.startswith("https://")
    return F.when(whole, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit("(" + URL + ")"), F.lit(1)))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_decode(s: Column) -> Column:
    """Decode ``+`` and percent escapes; malformed escapes stay as they are."""
    return F.coalesce(F.try_url_decode(s), F.replace(s, F.lit("+"), F.lit(" ")))


def query_params(url: Column, keep_blank: bool) -> Column:
    """Array of (name, value) in URL order."""
    pieces = F.filter(F.split(url_query(url), "&"), lambda p: p != "")
    pair = lambda p: F.struct(
        url_decode(F.substring_index(p, "=", 1)).alias("name"),
        url_decode(
            F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + F.lit(1))).otherwise(F.lit(""))
        ).alias("value"),
    )
    pairs = F.transform(pieces, pair)
    return pairs if keep_blank else F.filter(pairs, lambda x: x["value"] != "")


def query_keys(url: Column) -> Column:
    return F.array_distinct(F.transform(query_params(url, True), lambda x: x["name"]))


def is_numeric(s: Column) -> Column:
    return s.rlike(NUMBER)


def ref_literal(ref: Column) -> Column:
    """Literal of a self-describing reference: (text, number); number when numeric."""
    tail = F.substring_index(ref, "/", -1)
    after = F.when(F.instr(tail, ":") > 0, F.substr(tail, F.instr(tail, ":") + F.lit(1))).otherwise(F.lit(""))
    text = F.nullif(F.when(after == "", tail).otherwise(after), F.lit(""))
    number = F.when(is_numeric(text), F.trim(text).try_cast("double"))
    return F.struct(text.alias("text"), number.alias("number"))


def as_int(text: Column) -> Column:
    """Integer from integral text or an integral float; NULL otherwise."""
    number = text.try_cast("double")
    plain = text.rlike(r"^\s*[+-]?\d+\s*$")
    return F.when(plain, F.trim(text).try_cast("bigint")).when(
        is_numeric(text) & (number == F.floor(number)), number.try_cast("bigint")
    )


def sha8(s: Column) -> Column:
    return F.substring(F.sha2(F.encode(s, "UTF-8"), 256), 1, 8)


def token_fields(value: Column, sep: str) -> Column:
    """Array of (i, name, len, value); NULL when the delimiter is absent."""
    parts = F.split(value, F.lit("\\Q" + sep + "\\E"), -1)
    fields = F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("i"), F.concat(F.lit("f"), i.cast("string")).alias("name"),
            F.length(p).alias("len"), p.alias("value"),
        ),
    )
    return F.when(F.contains(value, F.lit(sep)), fields)


def utf16_index(source: Column, offset: Column) -> Column:
    """Character index of a UTF-16 code-unit offset; a split pair points at its character."""
    raw = F.encode(source, "UTF-16BE")
    units = (F.octet_length(raw) / 2).cast("int")
    at = F.least(offset.cast("int"), units)
    last = F.substr(raw, at * 2 - 1, F.lit(1))
    split = (at > 0) & (F.hex(last) >= F.lit("D8")) & (F.hex(last) <= F.lit("DB"))
    whole = F.when(split, at - 1).otherwise(at)
    chars = F.length(F.decode(F.substr(raw, F.lit(1), whole * 2), "UTF-16BE"))
    return F.when(offset >= 0, F.when(at == 0, F.lit(0)).otherwise(chars)).cast("bigint")


def newline_count(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def line_column(source: Column, index: Column) -> Column:
    """(1-based line, 0-based column) of a character index, clamped to the text."""
    bounded = F.greatest(F.lit(0), F.least(index, F.length(source))).cast("int")
    prefix = F.substr(source, F.lit(1), bounded)
    return F.struct(
        (newline_count(prefix) + 1).cast("bigint").alias("line"),
        F.length(F.substring_index(prefix, "\n", -1)).cast("bigint").alias("column"),
    )


def line_column_index(source: Column, line: Column, column: Column) -> Column:
    """Character index of (line, column); NULL when the line does not exist."""
    before = F.call_function("substring_index", source, F.lit("\n"), (line - 1).cast("int"))
    start = F.when(line == 1, F.lit(0)).otherwise(F.length(before) + 1)
    ok = (line >= 1) & (column >= 0) & (newline_count(source) >= line - 1)
    return F.when(ok, F.least(start + column, F.length(source))).cast("bigint")


# Characters shown around a position.
SNIPPET_BEFORE = 240
SNIPPET_AFTER = 520


def snippet(source: Column, index: Column, before: int = SNIPPET_BEFORE, after: int = SNIPPET_AFTER) -> Column:
    bounded = F.greatest(F.lit(0), F.least(index, F.length(source)))
    start = F.greatest(F.lit(0), bounded - before).cast("int")
    end = F.least(F.length(source), bounded + after).cast("int")
    text = F.substr(source, start + 1, end - start)
    return F.struct(
        F.coalesce(text, F.lit("")).alias("snippet"),
        start.cast("bigint").alias("snippet_start"),
        end.cast("bigint").alias("snippet_end"),
    )


def _contains_any(s: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(s, F.lit(t))
    return out


def url_role(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(_contains_any(low, lookup.SECURITY_URL_TERMS), "security_runtime_candidate")
        .when(_contains_any(low, lookup.TRANSPORT_URL_TERMS), "request_transport_candidate")
        .otherwise("supporting_runtime_candidate")
    )


def _is_absolute(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")


def _host_normal(url: Column) -> Column:
    host = F.lower(url_host(url))
    scheme = url_scheme(url)
    return (
        F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(host, ":443$", ""))
        .otherwise(host)
    )


def url_origin(url: Column) -> Column:
    return F.concat(url_scheme(url), F.lit("://"), _host_normal(url))


def canonical_endpoint(url: Column) -> Column:
    """URL without query, fragment and one trailing slash; root keeps its slash."""
    path = url_path(url)
    shown = F.when((path == "") | (path == "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/$", ""))
    return F.when(_is_absolute(url), F.concat(url_origin(url), shown)).otherwise(
        F.regexp_extract(url, r"^([^?#]*)", 1)
    )


def path_extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1)


def same_origin_pattern(start_url: Column) -> Column:
    web = _is_absolute(start_url) & url_scheme(start_url).isin("http", "https")
    return F.when(web, F.concat(url_origin(start_url), F.lit("/api/*"))).otherwise(F.lit("same-origin /api/*"))


def resource_class(url: Column, api: Column, destination: Column, resource_type: Column) -> Column:
    """document / static / telemetry class of a request, '' when it is actionable.

    The telemetry pattern is not anchored, so ``log`` also matches ``login``.
    """
    absolute = _is_absolute(url)
    path = F.when(absolute, F.when(url_path(url) == "", F.lit("/")).otherwise(url_path(url))).otherwise(F.lit(""))
    query = url_query(url)
    search = F.when(absolute & (query != ""), F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    name = F.when(absolute, F.regexp_replace(_host_normal(url), r":\d+$", "")).otherwise(F.lit(""))
    hay = F.lower(F.concat_ws(" ", name, path, search))
    dest = F.lower(F.coalesce(destination, F.lit("")))
    return (
        F.when((dest == "document") | (F.coalesce(resource_type, F.lit("")) == "main_frame"), "document_request")
        .when(dest.isin(*STATIC_DESTINATIONS), "static_resource")
        .when(path_extension(path).isin(*STATIC_EXTENSIONS), "static_resource")
        .when(hay.rlike(RESOURCE_PATH), "static_resource")
        .when(hay.rlike(TELEMETRY), "telemetry_endpoint")
        .when(absolute & (path == "/") & (api == "BrowserNetwork.request"), "document_request")
        .otherwise("")
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing positions; NULL when lengths differ."""
    marks = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("bigint"))
    count = F.aggregate(marks, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.when(F.length(a) == F.length(b), count)


def phase_name(function: Column) -> Column:
    out = None
    for name, pattern in lookup.PHASE_PATTERNS:
        hit = function.rlike("(?i)" + pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def is_preview_key(key: Column) -> Column:
    return (key == "preview") | key.endswith("_preview")


def is_redaction_key(key: Column) -> Column:
    return (key == "redacted") | key.endswith("_redacted")


def is_ref_key(key: Column) -> Column:
    return (key == "ref") | key.endswith("_ref") | key.endswith("_refs")


def is_redacted(value: Column) -> Column:
    """Every fixed marker contains the word, so one test covers them all."""
    return F.contains(F.lower(value), F.lit("redacted"))


def is_summary_ref(value: Column) -> Column:
    return lookup.starts_with_any(value, SUMMARY_REF_PREFIXES)


def is_opaque_ref(value: Column) -> Column:
    return lookup.starts_with_any(value, OPAQUE_REF_PREFIXES)


def value_class(key: Column, value: Column) -> Column:
    """Class of one (key, string value) pair."""
    return (
        F.when(is_preview_key(key), "preview")
        .when(is_redaction_key(key) | is_redacted(value), "redacted")
        .when(is_ref_key(key) & is_summary_ref(value), "summary_ref")
        .when(is_ref_key(key) & is_opaque_ref(value), "opaque_ref")
        .when(is_ref_key(key), "stable_ref")
        .otherwise("raw")
    )


def event_filter(text: str) -> Column:
    """Rows whose category or API contains the text, ignoring case."""
    needle = F.lit(text.strip().lower())
    cat = F.lower(F.coalesce(F.col("category"), F.lit("")))
    api = F.lower(F.coalesce(F.col("api"), F.lit("")))
    return F.contains(cat, needle) | F.contains(api, needle)
