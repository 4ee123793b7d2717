"""From a call to its source: script registry, call sites, assets, site candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions import lookup, text
from traceframe.operators.profile import site_role, top_k

_NONE = "-"
_ANY = "*"


def _tag(col: Column) -> Column:
    """Scope text in which an absent scope is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(_NONE))


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def script_registry(rows: DataFrame) -> DataFrame:
    """One record per (trace, session, isolate, script) that ever named its source.

    A record starts at the first row with a URL, an asset or a hash; from there the
    last non-empty value of each column wins.
    """
    usable = rows.where("script_id > 0")
    informs = F.coalesce(_filled("script_url"), _filled("asset_id"), _filled("source_hash")).isNotNull()
    last = lambda name: F.max_by(_filled(name), F.when(_filled(name).isNotNull(), F.col("file_index"))).alias(name)
    length_at = F.when(F.coalesce("source_length", F.lit(0)) != 0, F.col("file_index"))
    grouped = usable.groupBy("trace_id", "session_id", "isolate_id", "script_id").agg(
        last("script_url"), last("asset_id"), last("source_hash"),
        F.max_by("source_length", length_at).alias("_length"), F.max(length_at).alias("_length_at"),
        F.min(F.when(informs, F.col("file_index"))).alias("first_index"),
        F.min_by("seq", F.when(informs & F.col("seq").isNotNull(), F.col("file_index"))).alias("seq"),
    )
    kept = grouped.where("first_index IS NOT NULL")
    length = F.when(F.col("_length_at") >= F.col("first_index"), F.col("_length"))
    return kept.withColumn("source_length", length).drop("_length", "_length_at")


def resolve_scripts(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach the registry record of each call's (session, isolate, script).

    The scope is widened step by step: exact, without isolate, without session,
    without both, and last the first record that used the script id. Every distinct
    scope is resolved once, as one equi-join over its five candidate keys.
    """
    record = F.struct("script_url", "asset_id", "source_hash", "first_index")
    scoped = registry.select(
        "trace_id", _tag(F.col("session_id")).alias("_s"), _tag(F.col("isolate_id")).alias("_i"),
        F.col("script_id").alias("_k"), record.alias("_rec"),
    )
    bare = registry.groupBy("trace_id", F.col("script_id").alias("_k")).agg(F.min_by(record, "first_index").alias("_rec"))
    bare = bare.select("trace_id", F.lit(_ANY).alias("_s"), F.lit(_ANY).alias("_i"), "_k", "_rec")
    known = scoped.unionByName(bare)

    scope = ["trace_id", "session_id", "isolate_id", "script_id"]
    distinct = calls.select(*scope).where("script_id IS NOT NULL").distinct()
    s, i = _tag(F.col("session_id")), _tag(F.col("isolate_id"))
    none, every = F.lit(_NONE), F.lit(_ANY)
    steps = [(s, i), (s, none), (none, i), (none, none), (every, every)]
    tries = F.array(*[F.struct(F.lit(n).alias("n"), a.alias("_s"), b.alias("_i")) for n, (a, b) in enumerate(steps, 1)])
    asked = distinct.select(*scope, F.explode(tries).alias("t")).select(
        *scope, F.col("t.n").alias("_n"), F.col("t._s").alias("_s"), F.col("t._i").alias("_i"),
        F.col("script_id").alias("_k"),
    )
    found = asked.join(known, ["trace_id", "_s", "_i", "_k"]).groupBy(*scope).agg(
        F.min_by("_rec", "_n").alias("record"), F.min("_n").alias("step")
    )
    right = found.select(*[F.col(c).alias(f"_r_{c}") for c in scope], "record", "step")
    cond = F.lit(True)
    for c in scope:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return calls.join(right, cond, "left").drop(*[f"_r_{c}" for c in scope])


def dispatch_callsites(calls: DataFrame, registry: DataFrame, asset_scheme: str = "asset:") -> DataFrame:
    """Rows of mode ``dispatch_light`` with their resolved source and a flag."""
    light = resolve_scripts(calls.where("callsite_mode = 'dispatch_light'"), registry)
    url, asset, digest = F.col("record.script_url"), F.col("record.asset_id"), F.col("record.source_hash")
    locator = F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit(asset_scheme), F.nullif(asset, F.lit(""))))
    named = F.coalesce(F.nullif(url, F.lit("")), F.nullif(asset, F.lit("")), F.nullif(digest, F.lit("")))
    return light.select(
        *[c for c in light.columns if c not in ("record", "step")], url.alias("resolved_url"),
        asset.alias("resolved_asset_id"), digest.alias("resolved_source_hash"),
        locator.alias("source_locator"), named.isNotNull().alias("resolved"),
    )


def callsite_counts(callsites: DataFrame) -> DataFrame:
    return callsites.groupBy("trace_id").agg(
        F.count_if(F.col("resolved")).alias("resolved_count"),
        F.count_if(~F.col("resolved")).alias("unresolved_count"),
    )


def frame_url(frame: Column) -> Column:
    return F.coalesce(F.nullif(frame["url"], F.lit("")), F.nullif(frame["script"], F.lit("")), F.lit(""))


def first_frame(stack: Column) -> Column:
    """First frame that names a source, as (function, url, line, column)."""
    frame = F.try_element_at(F.filter(stack, lambda f: frame_url(f) != ""), F.lit(1))
    return F.when(
        frame.isNotNull(),
        F.struct(
            F.coalesce(frame["function"], F.lit("")).alias("function"), frame_url(frame).alias("url"),
            frame["line"].cast("bigint").alias("line"), frame["column"].cast("bigint").alias("column"),
        ),
    )


def stack_top(
    stack: Column, js_stack: Column | None = None, resolved: Column | None = None, callsite: Column | None = None
) -> Column:
    """First usable of stack, argument stack, resolved call site, inline call site.

    The last two are structs (function, url, line, column), NULL when unusable.
    """
    options = [first_frame(stack)]
    if js_stack is not None:
        options.append(first_frame(js_stack))
    options += [c for c in (resolved, callsite) if c is not None]
    return F.coalesce(*options)


def resolve_assets(sites: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset of each site by id, else by hash, else by URL.

    A URL match after a stronger key was given and failed is marked unverified.
    Distinct key triples are resolved once; source text is not carried along, only
    the row key of the asset.
    """
    triple = ["asset_id", "source_hash", "url"]
    ident = F.struct("manifest_index", "source_unverified")

    def keyed(kind: str, col: str, pick) -> DataFrame:
        named = assets.where(_filled(col).isNotNull())
        return named.groupBy(F.concat(F.lit(kind + ":"), F.col(col)).alias("_key")).agg(
            pick(ident, F.col("manifest_index")).alias("_asset")
        )

    known = keyed("id", "asset_id", F.max_by).unionByName(keyed("hash", "source_hash", F.max_by)).unionByName(
        keyed("url", "url", F.min_by)
    )
    tries = F.filter(
        F.array(*[
            F.struct(F.lit(n).alias("n"), F.concat(F.lit(kind + ":"), _filled(col)).alias("key"))
            for n, (kind, col) in enumerate((("id", "asset_id"), ("hash", "source_hash"), ("url", "url")), 1)
        ]),
        lambda t: t["key"].isNotNull(),
    )
    asked = sites.select(*triple).distinct().select(*triple, F.explode(tries).alias("t"))
    asked = asked.select(*triple, F.col("t.n").alias("_n"), F.col("t.key").alias("_key"))
    found = asked.join(known, "_key").groupBy(*triple).agg(F.min(F.struct("_n", "_asset")).alias("m"))
    stronger = F.coalesce(_filled("asset_id"), _filled("source_hash")).isNotNull()
    found = found.select(
        *[F.col(c).alias(f"_r_{c}") for c in triple],
        F.col("m._asset.manifest_index").alias("manifest_index"),
        (F.col("m._asset.source_unverified") | ((F.col("m._n") == 3) & stronger)).alias("source_unverified"),
    )
    cond = F.lit(True)
    for c in triple:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return sites.join(found, cond, "left").drop(*[f"_r_{c}" for c in triple])


def locate_positions(sites: DataFrame, assets: DataFrame) -> DataFrame:
    """Line, column and character index of UTF-16 positions in their asset.

    ``sites`` carries ``manifest_index``, ``source_position`` and
    ``function_start_position``; position 0 or NULL falls back to the function start.
    """
    pos, start = F.col("source_position"), F.col("function_start_position")
    anchor = F.when((F.coalesce(pos, F.lit(0)) == 0) & (F.coalesce(start, F.lit(0)) != 0), start).otherwise(pos)
    joined = sites.join(assets.select("manifest_index", "source"), "manifest_index")
    index = text.utf16_index(F.col("source"), anchor)
    out = joined.withColumn("source_index", index).where(F.col("source_index").isNotNull())
    lc = text.line_column(F.col("source"), F.col("source_index"))
    return out.withColumn("line", lc["line"]).withColumn("column", lc["column"]).drop("source")


def locate_frames(sites: DataFrame, assets: DataFrame) -> DataFrame:
    """Character index of (line, column) frames in their asset; unknown lines drop out."""
    joined = sites.join(assets.select("manifest_index", "source"), "manifest_index")
    index = text.line_column_index(F.col("source"), F.col("line"), F.col("column"))
    out = joined.withColumn("source_index", index).where(F.col("source_index").isNotNull())
    lc = text.line_column(F.col("source"), F.col("source_index"))
    return out.withColumn("line", lc["line"]).withColumn("column", lc["column"]).drop("source")


# Fixed value: how close before the focus an event counts as near.
PROXIMITY_US = 250_000


def site_candidates(rows: DataFrame, generic: bool = True, k: int = 30, proximity_us: int = PROXIMITY_US) -> DataFrame:
    """Code sites of a focus window, scored.

    ``rows`` has one row per (event, attributed site), so an event attributed both by
    call site and by stack counts twice. Columns: trace_id, url, source_hash,
    function, function_start_position, source_position, api, seq, file_index,
    mono_time_us, focus_time_us, marked.
    """
    rows = lookup.with_family(rows)
    fsp = F.col("function_start_position")
    keyed = rows.withColumn("_fn", F.when(fsp.isNull(), F.col("function"))).withColumn(
        "_pos", F.when(fsp.isNull(), F.col("source_position"))
    )
    near = F.col("focus_time_us") - F.col("mono_time_us") <= proximity_us
    extra = [c for c in ("asset_id", "line", "column", "source_unverified", "source_index") if c in rows.columns]
    first = F.struct("file_index", "function", "source_position", *extra)
    sites = keyed.groupBy("trace_id", "url", "source_hash", "function_start_position", "_fn", "_pos").agg(
        F.min(first).alias("_first"), F.count(F.lit(1)).alias("event_count"), F.sum("weight").alias("weight_sum"),
        F.count_if(F.col("marked")).alias("marker_count"), F.count_if(near).alias("proximity_hits"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.array_sort(F.collect_set("family")).alias("families"),
    )
    n, w, p, m = (F.col(c) for c in ("event_count", "weight_sum", "proximity_hits", "marker_count"))
    if generic:
        scored = sites.withColumn("role", site_role(F.col("families"))).withColumn("score", w * 10 + p * 5 + n)
        order = [F.desc("weight_sum"), F.desc("proximity_hits"), F.desc("event_count")]
    else:
        scored = sites.withColumn("role", text.url_role(F.col("url"))).withColumn("score", m * 100 + p * 10 + n)
        order = [F.desc("score"), F.desc("event_count")]
    out = top_k(scored, ["trace_id"], k, *order, F.asc("_first.file_index"))
    return out.select(
        "trace_id", "rank", "url", "source_hash", "function_start_position",
        *[F.col(f"_first.{c}").alias(c) for c in ("function", "source_position", *extra)],
        "role", "score", "event_count", "marker_count", "proximity_hits", "weight_sum",
        "families", "first_seq", "last_seq",
    )


def transport_candidates(rows: DataFrame, k: int = 20) -> DataFrame:
    """Candidates whose URL plays the transport role, by the signature score."""
    hits = rows.where(text.url_role(F.col("url")) == "request_transport_candidate")
    return site_candidates(hits, generic=False, k=k)
