"""Computed values in requests: discovery, preceding bursts, ranking, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.functions import lookup, text
from traceframe.functions.nested import string_leaves
from traceframe.operators.ordered import interval_sums
from traceframe.operators.profile import top_k


def request_carriers(
    requests: DataFrame, min_entropy: float = 4.0, raw_names: tuple[str, ...] = lookup.DEFAULT_HINTS,
    keep: tuple[str, ...] = ("trace_id", "file_index", "mono_time_us"),
) -> DataFrame:
    """(name, value, where) of token-like values in query, headers and body.

    Names in ``raw_names`` are taken whatever their value looks like. A parameter
    given twice counts once, with its first value.
    """
    raw = [n.lower() for n in raw_names]
    keep = list(keep)
    params = text.query_params(F.col("url"), False)
    names = F.transform(params, lambda p: p["name"])
    firsts = F.filter(params, lambda p, i: F.array_position(names, p["name"]) == i + 1)
    tagged = lambda arr, where: F.transform(
        arr, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), F.lit(where).alias("where"))
    )
    items = [tagged(firsts, "query")]
    if "headers" in requests.columns:
        items.append(F.coalesce(tagged(F.col("headers"), "header"), F.array().cast("array<struct<name:string,value:string,where:string>>")))
    found = requests.select(*keep, F.explode(F.concat(*items)).alias("c")).select(*keep, "c.*")
    if "body" in requests.columns:
        bodies = requests.where("body <> ''").select(*keep, "body")
        is_json = F.try_parse_json("body").isNotNull()
        leaves = string_leaves(bodies.where(is_json), "body", keep).select(
            *keep, F.concat(F.lit("body."), "path").alias("name"), F.col("text").alias("value"), F.lit("body").alias("where")
        )
        tokens = bodies.where(~is_json).select(
            *keep, F.explode(F.array_distinct(text.token_scan(F.col("body")))).alias("value")
        ).select(
            *keep, F.concat(F.lit("body:"), F.substring("value", 1, 8)).alias("name"), "value", F.lit("body").alias("where")
        )
        found = found.unionByName(leaves).unionByName(tokens)
    hinted = F.lower(F.coalesce("name", F.lit(""))).isin(*raw) if raw else F.lit(False)
    tokenish = text.is_token_like(F.col("value")) & (text.entropy(F.col("value")) >= min_entropy)
    return found.where((F.coalesce("value", F.lit("")) != "") & (hinted | tokenish))


def burst_counts(requests: DataFrame, compute: DataFrame, window_us: int) -> DataFrame:
    """Computing events in [t - window, t] for every distinct request time t."""
    spans = requests.select(
        "trace_id", (F.col("mono_time_us") - window_us).alias("lo"), F.col("mono_time_us").alias("hi")
    )
    points = compute.select("trace_id", "mono_time_us", F.lit(1).cast("bigint").alias("burst"))
    out = interval_sums(points, "mono_time_us", spans, "lo", "hi", ["trace_id"], ["burst"])
    return out.select("trace_id", F.col("hi").alias("t"), "burst")


def with_burst(requests: DataFrame, compute: DataFrame, window_us: int) -> DataFrame:
    counts = burst_counts(requests, compute, window_us)
    joined = requests.join(
        counts.select(F.col("trace_id").alias("_tr"), "t", "burst"),
        (F.col("trace_id") == F.col("_tr")) & (F.col("mono_time_us").cast("double") == F.col("t")), "left",
    )
    return joined.drop("_tr", "t").withColumn("burst", F.coalesce("burst", F.lit(0)).cast("bigint"))


def rank_carriers(
    carriers: DataFrame, k: int = 10, hints: tuple[str, ...] = lookup.DEFAULT_HINTS
) -> DataFrame:
    """Rank carrier names by variation x entropy x preceding burst.

    ``carriers`` has a ``burst`` column. Values are combined per (name, value) first,
    so one constant value in most requests costs one row, and its entropy one
    evaluation.
    """
    values = carriers.groupBy("trace_id", "name", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("burst").alias("burst"),
        F.min("file_index").alias("first_index"), F.collect_set("where").alias("places"),
    )
    names = values.withColumn("entropy", text.entropy(F.col("value"))).groupBy("trace_id", "name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("distinct_values"),
        F.max("entropy").alias("entropy"), F.max(F.length("value")).cast("bigint").alias("example_len"),
        F.max("burst").alias("max_compute_burst"),
        F.min(F.struct("first_index", F.substring("value", 1, 24).alias("example"))).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("where"),
    )
    hinted = F.lower("name").isin(*[h.lower() for h in hints]) if hints else F.lit(False)
    variance = F.col("distinct_values") / F.col("count")
    score = variance * F.col("entropy") * F.log10(F.col("max_compute_burst") + 10) * F.when(hinted, 2.0).otherwise(1.0)
    scored = names.withColumn("hinted", hinted).withColumn("score", F.bround(score, 3))
    out = top_k(scored, ["trace_id"], k, F.desc("score"), F.asc("first.first_index"), F.asc("name"))
    return out.select(
        "trace_id", "rank", "name", "where", "count", "distinct_values",
        F.bround(variance, 2).alias("variance"), F.bround("entropy", 2).alias("max_entropy"),
        "example_len", "max_compute_burst", "hinted", "score", F.col("first.example").alias("example"),
    )


def anchor_by_material(anchors: DataFrame, material: DataFrame, window_us: int, keys: list[str]) -> DataFrame:
    """Per key the anchor whose preceding window holds most material; ties: earliest."""
    counted = with_burst(anchors, material, window_us)
    rank = F.struct("burst", -F.col("mono_time_us"), -F.col("file_index"))
    return counted.groupBy(*keys).agg(
        F.max_by(F.struct("file_index", "mono_time_us", "burst"), rank).alias("a")
    ).select(
        *keys, F.col("a.file_index").alias("anchor_index"), F.col("a.mono_time_us").alias("anchor_time_us"),
        F.col("a.burst").alias("material_events"),
    )


def signed_urls(rows: DataFrame, url: str, targets: list[str], keep: list[str]) -> DataFrame:
    """URLs whose query has one of the target keys, with the facts about the first."""
    wanted = F.array(*[F.lit(t) for t in targets])
    params = text.query_params(F.col(url), True)
    named = rows.select(*keep, F.col(url).alias("_url"), params.alias("_p")).withColumn(
        "_keys", F.array_distinct(F.transform("_p", lambda p: p["name"]))
    ).withColumn("target_params", F.filter(wanted, lambda t: F.array_contains(F.col("_keys"), t)))
    first = F.element_at("target_params", 1)
    value = F.try_element_at(F.filter("_p", lambda p: p["name"] == first), F.lit(1))["value"]
    return named.where(F.size("target_params") > 0).select(
        *keep, text.url_scheme(F.col("_url")).alias("scheme"), text.url_host(F.col("_url")).alias("host"),
        text.url_path(F.col("_url")).alias("path"), F.array_sort("_keys").alias("query_keys"), "target_params",
        first.alias("primary_target"), F.length(value).cast("bigint").alias("primary_value_length"),
        F.exists("_keys", lambda k: F.contains(F.lower(k), F.lit("token"))).alias("has_supporting_token"),
    )


def correlated(network: DataFrame, renderer: DataFrame, key: str = "network_correlation_key") -> DataFrame:
    """Network rows that some renderer row of the same trace refers to."""
    have = [c for c in ("trace_id", key) if c in network.columns and c in renderer.columns]
    return network.join(renderer.select(*have).where(F.col(key).isNotNull()), have, "left_semi")


def linked_reads(owners: DataFrame, reads: DataFrame, key: str = "headers_id") -> DataFrame:
    """Reads of an object that an owner row announced (semi-join on the object id)."""
    have = [c for c in ("trace_id", key) if c in owners.columns and c in reads.columns]
    return reads.join(owners.select(*have).where(F.col(key).isNotNull()), have, "left_semi")


def expected_missing(events: DataFrame, required: DataFrame, column: str = "api") -> DataFrame:
    """Required names that were never observed."""
    return required.join(events.select(column), column, "left_anti")
