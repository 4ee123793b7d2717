"""What the windows before anchors hold, counted without a row per anchor and event.

Anchors whose windows overlap see the same events, so rows of (anchor, event) grow with the square of their density. Here
what is seen stays one row per event, or per run of sightings that no window passes between, and prefix sums answer every
anchor. A window is [anchor - window_us, anchor], as in ``plans.explain.window_join``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.functions import lookup
from traceframe.operators import lineage
from traceframe.operators.containment import containment_pairs
from traceframe.operators.evidence import TIMELINE_MIN_LEN
from traceframe.operators.ordered import Slices, interval_sums
from traceframe.session import stored

# Kinds of a match, best first: their place in this list is their rank.
KINDS = ("equal", "value_substring", "field_substring")


def spans(anchors: DataFrame, window_us: int) -> DataFrame:
    """trace_id, anchor_id and the borders of each window as lo and hi."""
    timed = anchors.where("mono_time_us IS NOT NULL")
    return timed.select("trace_id", "anchor_id", (F.col("mono_time_us") - window_us).alias("lo"), F.col("mono_time_us").alias("hi"))


def _bucket(time: str, window_us: int) -> Column:
    return F.floor(F.col(time) / window_us)


def _met(window_us: int) -> Column:
    """The stretches of time that a window meets: two, as they are as wide as a window."""
    return F.explode(F.sequence(_bucket("lo", window_us), _bucket("hi", window_us)))


def sighting_cells(sightings: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """First and last sighting (column ``t``, or cells again) per key and stretch of time as wide as a window.

    Whatever lies between the two is less than a window from both, so runs can be told from them.
    """
    first, last = ("first", "last") if "first" in sightings.columns else ("t", "t")
    return sightings.groupBy(*keys, _bucket(first, window_us).alias("cell")).agg(F.min(first).alias("first"), F.max(last).alias("last"))


def runs(cells: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """Runs of sightings that follow each other within a window: keys, first and last.

    No two runs of a key are in one window, and a window that begins and ends between sightings of a run holds one of them.
    A key has at most one row per stretch of time here, however often it is seen.
    """
    order = Window.partitionBy(*keys).orderBy("cell")
    starts = F.coalesce(F.lag("last").over(order) < F.col("first") - window_us, F.lit(True))
    numbered = cells.withColumn("_starts", starts).withColumn("_run", F.sum(F.col("_starts").cast("int")).over(order))
    return numbered.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def overlap_sums(found: DataFrame, asked: DataFrame, keys: list[str], measures: list[str], slices: Slices) -> DataFrame:
    """Per (keys, anchor_id) of ``asked``: sum of each measure over the rows of ``found`` whose [first, last] meets [lo, hi].

    Those that began by ``hi``, less those that ended before ``lo``: the ones open at ``hi``, and the ones that ended inside.
    """
    weight = lambda sign: [(F.col(m) * sign).alias(m) for m in measures]
    point = lambda part, t, sign: F.struct(F.lit(part).alias("part"), F.col(t).alias("t"), *weight(sign))
    ended = point(1, "last", 1)
    long = F.col("first") < F.col("last")
    points = found.select(*keys, F.explode(
        F.when(long, F.array(point(0, "first", 1), point(0, "last", -1), ended)).otherwise(F.array(ended))
    ).alias("p")).select(*keys, "p.*")
    whole = F.struct(F.lit(0).alias("part"), F.lit(float("-inf")).alias("lo"))
    inner = F.struct(F.lit(1).alias("part"), F.col("lo"))
    probes = asked.select(*keys, "anchor_id", "hi", F.explode(F.array(whole, inner)).alias("q")).select(*keys, "anchor_id", "hi", "q.*")
    sums = interval_sums(points, "t", probes, "lo", "hi", [*keys, "part"], measures, ["anchor_id"], slices, distinct=True)
    return sums.groupBy(*keys, "anchor_id").agg(*[F.sum(m).alias(m) for m in measures])


def signers(ops: DataFrame, asked: DataFrame, window_us: int, slices: Slices) -> DataFrame:
    """(trace_id, anchor_id, signer): the script with most computing operations in the window; of equal ones that of the first operation.

    A row per anchor and script, not per operation; only scripts that are equal are looked up by their operations.
    """
    compute = ops.where("compute")
    keys = ["trace_id", "script"]
    near = compute.select(*keys, _bucket("t", window_us).alias("_b")).distinct()
    maybe = asked.withColumn("_b", _met(window_us)).join(near, ["trace_id", "_b"]).drop("_b").distinct()
    points = compute.select(*keys, "t", F.lit(1).cast("bigint").alias("n"))
    counted = interval_sums(points, "t", maybe, "lo", "hi", keys, ["n"], ["anchor_id"], slices, distinct=True).where("n > 0")
    each = Window.partitionBy("trace_id", "anchor_id")
    top = counted.withColumn("_most", F.max("n").over(each)).where("n = _most").withColumn("_equal", F.count(F.lit(1)).over(each))
    top = stored(top.select(*keys, "anchor_id", "lo", "hi", "_equal"), "signers")
    tied = top.where("_equal > 1").withColumn("_b", _met(window_us))
    first = tied.join(compute.withColumn("_b", _bucket("t", window_us)), [*keys, "_b"]).where("t BETWEEN lo AND hi").groupBy(
        *keys, "anchor_id"
    ).agg(F.min("file_index").alias("first_index"))
    chosen = first.groupBy("trace_id", "anchor_id").agg(F.max_by("script", -F.col("first_index")).alias("signer"))
    alone = top.where("_equal = 1").select("trace_id", "anchor_id", F.col("script").alias("signer"))
    return alone.unionByName(chosen)


def signer_scripts(ops: DataFrame, signer: DataFrame) -> DataFrame:
    """(trace_id, script, signer): the scripts whose name holds a signer's. An empty name is in every one."""
    scripts = stored(ops.select("trace_id", "script").distinct(), "scripts")
    named = signer.select("trace_id", "signer").distinct()
    inside = containment_pairs(
        scripts.withColumn("text", F.col("script")), named.withColumn("needle", F.col("signer")), ["trace_id"],
        text_id="script", needle_id="signer",
    )
    every = scripts.join(named.where("signer = ''"), "trace_id")
    return stored(inside.select("trace_id", "script", "signer").unionByName(every.select("trace_id", "script", "signer")), "signer-scripts")


def operation_counts(ops: DataFrame, refs: DataFrame, asked: DataFrame, signer: DataFrame, window_us: int, slices: Slices) -> DataFrame:
    """Per anchor: operations in its window, those of its signer's scripts, and the edges and inputs of the graph of these.

    ``refs``: trace_id, script, mono_time_us, op, key, value. An input is a reference that operations of the window ask for and
    none of them makes: the distinct ones asked or made, less the distinct ones made.
    """
    keys = ["trace_id", "signer"]
    by_signer = signer_scripts(ops, signer)
    none = lambda *names: [F.lit(0).cast("bigint").alias(n) for n in names]
    one = lambda n: F.lit(1).cast("bigint").alias(n)
    at = [F.col("t").alias("first"), F.col("t").alias("last")]
    # Operations of every script are those of a signer without a name; the graph is asked of true signers only.
    every = ops.select("trace_id", F.lit(None).cast("string").alias("signer"), *at, one("ops"), *none("edges", "inputs"))
    own = ops.join(by_signer, ["trace_id", "script"]).select(*keys, *at, one("ops"), *none("edges", "inputs"))
    edges = lineage.dag(refs, ["trace_id", "script", "mono_time_us"])[0].withColumnRenamed("mono_time_us", "t")
    edges = edges.join(by_signer, ["trace_id", "script"]).select(*keys, *at, *none("ops"), one("edges"), *none("inputs"))
    # Kind 1: made. Kind 0: made or asked for.
    makes = F.col("key") == "result_ref"
    kinds = F.when(makes, F.array(F.lit(0), F.lit(1))).when(lineage.is_input_ref(F.col("key")), F.array(F.lit(0)))
    seen = refs.select("trace_id", "script", F.col("value").alias("ref"), F.col("mono_time_us").alias("t"), F.explode(kinds).alias("kind"))
    cells = sighting_cells(seen, ["trace_id", "script", "ref", "kind"], window_us)
    cells = cells.join(by_signer, ["trace_id", "script"])
    item = [*keys, "ref", "kind"]
    runs_ = runs(sighting_cells(cells, item, window_us), item, window_us)
    inputs = runs_.select(*keys, "first", "last", *none("ops", "edges"), F.when(F.col("kind") == 0, 1).otherwise(-1).cast("bigint").alias("inputs"))
    found = reduce(DataFrame.unionByName, [every, own, edges, inputs])
    questions = asked.join(signer, ["trace_id", "anchor_id"]).unionByName(asked.withColumn("signer", F.lit(None).cast("string")))
    sums = overlap_sums(found, questions, keys, ["ops", "edges", "inputs"], slices)
    of = lambda name, when: F.nullif(F.sum(F.when(when, F.col(name))), F.lit(0).cast("bigint"))
    everything = F.col("signer").isNull()
    return sums.groupBy("anchor_id").agg(
        of("ops", everything).alias("window_ops_all_scripts"), of("ops", ~everything).alias("window_ops"),
        of("edges", ~everything).alias("dag_edges"), of("inputs", ~everything).alias("dag_inputs"),
    )


def text_pairs(strings: DataFrame, fields: DataFrame) -> DataFrame:
    """(trace_id, value_id, field_id, rank): which string stands in which relation to which field text; see ``KINDS``.

    Each distinct text of a trace is searched once, whichever anchors see it: a text holds at most as many others as it has parts.
    """
    values = stored(strings.groupBy("trace_id", "value_id").agg(F.any_value("value").alias("value")), "values")
    texts = stored(fields.groupBy("trace_id", "field_id").agg(F.any_value("field_value").alias("field_value")), "fields")
    equal = values.select("trace_id", "value_id").join(
        texts.select("trace_id", F.col("field_id").alias("value_id")).hint("merge"), ["trace_id", "value_id"]
    ).withColumn("field_id", F.col("value_id"))
    inside = containment_pairs(texts, values, ["trace_id"], "field_value", "value", "field_id", "value_id")
    around = containment_pairs(values, texts, ["trace_id"], "value", "field_value", "value_id", "field_id")
    ranked = [equal, *[df.where("value_id <> field_id") for df in (inside, around)]]
    names = ["trace_id", "value_id", "field_id"]
    return reduce(DataFrame.unionByName, [df.select(*names, F.lit(rank).alias("rank")) for rank, df in enumerate(ranked)])


def field_evidence(strings: DataFrame, fields: DataFrame, asked: DataFrame, window_us: int, slices: Slices) -> DataFrame:
    """(anchor_id, label, rank): the best kind of match that each field has with the strings of its anchor's window.

    ``strings``: trace_id, t, value, one row per sighting; ``fields``: trace_id, anchor_id, label, field_value. A string
    counts for the fields of its best kind only, of all fields of the anchor, as in ``evidence.field_matches``.
    """
    digest = lambda c: F.substring(F.unhex(F.sha2(F.encode(F.col(c), "UTF-8"), 256)), 1, 16)
    strings = strings.withColumn("value_id", digest("value"))
    fields = fields.where(F.length("field_value") > 0).withColumn("field_id", digest("field_value"))
    pairs = stored(text_pairs(strings, fields), "text-pairs")
    best = pairs.groupBy("trace_id", "value_id").agg(F.min("rank").alias("_best"))
    ranked = pairs.join(best.hint("merge"), ["trace_id", "value_id"])
    wanted = stored(fields.select("trace_id", "anchor_id", "field_id").distinct().join(asked, ["trace_id", "anchor_id"]), "field-spans")
    # A pair that no field of the trace betters holds for every anchor that has the field.
    keys = ["trace_id", "field_id"]
    cells = sighting_cells(strings, ["trace_id", "value_id"], window_us)
    clear = ranked.where("rank = _best").select("trace_id", "value_id", "field_id", "rank")
    cells = sighting_cells(cells.join(clear.hint("merge"), ["trace_id", "value_id"]), [*keys, "rank"], window_us)
    marks = [(F.col("rank") == rank).cast("bigint").alias(f"_{rank}") for rank in range(len(KINDS))]
    names = [f"_{rank}" for rank in range(len(KINDS))]
    found = runs(cells, [*keys, "rank"], window_us).select(*keys, "first", "last", *marks)
    sums = overlap_sums(found, wanted, keys, names, slices)
    rank = reduce(lambda otherwise, r: F.when(F.col(f"_{r}") > 0, r).otherwise(otherwise), reversed(range(len(KINDS))), F.lit(None).cast("int"))
    direct = sums.select("anchor_id", "field_id", rank.alias("rank")).where("rank IS NOT NULL")
    # The others hold where the anchor has none of the better fields: those strings meet their anchors one by one.
    vague = ranked.where("rank > _best").select("trace_id", "value_id", "field_id", "rank")
    seen = strings.select("trace_id", "value_id", "t").join(vague.hint("merge"), ["trace_id", "value_id"])
    near = wanted.withColumn("_b", _met(window_us))
    met = seen.withColumn("_b", _bucket("t", window_us)).join(near.hint("merge"), [*keys, "_b"]).where("t BETWEEN lo AND hi")
    met = met.select("trace_id", "anchor_id", "value_id", "field_id", "rank").distinct()
    others = pairs.select("trace_id", "value_id", F.col("field_id").alias("other"), F.col("rank").alias("better"))
    bettered = met.select("trace_id", "anchor_id", "value_id", "rank").distinct().join(others.hint("merge"), ["trace_id", "value_id"]).where(
        "better < rank"
    ).join(
        wanted.select("trace_id", "anchor_id", F.col("field_id").alias("other")).hint("merge"), ["trace_id", "anchor_id", "other"], "left_semi"
    ).select("anchor_id", "value_id", "rank").distinct()
    left = met.join(bettered.hint("merge"), ["anchor_id", "value_id", "rank"], "left_anti").select("anchor_id", "field_id", "rank")
    ranks = direct.unionByName(left).groupBy("anchor_id", "field_id").agg(F.min("rank").alias("rank"))
    return fields.select("anchor_id", "label", "field_id").join(ranks, ["anchor_id", "field_id"]).select("anchor_id", "label", "rank")


def evidence_kinds(leaf_fields: DataFrame, ranks: DataFrame) -> DataFrame:
    """Leaf fields with their evidence, as ``evidence.pairing`` names it."""
    named = F.when(F.col("rank") == 0, "direct").when(F.col("rank") == 1, "composite").when(F.col("rank") == 2, "context_only")
    return leaf_fields.join(ranks, ["anchor_id", "label"], "left").withColumn("evidence", named.otherwise("unpaired")).drop("rank")


def members(usable: DataFrame) -> DataFrame:
    """Members of the first argument that are references or strings of a timeline, one row each."""
    entries = F.map_entries(F.try_variant_get("arg0", "$", "map<string,variant>"))
    rows = usable.select("trace_id", "file_index", "mono_time_us", "script", F.explode(entries).alias("m"))
    rows = rows.select(
        "trace_id", "file_index", "mono_time_us", "script", F.col("m.key").alias("key"),
        (F.schema_of_variant("m.value") == "STRING").alias("is_text"), F.try_variant_get("m.value", "$", "string").alias("value"),
    ).where("value IS NOT NULL")
    in_timeline = F.col("is_text") & (F.length("value") >= TIMELINE_MIN_LEN) & ~F.col("key").isin(*lookup.PROVENANCE_KEYS)
    return rows.withColumn("in_timeline", in_timeline).drop("is_text").where(in_timeline | F.col("key").endswith("_ref"))
