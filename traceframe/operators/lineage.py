"""Value lineage: the graph of references between operations, and walks over it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions import lookup, text
from traceframe.session import cut_lineage, stored


def argument_refs(ops: DataFrame, keep: list[str]) -> DataFrame:
    """Scalar members of the first argument as (keep..., op, key, value)."""
    members = F.map_entries(F.try_variant_get("arg0", "$", "map<string,variant>"))
    rows = ops.select(*keep, F.col("file_index").alias("op"), F.explode(members).alias("m"))
    return rows.select(
        *keep, "op", F.col("m.key").alias("key"), F.try_variant_get(F.col("m.value"), "$", "string").alias("value")
    ).where("value IS NOT NULL")


def is_input_ref(key: Column) -> Column:
    """Every key ending in ``_ref`` except the result ones is an input."""
    return key.endswith("_ref") & ~key.isin(*lookup.RESULT_REF_KEYS)


def dag(refs: DataFrame, keys: list[str]):
    """(edges, producers, inputs, first values) of long reference rows.

    Edges gather an operation's members, so a group is as large as one argument object; inputs and values only need
    its result and its pairs.
    """
    is_ref = is_input_ref(F.col("key"))
    is_result = F.col("key") == "result_ref"
    per_op = refs.where(F.col("key").endswith("_ref")).groupBy("op", *keys).agg(
        F.max(F.when(is_result, F.col("value"))).alias("to"),
        F.collect_list(F.when(is_ref, F.struct("key", "value"))).alias("ins"),
    )
    used = per_op.select(*keys, "op", "to", F.explode("ins").alias("i")).select(
        *keys, "op", "to", F.col("i.value").alias("from"), F.regexp_replace("i.key", "_ref$", "").alias("role")
    ).where("to IS NULL OR from <> to")
    edges = used.where("to IS NOT NULL").select(*keys, "from", "to", "role", "op")
    # A null reference is an input of operations without a result only; any other is one unless some operation makes it.
    ends = refs.where(is_result | (is_ref & F.col("value").isNull())).select(*keys, "op", "value", is_ref.alias("is_ref"))
    results = _beside(ends, keys).groupBy("op", *keys).agg(
        F.max(F.when(~F.col("is_ref"), F.col("value"))).alias("ref"), F.max("is_ref").alias("asks")
    ).where("ref IS NOT NULL OR asks")
    producers = results.where("ref IS NOT NULL").groupBy(*keys, "ref").agg(F.min("op").alias("op"))
    asked = refs.where(is_ref & F.col("value").isNotNull()).select(*keys, F.col("value").alias("ref"), F.lit(False).alias("made"))
    seen = asked.unionByName(results.select(*keys, "ref", F.col("ref").isNotNull().alias("made")))
    inputs = seen.groupBy(*keys, "ref").agg(F.max("made").alias("made")).where("NOT made").select(*keys, "ref")
    return edges, producers, inputs, first_values(refs, keys)


def _beside(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the others of their operation: grouping few rows each, they are sorted once, here, not before they are sent too."""
    return refs.repartition("op", *keys)


def first_values(refs: DataFrame, keys: list[str]) -> DataFrame:
    """First observed value of each reference: member ``x`` beside ``x_ref``."""
    is_ref = F.col("key").endswith("_ref")
    of_base = [k for base in lookup.VALUE_BASES for k in (base, f"{base}_ref")]
    base = F.when(is_ref, F.expr("left(key, length(key) - 4)")).otherwise(F.col("key"))
    rank = F.array_position(F.array(*[F.lit(b) for b in lookup.VALUE_BASES]), base)
    tagged = refs.where(F.col("key").isin(of_base)).select(*keys, "op", rank.alias("rank"), is_ref.alias("is_ref"), "value")
    pairs = _beside(tagged, keys).groupBy("op", "rank", *keys).agg(
        F.max(F.when(F.col("is_ref"), F.col("value"))).alias("ref"),
        F.max(F.when(~F.col("is_ref"), F.col("value"))).alias("value"),
    ).where("ref IS NOT NULL AND value IS NOT NULL")
    ordered = F.struct("op", "rank", "value")
    return pairs.groupBy("ref", *keys).agg(F.min(ordered).alias("f")).select(
        *keys, "ref", F.col("f.value").alias("value")
    )


def ref_materials(refs_used: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Each reference with its first observed value, else the literal it spells."""
    joined = refs_used.select(*keys, "ref").distinct().join(values, [*keys, "ref"], "left")
    lit = text.ref_literal(F.col("ref"))
    return joined.withColumn("value", F.coalesce("value", lit["text"]))


# --- walks backward over edges
#
# Nodes that are reached from one other node only, as in chains and trees, are taken out first: an independent quarter of
# them each round, so all rounds together go through about four times the edges. Each ends up with the node that is left
# before it and the number of edges to it, and gets its result from there.
#
# Over the nodes that are left rounds double their stride: beside what is reached so far (all walks shorter than 2^k)
# there are jumps, the pairs of nodes that a walk of exactly 2^k edges connects, with their least length. Following jumps
# once reaches all walks shorter than 2^(k+1), and jumps joined with themselves are those of the next round. A shortest walk
# splits into strides of powers of two, so hops stay minimal; a round that changes nothing is the last, also on cycles.

# Nodes reached from one other node only that need not be taken out: doubling is quicker for so few.
FEW_LONE = 50_000


def _jumps(edges: DataFrame, starts: DataFrame, few: int) -> tuple[DataFrame, DataFrame | None]:
    """(jumps, taken): edges as (_from, _to, _length) between the nodes left, and nodes taken out as (_node, _onto, _off), or None.

    A node that one other node leads to, and no start, is taken out: whatever reaches ``_onto`` reaches it ``_off`` edges later.
    """
    one = F.lit(1).alias("_length")
    hops = edges.select(F.col("from").alias("_from"), F.col("to").alias("_to")).where(~F.col("_from").eqNullSafe(F.col("_to")))
    if hops.schema["_from"].dataType != hops.schema["_to"].dataType:
        return cut_lineage(hops.distinct().select("*", one)), None
    # Nulls are no node that a walk goes on from.
    ends = hops.where("_from is not null").groupBy("_from").agg(F.min("_to").alias("_to"), F.max("_to").alias("_last"))
    lone = ends.where("_to = _last").join(starts.select(F.col("node").alias("_from")), "_from", "left_anti").select("_from", "_to", one)
    lone = stored(lone, "lone-edges")
    if lone.count() <= few:
        return cut_lineage(hops.distinct().select("*", one)), None
    rest = stored(hops.join(lone.select("_from"), "_from", "left_anti").distinct().select("*", one), "other-edges")
    cuts = []
    while not cuts or lone.count() > few:
        heads = lambda c: F.xxhash64(c, F.lit(len(cuts))).bitwiseAND(F.lit(1).cast("bigint")) == 1  # noqa: E731, B023
        out = F.coalesce(heads("_from") & ~heads("_to"), F.lit(False))
        cut = lone.where(out).select(F.col("_from").alias("_node"), F.col("_to").alias("_onto"), F.col("_length").alias("_off"))
        lone = stored(_redirected(lone.where(~out), cut), "lone-edges")
        cuts.append(cut)
    # Nodes taken out late are those that earlier ones were put onto.
    taken = None
    for cut in reversed(cuts):
        if taken is not None:
            later = taken.select(F.col("_node").alias("_onto"), F.col("_onto").alias("_left"), F.col("_off").alias("_more"))
            cut = cut.join(later, "_onto", "left").select(
                "_node", F.coalesce("_left", "_onto").alias("_onto"), (F.col("_off") + F.coalesce("_more", F.lit(0))).alias("_off")
            )
        cut = stored(cut, "taken-nodes")
        taken = cut if taken is None else taken.unionByName(cut)
    left = _redirected(rest, taken).unionByName(lone)
    return cut_lineage(left.groupBy("_from", "_to").agg(F.min("_length").alias("_length"))), taken


def _redirected(hops: DataFrame, cut: DataFrame) -> DataFrame:
    """Edges that came from a node taken out come from the node before it; those that then lead to their own node are no walk."""
    onto = cut.select(F.col("_node").alias("_to"), "_onto", "_off")
    moved = hops.join(onto, "_to", "left").select(
        "_from", F.coalesce("_onto", "_to").alias("_to"), (F.col("_length") + F.coalesce("_off", F.lit(0))).alias("_length")
    )
    return moved.where(~F.col("_from").eqNullSafe(F.col("_to")))


def _doubled(jumps: DataFrame) -> DataFrame:
    near = jumps.select("_from", F.col("_to").alias("_by"), F.col("_length").alias("_more"))
    far = jumps.select(F.col("_from").alias("_by"), "_to", "_length")
    pairs = near.join(far, "_by").select("_from", "_to", (F.col("_length") + F.col("_more")).alias("_length"))
    return cut_lineage(pairs.groupBy("_from", "_to").agg(F.min("_length").alias("_length")))


def reach(anchors: DataFrame, edges: DataFrame, anchor: str = "anchor_id", few: int = FEW_LONE) -> tuple[DataFrame, int]:
    """(closure, rounds): see ``closure``; rounds are the logarithm of the longest shortest walk over the nodes left, plus one.

    ``few`` nodes that are reached from one other node only are not taken out beforehand; the closure does not depend on it.
    """
    starts = anchors.select(anchor, "node").distinct()
    jumps, taken = _jumps(edges, starts, few)
    reached = cut_lineage(starts.withColumn("hop", F.lit(0)))
    size = lambda df: df.agg(F.count(F.lit(1)), F.sum("hop")).first()
    known = size(reached)
    for rounds in count(1):
        further = reached.join(jumps, F.col("node") == F.col("_to")).select(anchor, F.col("_from").alias("node"), (F.col("hop") + F.col("_length")).alias("hop"))
        reached = cut_lineage(reached.unionByName(further).groupBy(anchor, "node").agg(F.min("hop").alias("hop")))
        before, known = known, size(reached)
        if known == before:
            break
        jumps = _doubled(jumps)
    if taken is not None:
        behind = reached.join(taken, F.col("node") == F.col("_onto")).select(anchor, F.col("_node").alias("node"), (F.col("hop") + F.col("_off")).alias("hop"))
        reached = reached.unionByName(behind)
    return reached, rounds


def closure(anchors: DataFrame, edges: DataFrame, anchor: str = "anchor_id") -> DataFrame:
    """Nodes reachable backward (to <- from) from each anchor's nodes, with their least hop.

    Narrow, de-duplicated pairs; each round is checkpointed or stored, so a lost executor recomputes one round and the plan
    does not grow.
    """
    return reach(anchors, edges, anchor)[0]


# Anchors whose marks share one whole number on a node.
WORD = 64


def shared_reach(starts: DataFrame, edges: DataFrame, few: int = FEW_LONE) -> DataFrame:
    """(node, word, bits): which of the numbered starts reach each node backward.

    ``starts`` is (number, node). A node has one row for up to 64 starts, not one for each, so ancestors that many starts
    share are walked once for all of them.
    """
    jumps, taken = _jumps(edges, starts, few)
    bit = F.expr(f"shiftleft(1L, cast(number % {WORD} as int))")
    marks = starts.select("node", F.expr(f"number div {WORD}").alias("word"), bit.alias("bits"))
    marks = cut_lineage(marks.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    set_bits = lambda df: df.agg(F.sum(F.bit_count("bits"))).first()[0]
    known = set_bits(marks)
    while True:
        further = marks.join(jumps, F.col("node") == F.col("_to")).select(F.col("_from").alias("node"), "word", "bits")
        marks = cut_lineage(marks.unionByName(further).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
        before, known = known, set_bits(marks)
        if known == before:
            break
        jumps = _doubled(jumps)
    if taken is not None:
        behind = marks.join(taken, F.col("node") == F.col("_onto")).select(F.col("_node").alias("node"), "word", "bits")
        marks = marks.unionByName(behind)
    return marks


def field_subdag(fields: DataFrame, values: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges that lead to each field's value.

    ``fields`` is (anchor_id, field, value); a field starts at every reference whose first value equals it. ``keys`` are
    equality columns of all three tables: graphs of different keys are apart.
    """
    keys = keys or []
    node = lambda c: F.struct(*keys, F.col(c).alias("ref"))
    named = fields.select(*dict.fromkeys(["anchor_id", "field", *keys]), "value").join(values.select(*keys, "ref", "value"), [*keys, "value"])
    named = cut_lineage(named.select("anchor_id", "field", node("ref").alias("node")))
    # Fields of an anchor get neighbouring numbers, as they share most ancestors.
    listed = named.select("anchor_id", "field").distinct().orderBy("anchor_id", "field")
    numbers = cut_lineage(listed.withColumn("number", F.monotonically_increasing_id()))
    graph = cut_lineage(edges.select(node("from").alias("from"), node("to").alias("to"), "role", "op"))
    marks = shared_reach(named.join(numbers, ["anchor_id", "field"]).select("number", "node"), graph)
    hit = graph.join(marks, F.col("to") == F.col("node")).select("from", "to", "role", "op", "word", "bits")
    bits = F.expr(f"filter(sequence(0, {WORD - 1}), b -> getbit(bits, b) = 1)")
    each = hit.select("from", "to", "role", "op", "word", F.explode(bits).alias("bit"))
    each = each.withColumn("number", F.col("word") * WORD + F.col("bit"))
    return each.join(numbers, "number").select("anchor_id", "field", F.col("from.ref").alias("from"), F.col("to.ref").alias("to"), "role", "op").distinct()
