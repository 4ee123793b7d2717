"""Label sequences: order checks, adjacent pairs, and rolling repeats into loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceframe.operators.ordered import dense_index, with_next, with_previous
from traceframe.operators.profile import top_k
from traceframe.session import cut_lineage

# Fixed value: longest loop body looked for.
MAX_PERIOD = 8
CHUNK = 65_536
# Chunks (then stretches of them) whose maps are composed in one group.
FAN = 256


def non_monotonic(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not above that of the row before (0 before the first)."""
    seen = with_previous(rows, keys, order, [value])
    before = F.coalesce(F.col(f"prev_{value}"), F.lit(0))
    return seen.withColumn(f"prev_{value}", before).where(F.col(value) <= before)


def label_sequence(inside: DataFrame, opcode_table: DataFrame) -> DataFrame:
    """Window events in file order labelled ``opcode:shape``; unlabelled ones drop out."""
    labels = opcode_table.select(
        "trace_id", "url", "function", "line", "column",
        F.concat(F.col("opcode").cast("string"), F.lit(":"), "shape").alias("label"),
    )
    site = ["url", "function", "line", "column"]
    right = labels.select(F.col("trace_id").alias("_r_trace"), *[F.col(c).alias(f"_r_{c}") for c in site], "label")
    cond = F.col("trace_id") == F.col("_r_trace")
    for c in site:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return inside.join(right, cond).select("trace_id", "session_id", "file_index", "label")


def bigrams(rows: DataFrame, keys: list[str], order: list[str], label: str, k: int | None = 20, scope: list[str] | None = None) -> DataFrame:
    """Counts of adjacent label pairs inside each key, k most frequent per scope."""
    scope = keys if scope is None else scope
    pairs = with_next(rows, keys, order, [label]).where(F.col(f"next_{label}").isNotNull())
    counted = pairs.groupBy(*scope, F.col(label).alias("from"), F.col(f"next_{label}").alias("to")).agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct(*keys, *order)).alias("first_at")
    )
    return counted if k is None else top_k(counted, scope, k, F.desc("count"), F.asc("first_at"))


# --- loops -------------------------------------------------------------------
#
# The rolling is greedy from left to right: at each position the shortest block
# that repeats at once is taken with all its repeats, else one label stands alone.
# Where a step from position i leads depends on i alone, namely on how far the
# sequence keeps matching itself at distance p (p = 1..max_period). So the sequence
# is cut into chunks of bounded size; every chunk works out where each possible
# entry leaves it; these finite maps are composed for neighbours, in rounds, so the
# walk is followed through stretches of chunks and then inside them; and a last
# pass writes the blocks. A session of any length is spread over its chunks.


def _self_match(codes: np.ndarray, size: int, total_left: int, p: int) -> np.ndarray:
    """Local positions j < size where label j and label j + p differ or p runs past the end."""
    known = min(len(codes) - p, size)
    bad = np.ones(size, dtype=bool)
    if known > 0:
        bad[:known] = codes[:known] != codes[p : p + known]
    # Positions whose partner lies past the end of the whole sequence stay marked.
    return np.flatnonzero(bad)


def _codes(labels, head) -> np.ndarray:
    return pd.factorize(np.array([*labels, *head], dtype=object))[0]


def _next_step(codes, size, start, later, max_period):
    """Per local position: where the greedy step leads (global) and its period (0 = single)."""
    here = np.arange(size, dtype=np.int64)
    target = here + start + 1
    period = np.zeros(size, dtype=np.int64)
    ends = []
    for p in range(1, max_period + 1):
        bad = _self_match(codes, size, 0, p)
        at = np.searchsorted(bad, here)
        run_end = np.where(at < len(bad), np.append(bad, 0)[np.minimum(at, len(bad))] + start, later[p - 1])
        ends.append(int(run_end[0]))
        length = run_end - (here + start)
        hit = (period == 0) & (length >= p)
        period[hit] = p
        target[hit] = (here + start)[hit] + p * (length[hit] // p + 1)
    return target, period, ends


def _first_mismatches(max_period: int):
    def run(batches):
        for pdf in batches:
            firsts = []
            for labels, head, start in zip(pdf["labels"], pdf["head"], pdf["start"]):
                codes = _codes(labels, head if head is not None else [])
                row = []
                for p in range(1, max_period + 1):
                    bad = _self_match(codes, len(labels), 0, p)
                    row.append(int(bad[0] + start) if len(bad) else None)
                firsts.append(row)
            out = pdf.drop(columns=["labels", "head", "start"])
            out["firsts"] = firsts
            yield out

    return run


def _entry_exits(max_period: int, key_names: list[str]):
    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                labels, head, start = rec["labels"], rec["head"], int(rec["start"])
                size = len(labels)
                end = start + size
                codes = _codes(labels, head if head is not None else [])
                later = [int(x) if x is not None and x == x else end for x in rec["later"]]
                target, period, ends = _next_step(codes, size, start, later, max_period)
                # Pointer doubling inside the chunk: first position at or past its end.
                leave = target.copy()
                while True:
                    inside = leave < end
                    if not inside.any():
                        break
                    leave[inside] = leave[leave[inside] - start]
                entries = set(range(start, min(start + max_period, end)))
                for p, e in enumerate(ends, 1):
                    entries.update(x for x in range(e + 1, e + p + 1) if start <= x < end)
                for entry in sorted(entries):
                    # Trailing straight stretch: singles up to the chunk end.
                    tail = None
                    if leave[entry - start] == end and period[size - 1] == 0:
                        tail = _tail_start(target, period, start, end, entry)
                    rows.append((
                        *[rec[k] for k in key_names], rec["chunk"], entry, int(leave[entry - start]),
                        bool(period[entry - start] == 0), tail,
                    ))
            yield pd.DataFrame(rows, columns=[*key_names, "chunk", "entry", "exit", "head_single", "tail"])

    return run


def _tail_start(target, period, start, end, entry) -> int | None:
    tail, pos = None, entry
    while pos < end:
        if period[pos - start] == 0:
            tail = pos if tail is None else tail
        else:
            tail = None
        pos = int(target[pos - start])
    return tail


# What a walk does to the straight block that is open when it enters (None: none is): it ends it, leaving ``value``
# open instead (None: nothing), or, all singles, it ``carries`` it on and opens ``value`` only where none was open.


def _carried(opened, carries: bool, value):
    return opened if carries and opened is not None else value


def _compose(key_names: list[str]):
    """The map of a stretch of units from the maps of its units: one row per entry, followed to where it leaves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry", ascending=False)
        done: dict[int, tuple] = {}
        for entry, leave, carries, value in zip(*[pdf[c].tolist() for c in ("entry", "exit", "carries", "value")]):
            value = None if value != value else value
            # Units behind this one are composed already, so one look-up leads out of the stretch.
            if leave in done:
                out, then_carries, then = done[leave]
                carries, value = carries and then_carries, _carried(value, then_carries, then)
                leave = out
            done[entry] = (leave, carries, value)
        out = pd.DataFrame([(e, *m) for e, m in done.items()], columns=["entry", "exit", "carries", "value"])
        out["value"] = out["value"].astype("Int64")
        for k in [*key_names, "unit"]:
            out[k] = pdf[k].iloc[0] if k != "unit" else pdf["stretch"].iloc[0]
        return out[[*key_names, "unit", "entry", "exit", "carries", "value"]]

    return run


def _walk(key_names: list[str]):
    """The entries of a stretch's units on the one walk that passes it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        pos, opened = first["at"], first["opened"]
        table = dict(zip(pdf["entry"].tolist(), zip(*[pdf[c].tolist() for c in ("unit", "exit", "carries", "value")])))
        pos = None if pos is None or pos != pos else int(pos)
        opened = None if opened is None or opened != opened else int(opened)
        visits = []
        while pos in table:
            unit, leave, carries, value = table[pos]
            visits.append((*[first[k] for k in key_names], unit, pos, opened))
            pos, opened = leave, _carried(opened, carries, None if value != value else int(value))
        out = pd.DataFrame(visits, columns=[*key_names, "unit", "at", "opened"])
        out["opened"] = out["opened"].astype("Int64")
        return out

    return run


def _visited(exits: DataFrame, keys: list[str], units: int, fan: int) -> DataFrame:
    """(keys, chunk, entry, opened): where the greedy walk of each key enters its chunks.

    ``exits`` are maps of chunks; ``units`` is the largest number of chunks of a key. Maps of ``fan`` neighbours are composed
    into one, again and again, until one stretch is left; then the walk is followed back down. A group is one stretch, so
    no task holds more than ``fan`` units of a key, and rounds are the logarithm of the chunks.
    """
    types = {f.name: f for f in exits.schema}
    base = [types[k] for k in keys]
    unit, entry = T.StructField("unit", T.LongType()), T.StructField("entry", T.LongType())
    map_type = T.StructType([*base, unit, entry, T.StructField("exit", T.LongType()), T.StructField("carries", T.BooleanType()), T.StructField("value", T.LongType())])
    visit_type = T.StructType([*base, unit, T.StructField("at", T.LongType()), T.StructField("opened", T.LongType())])
    leaf = F.coalesce(F.col("head_single") & (F.col("tail") == F.col("entry")), F.lit(False))
    level = cut_lineage(exits.select(*keys, F.col("chunk").alias("unit"), "entry", "exit", leaf.alias("carries"), F.col("tail").alias("value")))
    levels = [level]
    while -(-units // fan) > 1:
        units = -(-units // fan)
        stretches = level.withColumn("stretch", F.floor(F.col("unit") / fan))
        level = cut_lineage(stretches.groupBy(*keys, "stretch").applyInPandas(_compose(keys), map_type))
        levels.append(level)
    visits = exits.select(*keys).distinct().select("*", F.lit(0).cast("bigint").alias("stretch"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("opened"))
    for level in reversed(levels):
        stretches = level.withColumn("stretch", F.floor(F.col("unit") / fan))
        entered = _on_keys(stretches, visits, [*keys, "stretch"])
        walked = entered.groupBy(*keys, "stretch").applyInPandas(_walk(keys), visit_type)
        visits = walked.withColumnRenamed("unit", "stretch")
    heads = exits.select(*keys, F.col("chunk").alias("stretch"), F.col("entry").alias("at"), "head_single")
    found = _on_keys(visits, heads, [*keys, "stretch", "at"])
    return found.select(*keys, F.col("stretch").alias("chunk"), F.col("at").alias("entry"), F.when(F.col("head_single"), F.col("opened")).alias("opened"))


def _on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the keys come once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _first_after(rows: DataFrame, keys: list[str], unit: str, values: list[str], units: int, fan: int) -> DataFrame:
    """Each row's nearest value that is not NULL in a later unit of its key, for every value column.

    Windows see ``fan`` units of a key; what lies beyond comes from one row per stretch, treated the same way.
    """
    stretch = f"{unit}_stretch"
    rows = rows.withColumn(stretch, F.floor(F.col(unit) / fan))
    behind = Window.partitionBy(*keys, stretch).orderBy(F.desc(unit)).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select("*", *[F.last(v, ignorenulls=True).over(behind).alias(f"_near_{v}") for v in values])
    if units > fan:
        firsts = rows.groupBy(*keys, stretch).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(unit))).alias(v) for v in values])
        beyond = _first_after(firsts, keys, stretch, values, -(-units // fan), fan)
        beyond = beyond.select(*keys, stretch, *[F.col(v).alias(f"_beyond_{v}") for v in values])
        near = _on_keys(near, beyond, [*keys, stretch])
        found = [F.coalesce(f"_near_{v}", f"_beyond_{v}").alias(v) for v in values]
    else:
        found = [F.col(f"_near_{v}").alias(v) for v in values]
    return near.select(*keys, unit, *found)


def _pieces(max_period: int, key_names: list[str]):
    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                labels, head, start = list(rec["labels"]), rec["head"], int(rec["start"])
                size = len(labels)
                end = start + size
                head = list(head) if head is not None else []
                later = [int(x) if x is not None and x == x else end for x in rec["later"]]
                target, period, _ = _next_step(_codes(labels, head), size, start, later, max_period)
                keys = [rec[k] for k in key_names]
                text = labels + head
                pos = int(rec["entry"])
                opened = rec["opened"]
                opened = None if opened is None or opened != opened else int(opened)
                straight = None
                while pos < end:
                    p = int(period[pos - start])
                    nxt = int(target[pos - start])
                    if p == 0:
                        straight = pos if straight is None else straight
                    else:
                        if straight is not None:
                            rows.append(_straight(keys, opened, straight, pos, text, start))
                        straight, opened = None, None
                        rows.append((
                            *keys, pos, pos, "loop", text[pos - start : pos - start + p],
                            (nxt - pos) // p, nxt - pos,
                        ))
                    pos = nxt
                if straight is not None:
                    rows.append(_straight(keys, opened, straight, end, text, start))
            yield pd.DataFrame(
                rows, columns=[*key_names, "block_start", "piece_start", "kind", "body", "repeat", "ops"]
            )

    return run


def _straight(keys, opened, begin, stop, text, start):
    return (
        *keys, begin if opened is None else opened, begin, "straight",
        text[begin - start : stop - start], 1, stop - begin,
    )


def roll_loops(
    rows: DataFrame, keys: list[str], order: list[str], label: str,
    max_period: int = MAX_PERIOD, chunk: int = CHUNK, fan: int = FAN,
) -> DataFrame:
    """Blocks of each key's sequence: straight stretches and ``body x repeat`` loops.

    One row per piece (keys, block_start, piece_start, kind, body, repeat, ops). A
    loop is one piece; a straight block that crosses chunks has one piece per chunk,
    all with the same ``block_start``. The chunks are stored once, in the checkpoint folder; how many the longest key
    has (one number) decides the rounds in which their maps are composed.
    """
    if chunk < 2 * max_period:
        raise ValueError("chunk must hold two bodies of the longest period")
    numbered = dense_index(rows.select(*keys, *order, label), keys, order, "pos")
    member = F.struct("pos", F.col(label).alias("label"))
    grouped = numbered.groupBy(*keys, F.floor(F.col("pos") / chunk).alias("chunk")).agg(
        F.array_sort(F.collect_list(member)).alias("m")
    )
    chunks = cut_lineage(grouped.select(
        *keys, "chunk", F.col("m")[0]["pos"].alias("start"), F.transform("m", lambda x: x["label"]).alias("labels")
    ))
    units = 1 + (chunks.agg(F.max("chunk")).first()[0] or 0)
    if units > 1:
        heads = chunks.select(*keys, (F.col("chunk") - 1).alias("chunk"), F.slice("labels", 1, max_period).alias("head"))
        chunks = _on_keys(chunks, heads, [*keys, "chunk"], "left")
    else:
        chunks = chunks.withColumn("head", F.lit(None).cast("array<string>"))

    types = {f.name: f for f in chunks.schema}
    base = [types[k] for k in keys]
    long = T.LongType()
    if units > 1:
        firsts = cut_lineage(chunks.mapInPandas(
            _first_mismatches(max_period),
            T.StructType([*base, T.StructField("chunk", long), T.StructField("firsts", T.ArrayType(long))]),
        ))
        names = [f"_f{i}" for i in range(max_period)]
        wide = firsts.select(*keys, "chunk", *[F.col("firsts")[i].alias(n) for i, n in enumerate(names)])
        later = _first_after(wide, keys, "chunk", names, units, fan).select(*keys, "chunk", F.array(*names).alias("later"))
        full = cut_lineage(_on_keys(chunks, later, [*keys, "chunk"]))
        exits = full.mapInPandas(
            _entry_exits(max_period, keys),
            T.StructType([
                *base, T.StructField("chunk", long), T.StructField("entry", long), T.StructField("exit", long),
                T.StructField("head_single", T.BooleanType()), T.StructField("tail", long),
            ]),
        )
        entered = _on_keys(full, _visited(exits, keys, units, fan), [*keys, "chunk"])
    else:
        # Every sequence is one chunk, entered at its start.
        none = F.lit(None).cast("bigint")
        entered = chunks.select("*", F.array(*[none] * max_period).alias("later"), F.lit(0).cast("bigint").alias("entry"), none.alias("opened"))
    return entered.mapInPandas(
        _pieces(max_period, keys),
        T.StructType([
            *base, T.StructField("block_start", long), T.StructField("piece_start", long),
            T.StructField("kind", T.StringType()), T.StructField("body", T.ArrayType(T.StringType())),
            T.StructField("repeat", long), T.StructField("ops", long),
        ]),
    )


def blocks(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block; the body is kept for loops."""
    return pieces.groupBy(*keys, "block_start", "kind").agg(
        F.sum("ops").alias("ops"), F.max("repeat").alias("repeat"),
        F.max(F.when(F.col("kind") == "loop", F.col("body"))).alias("body"),
    )


def program_summary(pieces: DataFrame, keys: list[str]) -> DataFrame:
    whole = blocks(pieces, keys)
    return whole.groupBy(*keys).agg(
        F.sum("ops").alias("ops_total"), F.count(F.lit(1)).alias("blocks_total"),
        F.coalesce(F.sum(F.when(F.col("kind") == "loop", F.col("ops"))), F.lit(0)).alias("loop_ops"),
    )
