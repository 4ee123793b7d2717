"""Flattening of nested JSON values into one row per leaf.

JSON nests without bound and Spark has no built-in for that, so the walk is an
Arrow-batched map: no shuffle, no depth limit, document order kept, booleans apart
from integers, null apart from absent. (Opening VARIANT level by level in SQL was
measured slower: 17 s for ten levels of 100,000 small objects on one core.) Everything after the walk is relational.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, chain
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leaves after which a batch is handed on.
OUT_ROWS = 50_000

_LEAF_FIELDS = (
    ("leaf_no", T.LongType(), pa.int64()),
    ("path", T.StringType(), pa.string()),
    ("keys", T.ArrayType(T.StringType()), pa.list_(pa.string())),
    ("containers", T.ArrayType(T.StringType()), pa.list_(pa.string())),
    ("tail", T.IntegerType(), pa.int32()),
    ("depth", T.IntegerType(), pa.int32()),
    ("kind", T.StringType(), pa.string()),
    ("text", T.StringType(), pa.string()),
)


def _clean(value: str) -> str:
    """Lone surrogates cannot be stored as UTF-8; they become '?'."""
    try:
        value.encode("utf-8")
        return value
    except UnicodeEncodeError:
        return value.encode("utf-8", "replace").decode("utf-8")


def _parse(raw: str):
    """The value of a JSON text; nesting too deep for the library's parser is read with a list of open containers."""
    try:
        return json.loads(raw)
    except RecursionError:
        pass
    root: list = []
    open_, keys, at = [root], [None], 0
    while at < len(raw):
        c = raw[at]
        if c in " \t\r\n,:":
            at += 1
            continue
        if c in "]}":
            if len(open_) == 1:
                raise ValueError("closed too often")
            open_.pop()
            keys.pop()
            at += 1
            continue
        if c in "[{":
            value, at = ([] if c == "[" else {}), at + 1
        elif c == '"':
            value, at = scanstring(raw, at + 1, True)
        else:
            value, at = json.JSONDecoder().raw_decode(raw, at)
        holder = open_[-1]
        if holder.__class__ is list:
            holder.append(value)
        elif keys[-1] is None:
            if c != '"':
                raise ValueError("a key is no string")
            keys[-1] = value
            continue
        else:
            holder[keys[-1]], keys[-1] = value, None
        if c in "[{":
            open_.append(value)
            keys.append(None)
    if len(open_) > 1 or len(root) != 1:
        raise ValueError("not one value")
    return root[0]


class _Place:
    """A place in values of one shape: below ``up`` at a key or at a list position. Its path is spelled when a leaf is met there."""

    __slots__ = ("up", "at", "members", "items", "index")

    def __init__(self, up, at):
        self.up, self.at, self.members, self.items, self.index = up, at, {}, [], -1

    def spelled(self) -> tuple:
        """(path, keys, containers, tail, depth)."""
        steps, place = [], self
        while place.up is not None:
            steps.append(place.at)
            place = place.up
        path, keys, containers, tail = "", [], [], 0
        for at in reversed(steps):
            if at.__class__ is int:
                path, tail = f"{path}[{at}]", tail + 1
                continue
            if not at.isascii():
                at = _clean(at)
            keys.append(at)
            containers.append(path)
            path, tail = path + "." + at if path else at, 0
        return path, keys, containers, tail, len(steps)


_KINDS = ("string", "null", "boolean", "integer", "number", "empty")


class _Collector:
    """Appends the leaves of one value after another to column lists.

    Places are kept once for all values that have them, so a leaf adds only numbers and its text.
    """

    def __init__(self, only: str | None):
        self.only = None if only is None else _KINDS.index(only)
        self.rows: list[int] = []
        self.numbers: list[int] = []
        self.kinds: list[int] = []
        self.texts: list = []
        self.at: list[int] = []
        self.top = _Place(None, None)
        self.places: list[tuple] = []

    def add(self, row: int, root) -> None:
        count = 0
        # An explicit stack: values nest as deep as they like.
        stack = [(root, self.top)]
        while stack:
            value, place = stack.pop()
            if value.__class__ is dict and value:
                members, below = place.members, []
                for key, item in value.items():
                    inner = members.get(key)
                    if inner is None:
                        inner = members[key] = _Place(place, key)
                    below.append((item, inner))
                below.reverse()
                stack.extend(below)
            elif value.__class__ is list and value:
                items, size = place.items, len(value)
                for i in range(len(items), size):
                    items.append(_Place(place, i))
                stack.extend((value[i], items[i]) for i in range(size - 1, -1, -1))
            else:
                self.leaf(row, count, value, place)
                count += 1

    def leaf(self, row: int, number: int, value, place: _Place) -> None:
        if value.__class__ is str:
            kind, text = 0, value if value.isascii() else _clean(value)
        elif value is None:
            kind, text = 1, None
        elif value is True or value is False:
            kind, text = 2, "true" if value else "false"
        elif value.__class__ is int:
            kind, text = 3, str(value)
        elif value.__class__ is float:
            kind, text = 4, repr(value)
        else:
            kind, text = 5, None
        if self.only is not None and kind != self.only:
            return
        if place.index < 0:
            place.index = len(self.places)
            self.places.append(place.spelled())
        self.rows.append(row)
        self.numbers.append(number)
        self.kinds.append(kind)
        self.texts.append(text)
        self.at.append(place.index)

    def batch(self, source: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
        """The leaves beside the kept columns of their rows."""
        rows = pa.array(self.rows, pa.int64())
        # Not the last column, the text itself: it would be copied for each of its leaves.
        arrays = [source.column(j).take(rows) for j in range(source.num_columns - 1)]
        at = pa.array(self.at, pa.int64())
        places = [[p[j] for p in self.places] for j in range(5)]
        kinds = {n: t for n, _, t in _LEAF_FIELDS}
        path, keys, containers, tail, depth = (
            _to_arrow(c, kinds[n]).take(at) for c, n in zip(places, ("path", "keys", "containers", "tail", "depth"))
        )
        kind = pa.array(_KINDS, pa.string()).take(pa.array(self.kinds, pa.int64()))
        arrays += [pa.array(self.numbers, pa.int64()), path, keys, containers, tail, depth, kind, pa.array(self.texts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def _to_arrow(values: list, kind: pa.DataType) -> pa.Array:
    """Arrow array of a column; lists go in as one flat run with offsets."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    offsets = pa.array([0, *accumulate(map(len, values))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(chain.from_iterable(values), pa.string()))


def leaves(df: DataFrame, value: str, keep: list[str], only: str | None = None) -> DataFrame:
    """One row per leaf of the JSON in ``value`` (text or VARIANT).

    Columns: the kept ones, ``leaf_no``, ``path`` (``a.b[0]``), ``keys`` (object keys,
    outermost first), ``containers`` (path of the object holding each key), ``tail``
    (list positions after the last key), ``depth``, ``kind`` and ``text``. Empty containers are leaves of kind ``empty``, as their key
    is still evidence. Text that is no JSON has no leaves. ``only`` keeps one kind.
    """
    source = F.col(value)
    if dict(df.dtypes)[value] == "variant":
        source = F.to_json(source)
    narrow = df.select(*keep, source.alias("_json"))
    fields = [narrow.schema[k] for k in keep]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t, _ in _LEAF_FIELDS])

    narrow_names = list(keep)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*narrow_names, *[n for n, _, _ in _LEAF_FIELDS]]
        for batch in batches:
            found = _Collector(only)
            for i, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if raw is None:
                    continue
                try:
                    root = _parse(raw)
                except ValueError:
                    continue
                found.add(i, root)
                if len(found.rows) >= OUT_ROWS:
                    yield found.batch(batch, names)
                    found = _Collector(only)
            yield found.batch(batch, names)

    return narrow.mapInArrow(flatten, schema)


def dot_path(path: Column) -> Column:
    """``a.b[0]`` as ``a.b.0``."""
    return F.regexp_replace(F.regexp_replace(path, r"\[(\d+)\]", ".$1"), r"^\.", "")


def string_leaves(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    return leaves(df, value, keep, only="string")


def last_key(keys: Column) -> Column:
    return F.try_element_at(keys, F.lit(-1))


def is_source_path(keys: Column) -> Column:
    """Paths of source text and its identity, skipped by marker search."""
    return F.arrays_overlap(keys, F.array(F.lit("source"), F.lit("source_hash"), F.lit("asset_id")))


def marked_events(df: DataFrame, value: str, keep: list[str], markers: list[str]) -> DataFrame:
    """Kept columns of the rows in which any marker occurs inside a non-source leaf."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains("text", F.lit(m))
    found = string_leaves(df, value, keep).where(~is_source_path(F.col("keys")) & hit)
    return found.select(*keep).distinct()


def mined_leaves(
    df: DataFrame, text: str, keep: list[str], min_len: int = 4, max_depth: int = 4, per_value: int | None = None
) -> DataFrame:
    """Distinct string leaves of values that parse as a JSON container, ranked by their place in it.

    The minimum length and the depth define this operator. ``leaf_rank`` is the leaf's
    position among all leaves of its value; with ``per_value`` only so many first
    leaves of each value stay, as a top-k by that rank.
    """
    found = string_leaves(df, text, keep).where(
        (F.length("text") >= min_len) & (F.col("depth") <= max_depth) & (F.col("depth") > 0)
    )
    first = found.groupBy(*keep, "text").agg(F.min(F.struct("leaf_no", "path")).alias("at"))
    ranked = first.select(
        *keep, F.col("at.leaf_no").alias("leaf_rank"), F.col("at.path").alias("json_path"), F.col("text").alias("leaf")
    )
    if per_value is None:
        return ranked
    order = Window.partitionBy(*keep).orderBy("leaf_rank")
    return ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_value).drop("_n")
