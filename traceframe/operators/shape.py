"""What the arguments of an event look like, without their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.functions import nested, text
from traceframe.operators.carriers import signed_urls
from traceframe.session import stored

# Fields, references and URLs that a shape shows.
SHOWN_FIELDS = 12
SHOWN_URLS = 4


def event_value_shape(events: DataFrame, keep: list[str], targets: list[str], line: str = "raw") -> DataFrame:
    """One row per event that has string arguments or references: how many strings, the first of them by name and
    length, the names of its filled references, and the first URLs that carry a target parameter.

    ``line`` is the event as it was written, since order counts; source text and its identity are left out of the strings.
    What is gathered per event is bounded by its own members.
    """
    # Three tables are made of the leaves: they are stored, so that events are read and walked once.
    found = stored(nested.leaves(events, line, keep).where(F.try_element_at("keys", F.lit(1)) == "args"), "shape-leaves")
    strings = found.where((F.col("kind") == "string") & ~nested.is_source_path(F.col("keys"))).withColumn("field", nested.dot_path(F.col("path")))
    item = F.struct("leaf_no", "field", F.length("text").alias("length"))
    ordered = strings.groupBy(*keep).agg(F.count(F.lit(1)).alias("string_field_count"), F.array_sort(F.collect_list(item)).alias("_all"))
    shown = F.slice("_all", 1, SHOWN_FIELDS)
    fields = ordered.select(
        *keep, "string_field_count", F.transform(shown, lambda x: x["field"]).alias("string_fields"), F.transform(shown, lambda x: x["length"]).alias("string_lengths"),
    )
    # References are members of the first argument itself, of any type.
    key = nested.last_key(F.col("keys"))
    own = found.where((F.size("keys") == 2) & F.col("path").startswith("args[0].") & key.endswith("_ref") & (F.col("kind") != "null"))
    filled = own.where(~((F.col("kind") == "string") & F.col("text").isin("", "<redacted>")))
    refs = filled.groupBy(*keep).agg(F.slice(F.array_sort(F.collect_set(key)), 1, SHOWN_FIELDS).alias("material_ref_fields"))
    urls = strings.select(*keep, "leaf_no", F.posexplode(text.extract_urls(F.col("text"))).alias("url_no", "url"))
    signed = signed_urls(urls, "url", targets, [*keep, "leaf_no", "url_no"]).drop("scheme")
    facts = F.struct("leaf_no", "url_no", *[c for c in signed.columns if c not in (*keep, "leaf_no", "url_no")])
    shaped = signed.groupBy(*keep).agg(F.slice(F.array_sort(F.collect_list(facts)), 1, SHOWN_URLS).alias("signed_urls"))
    none = F.array().cast("array<string>")
    joined = fields.join(refs, keep, "full").join(shaped, keep, "left")
    return joined.withColumns({
        "string_field_count": F.coalesce("string_field_count", F.lit(0)), "string_fields": F.coalesce("string_fields", none),
        "string_lengths": F.coalesce("string_lengths", F.array().cast("array<int>")), "material_ref_fields": F.coalesce("material_ref_fields", none),
    })
