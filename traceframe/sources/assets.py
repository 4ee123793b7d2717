"""Side table of script sources: manifest rows joined to their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = (
    "asset_id STRING, url STRING, sha1 STRING, source STRING, content_path STRING, kind STRING, size BIGINT"
)


def sha1_ref(source: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.upper(F.sha1(F.encode(source, "UTF-8"))))


def with_hash_check(assets: DataFrame) -> DataFrame:
    """Add the recomputed hash and a flag for sources that do not match theirs."""
    computed = sha1_ref(F.col("source"))
    stored = F.coalesce(F.col("source_hash"), F.lit(""))
    return assets.withColumn("computed_hash", computed).withColumn(
        "source_unverified", (stored != "") & (stored != computed)
    )


def scan_assets(spark: SparkSession, manifest_path: str, root: str, tolerant: bool = False) -> DataFrame:
    """Read manifest lines; content is inline or in a file under ``root``.

    Strict mode fails on a malformed line; tolerant mode keeps it as a marker row
    with the line in ``bad_line``. Files are read whole, as text, next to each other
    in one distributed listing and joined by path.
    """
    lines = spark.read.text(manifest_path).where(F.trim("value") != "").select(
        F.trim("value").alias("line"), F.monotonically_increasing_id().alias("manifest_index")
    )
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    if not tolerant:
        failed = F.raise_error(F.concat(F.lit("invalid JSON in manifest: "), F.col("line"))).cast("variant")
        parsed = parsed.withColumn("v", F.coalesce("v", failed))
    get = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
    rows = parsed.select(
        "manifest_index", F.when(F.col("v").isNull(), F.col("line")).alias("bad_line"),
        get("asset_id").alias("asset_id"), get("url").alias("url"), get("sha1").alias("source_hash"),
        get("kind").alias("kind"), get("size", "bigint").alias("size"),
        get("content_path").alias("content_path"), get("source").alias("inline_source"),
    )
    base = root.rstrip("/")
    contents = spark.read.text(base, wholetext=True, recursiveFileLookup=True)
    contents = contents.select(
        F.substring_index(F.url_decode(F.col("_metadata.file_path")), base + "/", -1).alias("content_path"),
        F.col("value").alias("file_source"),
    )
    joined = rows.join(contents, "content_path", "left").withColumn(
        "source", F.coalesce("inline_source", "file_source")
    ).drop("inline_source", "file_source")
    checked = with_hash_check(joined)
    return checked if tolerant else checked.where(F.col("source").isNotNull())


def asset_keys(assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One asset per id and per hash (last row wins) and per URL (first row wins)."""
    cols = [c for c in assets.columns]
    whole = F.struct(*cols)

    def pick(key: str, fn) -> DataFrame:
        named = assets.where(F.col(key).isNotNull() & (F.col(key) != ""))
        return named.groupBy(F.col(key).alias("key")).agg(fn(whole, F.col("manifest_index")).alias("asset"))

    return pick("asset_id", F.max_by), pick("source_hash", F.max_by), pick("url", F.min_by)
