"""Writers: operation table, analysis summary, anchor artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds scalars only; nested columns go out as JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map", "variant"))]
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_ops(ops: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, str]:
    """Operation table as Parquet, and as CSV and JSON lines written from the Parquet."""
    root = path.rstrip("/")
    out = {kind: f"{root}/ops.{kind}" for kind in ("parquet", "csv", "jsonl")}
    ops.write.mode(mode).parquet(out["parquet"])
    stored = ops.sparkSession.read.schema(ops.schema).parquet(out["parquet"])
    _flat(stored).write.mode(mode).option("header", "true").csv(out["csv"])
    stored.write.mode(mode).json(out["jsonl"])
    return out


def write_summary(summary: DataFrame, path: str, snippets: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Public columns (no leading underscore) of the per-trace summary, and the snippets."""
    root = path.rstrip("/")
    public = [c for c in summary.columns if not c.startswith("_")]
    summary.select(*public).write.mode(mode).json(f"{root}/summary")
    if snippets is not None:
        snippets.write.mode(mode).json(f"{root}/source_snippets")


def write_artefacts(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> dict[str, str]:
    """One Parquet table per artefact, rows of an anchor kept together for later reads.

    Anchors may be many, so they are clustered by range inside the files instead of
    becoming directories.
    """
    root = path.rstrip("/")
    out = {}
    for name, df in tables.items():
        out[name] = f"{root}/{name}"
        if "anchor_id" in df.columns:
            df = df.sortWithinPartitions("anchor_id")
        df.write.mode(mode).parquet(out[name])
    return out
