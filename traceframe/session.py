"""Session defaults and the checkpoint policy shared by iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "traceframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults. Keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in merged.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers of the session's application, once."""
    context = spark.sparkContext
    if getattr(context, "_traceframe_shipped", False):
        return spark
    top = os.path.dirname(os.path.abspath(__file__))
    # The driver's own temporary file: Spark serves it to the executors.
    archive = os.path.join(tempfile.mkdtemp(prefix="traceframe-code-"), "traceframe.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._traceframe_shipped = True
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint.

    The directory is the one the cluster names in ``spark.checkpoint.dir`` (shared
    storage, so a lost executor costs nothing). A private folder is made only when
    neither that setting nor a context-level directory exists, as in local tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            configured = tempfile.mkdtemp(prefix="traceframe-checkpoint-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(configured)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in a new work folder: for wide or large tables that are read several times.

    Columns are compressed, and a reader takes only those it needs; a checkpoint holds whole rows as they are in memory.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that outlive a plan, in ``spark.checkpoint.dir`` or, in a local session without one, a private place."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="traceframe-work-", dir=os.environ.get("TMPDIR"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
