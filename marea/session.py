"""Session defaults, and small helpers that every operator uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a side that was counted is broadcast.
BROADCAST_ROWS = 500_000


def session(app: str = "marea", **options: str) -> SparkSession:
    """A session with UTC and adaptive execution; options are further settings by name with _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for name, value in options.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def missing(df: DataFrame, columns: list[str]) -> list[str]:
    """Required columns that a frame lacks, in order."""
    return [c for c in columns if c not in df.columns]


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """The empty result of an operator whose inputs are missing."""
    return spark.createDataFrame([], schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share (spark.checkpoint.dir); a temporary one where none is set, as in local tests."""
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_marea_shared", None)
    if not folder:
        folder = spark._marea_shared = "file://" + tempfile.mkdtemp(prefix="marea-")
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Writes a frame that is used several times to the shared folder and reads it back; lost executors don't lose it."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/marea/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows, counted; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once a context: they may run where it isn't installed."""
    import os
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_marea_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="marea-"), "marea.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._marea_shipped = True
