"""Session helper used by the command line, the tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with adaptive execution on; cluster settings win over ours."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    Only a session without that setting whose tasks run in the driver's own process (a test on one
    machine) gets a temporary folder, which goes with that process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go with the end of each run, and not when the driver collects garbage some time."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def write_through(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a fresh table folder in the shared folder and read it back; ``discard`` takes it away.

    Nobody needs the shuffle files behind a written table, so they are freed.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")
    with shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read any more, wherever Spark has it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete what ``write_through`` wrote for ``df``, once nothing will read it any more."""
    if path := getattr(df, "_written", None):
        delete(df.sparkSession, path)
        df._written = None


_LATER: dict[str, list[str]] = {}


def sweep_later(df: DataFrame) -> None:
    """Keep a written table that a returned, not yet executed frame reads until the next ``sweep``."""
    if path := getattr(df, "_written", None):
        _LATER.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)


def sweep(spark: SparkSession) -> None:
    """Delete the tables named by ``sweep_later``; a stage calls it when its predecessor's rows are written."""
    for path in _LATER.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def fits_broadcast(df: DataFrame, max_bytes: int = 64 << 20) -> bool:
    """Measure ``df`` and tell whether it is small enough to be sent to every executor.

    Variable-width columns are summed, fixed-width ones counted as 16 bytes.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + F.lit(16)
        elif kind == "array":
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * F.lit(16)
        else:
            width = width + F.lit(16)
    total = df.agg(F.sum(width.cast("bigint")).alias("bytes")).first()["bytes"]
    return (total or 0) <= max_bytes
