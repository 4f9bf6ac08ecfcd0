"""Registry and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def register(name: str, sql: str | None = None):
    """Register ``f(spark, folder) -> DataFrame`` under a name, with its SQL check if there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` does not have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


#: Arrow batches of a few megabytes: a worker holds several copies of one at a time.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application.

    Functions travel with the job, but what a worker keeps from task to task (vocabularies, tables of
    segments) is held by modules, which it must be able to import.
    """
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory()  # the driver serves the archive from here as long as it lives
    archive = Path(folder.name, package.name)
    for source in package.rglob("*.py"):
        target = archive / package.name / source.relative_to(package)
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(source, target)
    context.addPyFile(shutil.make_archive(str(archive), "zip", archive))
    _SHIPPED[context.applicationId] = folder


@functools.cache
def _trim():
    """The C library's way to give freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def trim() -> None:
    """Return what a batch no longer needs: idle workers else keep the arrays of their largest one."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def arrow(run: Callable, kind: str):
    """A column function over Arrow arrays; workers get the package and give memory back after each batch."""
    ship(SparkSession.getActiveSession())

    @functools.wraps(run)
    def trimmed(*columns):
        found = run(*columns)
        trim()
        return found

    return F.arrow_udf(trimmed, kind)
