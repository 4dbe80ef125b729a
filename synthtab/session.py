"""Spark session defaults used by the tests, the bench and the entry module."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "synthtab") -> SparkSession:
    """A local session with the settings the library is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SYNTHTAB_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set, and shared, so that a lost executor takes no
    data with it.  Only a local session (one machine) that leaves it unset
    gets a folder, which is deleted when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = _own_folder()
    return folder.rstrip("/")


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="synthtab-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


#: Staged tables that still exist, by application, oldest first.
_staged: dict[str, list[str]] = {}


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it belongs to ``staging`` or, outside of that, to the application."""
    if not _staged:
        atexit.register(_release_all)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_staged(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    known = _staged.get(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in known:
            known.remove(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables staged inside: they are deleted at its end, so results must be written or collected before."""
    before = set(_staged.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_staged(spark, *(p for p in list(_staged.get(spark.sparkContext.applicationId, [])) if p not in before))


def _release_all() -> None:
    """At the end of Python the application's tables go, if its session still runs."""
    with suppress(Exception):  # the JVM may have ended first
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            drop_staged(spark, *list(_staged.get(spark.sparkContext.applicationId, [])))


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    For inputs that are read many times but costly to make: files that must be
    parsed, or generated rows.  Later passes read only the columns they need.
    """
    path = staged_path(df.sparkSession, "stage")
    names = df.columns
    df.toDF(*[f"c{i}" for i in range(len(names))]).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*names)
