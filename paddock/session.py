"""Session settings and shared scratch space."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Settings a session can take while it runs.  A projection of forty columns makes one
# generated method too long for the JVM to compile; past this limit (bytes) Spark
# splits it into smaller ones, which halves the time of normalising.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Folders of reports are listed by so many tasks at most, not by one task a folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "48",
}


def tune(spark: SparkSession) -> None:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)


def build_session(app_name: str = "paddock", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and dates pinned to UTC."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    A session on one machine that names no such folder gets a local one; on a cluster
    that would be a different folder on each machine, so the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        base = tempfile.mkdtemp(prefix="paddock-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/paddock/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose contents nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def store(df: DataFrame, label: str, path: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path``, and read it back.

    Cuts lineage in a way that survives lost executors, fixes values that depend
    on physical row order, and gives the planner the real size, so that a later
    join is broadcast only if the table is under the broadcast threshold.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    with shuffles_let_go(spark):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside are deleted when their query ends.

    Else they stay until the driver's memory is cleared, which a driver with little to do does
    seldom.  For queries that run once, as writes do: one that ran again would shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@contextmanager
def advisory_size(spark: SparkSession, size: int) -> Iterator[None]:
    """Shuffles of queries that run inside are read in partitions of ``size`` bytes, unless the session's are smaller."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(before)) if before else size + 1
    if held > size:
        spark.conf.set(key, size)
    try:
        yield
    finally:
        if held > size:
            spark.conf.set(key, before) if before else spark.conf.unset(key)


def is_complete(spark: SparkSession, path: str) -> bool:
    """A table was written there to its end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def store_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written if it is not complete there."""
    if not is_complete(spark, path):
        rows = make()
        with shuffles_let_go(spark):
            rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Functions that run in tasks are found there by their module's name; where the package
    is not installed on the workers, Spark hands them this archive.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # Executors fetch the archive from the driver whenever one starts, so it stays
    # until the driver ends.
    folder = tempfile.mkdtemp(prefix="paddock-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "paddock.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for place, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
