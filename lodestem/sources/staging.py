"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where none is set and all runs in this process.

    On a cluster without that setting there is no folder that all executors see, so that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestem-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and the loss of an
    executor costs no recomputation. The job's own shuffle files go when it ends, since nothing runs that plan again;
    the tables are removed when the driver's process ends or by :func:`drop_staged`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestem-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging_area() -> Iterator[None]:
    """Tables staged within go when it ends: for a result that is written or collected inside."""
    kept = len(_written)
    try:
        yield
    finally:
        drop_staged(kept)


def drop_staged(kept: int = 0) -> None:
    """Delete the staged tables of this process but for the first ``kept``."""
    while len(_written) > kept:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already
            pass


atexit.register(drop_staged)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package's source to the session's workers, once per application, wherever they were started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="lodestem-code-")  # the driver's own; Spark serves the file to the workers
    atexit.register(shutil.rmtree, folder, True)
    copy = os.path.join(folder, "code", os.path.basename(package))
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "lodestem"), "zip", os.path.dirname(copy)))
