"""Intermediate tables in the shared folder the cluster names.

Writing an intermediate result cuts its lineage, so it survives the loss of
any executor, and gives the optimizer its true size for the next plan.  Within
`scratch` the folders written are deleted at its end; outside they stay, since
what is returned may still be read from them.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
DROP_SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workspace(spark: SparkSession) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``.

    A session on one machine may do without that setting and gets a temporary
    folder; on a cluster, where no other machine could read it, it is an error.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        # local-cluster[...] has executors of its own, in other processes
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tablewright-")
    return f"{base.rstrip('/')}/tablewright-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs begun in here leave no shuffle files behind: what they wrote is read
    from then on, and the disk they took is free for the next."""
    if spark.conf.get(DROP_SHUFFLE_FILES, "true") == "true":  # set by the user, or unknown
        yield
        return
    spark.conf.set(DROP_SHUFFLE_FILES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLE_FILES, "false")


# Folders written in the innermost `scratch` of this context; None outside of any.
_FOLDERS: ContextVar[list[str] | None] = ContextVar("scratch_folders", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after a failure, every folder that `materialized`
    named itself in here.  For work whose results are written elsewhere by then;
    threads take part if they are started in a copy of the context."""
    folders: list[str] = []
    before = _FOLDERS.set(folders)
    try:
        yield
    finally:
        _FOLDERS.reset(before)
        for folder in folders:
            delete(spark, folder)


def reserved(spark: SparkSession) -> str:
    """A fresh folder name that the `scratch` around deletes at its end: for what
    is written in one within it and read after that."""
    path = workspace(spark)
    if _FOLDERS.get() is not None:
        _FOLDERS.get().append(path)
    return path


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder from whatever file system it is on, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialized(frame: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the frame once as parquet and continue from the written table."""
    spark = frame.sparkSession
    path = folder or reserved(spark)
    with shuffle_files_dropped(spark):
        frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
