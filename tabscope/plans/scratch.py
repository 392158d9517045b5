"""Where to write tables that cut lineage or that readers pick up again."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tabscope.sources.files import Files

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing = threading.local()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session.

    A session whose executors are threads of this process may go without one and gets a temporary
    folder; on a cluster a missing setting is an error, because executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read back: later passes start from columns on shared storage,
    and a lost executor costs a re-read instead of the whole lineage."""
    path = scratch_folder(df.sparkSession, name)
    if getattr(_passing, "folders", None):
        _passing.folders[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end, and shuffles once their query has run.

    Only for work whose results are on the driver by then.
    """
    if not hasattr(_passing, "folders"):
        _passing.folders = []
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    _passing.folders.append([])
    try:
        yield
    finally:
        for path in _passing.folders.pop():
            Files(spark, path).delete(path)
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
