"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, a new local one (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        set_ = sc._jsc.sc().getCheckpointDir()
        root = set_.get() if set_.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loamgrid-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _drop(uri: str) -> None:
    import pyarrow.fs as pafs

    try:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.delete_dir(path)
    except (OSError, ValueError):
        pass


def new_folder(spark: SparkSession) -> str:
    """A place for tables below the shared folder; it goes when the driver's Python ends."""
    uri = f"{shared_dir(spark)}/loamgrid-cut-{uuid.uuid4().hex}"
    atexit.register(_drop, uri)
    return uri


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, and no executor's loss can take them back.

    ``tidy``: what was shuffled for them goes when they are written, not when the driver next collects its garbage.
    """
    spark, uri = df.sparkSession, new_folder(df.sparkSession)
    was = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(uri)
    finally:
        if tidy:
            spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(uri)
