"""Written intermediate tables for plans of several steps.

A table that several later steps read, or that an iteration starts from, is written
once as Parquet into the folder that ``spark.checkpoint.dir`` names, which driver and
executors share; losing an executor loses none of it. Where the setting is absent, a
session on one machine gets a temporary folder; on a cluster that is an error, since
executors would write to folders that nobody else sees. Tables are removed when the
driver's Python ends, or by ``remove``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tables-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN[:] = [(s, p) for s, p in _WRITTEN if p != path]


def _clean() -> None:
    for spark, path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the session may be gone already
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
