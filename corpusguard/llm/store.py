"""Written intermediate tables and sizes that plans are made from.

A table that several later steps read is written once as Parquet into the folder
that ``spark.checkpoint.dir`` names, which driver and executors share; losing an
executor loses none of it. Where the setting is absent (tests, one machine) a
temporary folder is made and the setting filled in. Tables are removed when the
driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
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


def _clean() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # the session may be gone already
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows, and bytes of text in a column."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(n), int(size)


def parts(size: int, each: int, least: int = 64) -> int:
    """Into how many parts to deal ``size`` bytes so that each has about ``each``."""
    return max(least, -(-size // each))


#: Most keys that are sent to every executor; at 8 bytes each under 20 MB.
BROADCAST_KEYS = 2_000_000


def keep_keys(df: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``. The keys are broadcast up to
    ``BROADCAST_KEYS`` of them; beyond that the join is shuffled."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, on, "left_semi")
