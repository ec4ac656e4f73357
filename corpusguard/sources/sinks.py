"""Writing results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition; a partition that is written again is replaced, others
    stay. Committed by Spark's protocol: readers see a partition whole or not."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json_file(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON file on any file system that Spark knows, put in place by renaming a
    finished temporary one, readable by its owner only. For small things such as a
    manifest."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    partial = hadoop.Path(f"{path}.partial")
    owner_only = hadoop.permission.FsPermission("600")
    out = fs.create(partial, owner_only, True, 4096, fs.getDefaultReplication(partial), fs.getDefaultBlockSize(partial), None)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, sort_keys=True) + "\n").encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(partial, target):
        raise OSError(f"could not put {path} in place")
