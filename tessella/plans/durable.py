"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and everything runs in one process (tests), a temporary folder of our own.

    On a cluster without that setting it is an error: executors' own disks don't make a whole table.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessella.shared.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", master := spark.conf.get("spark.master", "local")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("tessella.shared.dir", named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessella-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, cells: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    The table stays until release(): results may still be read from it lazily. cells: for rows of a raster, which pack so
    well that Spark, going by the files' bytes, would send millions of them through the driver to every task; see whole().
    """
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return whole(back) if cells else back


def whole(df: DataFrame) -> DataFrame:
    """df, or what is made of its rows alone, is joined by exchanges on both sides however small it is taken to be, unless the other side is marked to be broadcast."""
    return df.hint("merge")


BROADCAST = 100_000  # rows of a short stashed table that go to every task


def joined_left(df: DataFrame, stashed: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of a stashed table on its keys, null where it has none; the table is broadcast up to BROADCAST rows."""
    n = stashed.count()
    if not n:
        return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in stashed.schema if f.name not in keys))
    return whole(df).join(F.broadcast(stashed) if n <= BROADCAST else stashed, keys, "left")


def release(spark: SparkSession) -> None:
    """Delete this application's stashed tables, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
