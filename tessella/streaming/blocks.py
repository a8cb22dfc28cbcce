"""Incremental processing of arriving files: each batch's blocks once, through any batch operator.

The engine's operators are batch operators; this runner only feeds them. A block that was finished is skipped when it
arrives again, also after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process_blocks(spark: SparkSession, source: str, schema: StructType, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Run work on the rows of unseen keys of each batch of parquet files and append its result to out, with the key.

    work must keep the key column; a batch is all or nothing, so a crash repeats its batch and nothing else.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.listStatus(path):
            seen = spark.read.parquet(out).select(key).distinct()
            batch = batch.join(seen, key, "left_anti")
        work(batch).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
