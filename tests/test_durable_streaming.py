from pyspark.sql import functions as F

from tessella.plans import durable
from tessella.streaming.blocks import process_blocks


def test_stash_and_release(spark):
    df = durable.stash(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.count() == 5 and df.schema.simpleString() == "struct<id:bigint,x:string>"
    empty = durable.stash(spark.range(0))
    assert empty.count() == 0
    durable.release(spark)
    assert durable.stash(spark.range(3)).count() == 3


def test_blocks_are_processed_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "block string, v long")
    rows.coalesce(1).write.parquet(src)
    total = lambda df: df.groupBy("block").agg(F.sum("v").alias("s"))
    process_blocks(spark, src, rows.schema, "block", total, out, ck).awaitTermination()
    spark.createDataFrame([("b", 100), ("c", 4)], rows.schema).coalesce(1).write.mode("append").parquet(src)
    process_blocks(spark, src, rows.schema, "block", total, out, ck).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 3), ("b", 3), ("c", 4)]
