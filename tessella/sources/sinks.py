"""Sinks: block-partitioned masks, GeoJSON, checksummed states, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.vector import polygon_json, polygons, scaled


def write_mask(pixels: DataFrame, path: str, block: int = 512) -> None:
    """Label cells as parquet by image and block, refused if path exists; a block's cells lie together, in row order."""
    p = pixels.select("image_id", "y", "x", F.col("label").cast("short").alias("label"), F.expr(f"y div {block}").alias("by"), F.expr(f"x div {block}").alias("bx"))
    p.repartition("image_id", "by", "bx").sortWithinPartitions("image_id", "by", "bx", "y", "x").write.mode("errorifexists").partitionBy("image_id").parquet(path)


def read_mask(spark: SparkSession, path: str, by: tuple[int, int] | None = None, bx: tuple[int, int] | None = None) -> DataFrame:
    """The cells again; block ranges are pushed down to the files' statistics."""
    m = spark.read.parquet(path)
    for c, r in (("by", by), ("bx", bx)):
        if r:
            m = m.where(F.col(c).between(*r))
    return m.select("image_id", "y", "x", F.col("label").cast("long").alias("label"))


def write_geojson(rings: DataFrame, path: str, factor_x: float = 1.0, factor_y: float = 1.0) -> None:
    """One feature a line and component, holes included, in another spacing if factors are given; each executor writes its own part."""
    polygons(rings.withColumn("points", scaled("points", factor_x, factor_y))).select(polygon_json("coordinates", "label").alias("value")).write.mode("errorifexists").text(path)


def save_state(spark: SparkSession, state: str, path: str) -> str:
    """A JSON document with its digest; returns the digest."""
    row = spark.createDataFrame([(state,)], "payload string").select("payload", F.sha2("payload", 256).alias("sha256"))
    row.coalesce(1).write.mode("errorifexists").parquet(path)
    return row.first().sha256


def load_state(spark: SparkSession, path: str) -> str:
    """The document, once its digest is found right."""
    r = spark.read.parquet(path).select("payload", (F.sha2("payload", 256) == F.col("sha256")).alias("same")).first()
    if not r.same:
        raise ValueError("the state's checksum differs")
    return r.payload


def receipt(spark: SparkSession, run_id: str, fmt: str, inputs: dict[str, str], outputs: dict[str, str]) -> DataFrame:
    """One row of what a run read and wrote, by name and digest."""
    return spark.createDataFrame([(run_id, fmt, "COMPLETE", inputs, outputs)], "run_id string, format string, status string, inputs map<string,string>, outputs map<string,string>").withColumn("ts", F.current_timestamp())
