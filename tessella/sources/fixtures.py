"""Token grids, label rasters and tiles over the driver's tables (see FIXTURES.md, part C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_WIDTH, TILE, CLASSES = 20, 8, 4

#: The same fixtures as DuckDB CTEs: tok, chan (one row a channel), dims, pix.
TOK = "tok AS (SELECT 'e0' AS image_id, vec_id // 20 AS y, vec_id % 20 AS x, embedding AS feat, CAST(label + 1 AS BIGINT) AS class_id, vec_id FROM embeddings)"
CHAN = TOK + ", chan AS (SELECT vec_id, y, x, class_id, CAST(ch AS BIGINT) AS ch, CAST(feat[ch + 1] AS DOUBLE) AS v FROM tok, range(64) r(ch))"
PIX = """dims AS (SELECT CASE WHEN count(*) >= 100000 THEN 400 WHEN count(*) >= 10000 THEN 100 ELSE 40 END AS w, count(*) AS n FROM events),
 pix0 AS (SELECT event_id, event_id // w AS y, event_id % w AS x, 1 + ((event_id // w) // 8 + (event_id % w) // 8) % 4 AS truth, value, event_type FROM events, dims),
 pix AS (SELECT event_id, y, x, truth, CASE WHEN value > 150 THEN 1 + truth % 4 ELSE truth END AS pred, event_type <> 'error' AS support, event_type, value FROM pix0)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, feat array<float>, class_id, vec_id)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.lit("e0").alias("image_id"), F.expr(f"vec_id div {TOKEN_WIDTH}").alias("y"), (F.col("vec_id") % TOKEN_WIDTH).alias("x"),
        F.col("embedding").alias("feat"), (F.col("label") + 1).cast("long").alias("class_id"), "vec_id")


def channels(tok: DataFrame) -> DataFrame:
    """One row a token and channel: (vec_id, y, x, class_id, ch, v double)."""
    return tok.select("vec_id", "y", "x", "class_id", F.posexplode("feat").alias("ch", "v")).withColumns({"ch": F.col("ch").cast("long"), "v": F.col("v").cast("double")})


def raster_width(spark: SparkSession, sf_dir: str) -> int:
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return 400 if n >= 100_000 else 100 if n >= 10_000 else 40


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, event_id, y, x, truth, pred, support, event_type, value)."""
    w = raster_width(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    p = e.select(F.lit("e0").alias("image_id"), "event_id", F.expr(f"event_id div {w}").alias("y"), (F.col("event_id") % w).alias("x"), "event_type", "value")
    p = p.withColumn("truth", F.expr(f"1 + (y div {TILE} + x div {TILE}) % {CLASSES}"))
    return p.withColumn("pred", F.when(F.col("value") > 150, 1 + F.col("truth") % CLASSES).otherwise(F.col("truth"))).withColumn("support", F.col("event_type") != "error")


def tiles(pixels: DataFrame, side: int = TILE) -> DataFrame:
    """Pixels with their tile's row and column, ty and tx."""
    return pixels.withColumns({"ty": F.expr(f"y div {side}"), "tx": F.expr(f"x div {side}")})
