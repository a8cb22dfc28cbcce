"""Queries over all channels whose namesakes run over a fixed few of them; the SQL is theirs without that condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import features as H
from tessella.operators import grid
from tessella.plans import queries_features, queries_more, queries_regions  # noqa: F401  their SQL
from tessella.plans.registry import ORACLES, query
from tessella.sources import fixtures as X

CHANNELS = 64


def _sql(name: str, *changes: tuple[str, str]) -> str:
    sql = ORACLES[name]
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"{name}'s SQL has no {old!r}")
        sql = sql.replace(old, new)
    return sql


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    tok = X.tokens(spark, sf_dir)
    return X.channels(tok).withColumn("image_id", F.lit("e0")), tok.agg(F.max("y") + 1).first()[0]


def _offsets(spark: SparkSession, sf_dir: str, edge: str) -> DataFrame:
    ch, gh = _grid(spark, sf_dir)
    out = grid.offset_means(ch, "v", gh, X.TOKEN_WIDTH, extra=("ch",), edge=edge, absent="out")
    return out.select((F.col("y") * X.TOKEN_WIDTH + F.col("x")).alias("vec_id"), "ch", F.round("mean", 6).alias("mean"))


@query(_sql("op_J03_offset_means", (" WHERE ch < 4", "")))
def op_J03_offset_means_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "nearest")


@query(_sql("op_J04_reflected_means", (" WHERE ch < 2", "")))
def op_J04_reflected_means_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir, "reflect")


@query(_sql("op_A04_observations", (" AND ch < 8", "")))
def op_A04_observations_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central tokens' means of the tiles whose commonest class holds a share (here 20 %) of the tile."""
    tok = X.tiles(X.tokens(spark, sf_dir), 4)
    t = tok.groupBy("ty", "tx", "class_id").agg(F.count("*").alias("n")).groupBy("ty", "tx").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("class_id")).alias("c"))).alias("top"))
    major = t.where(F.col("top.n") * 100 >= 20 * F.col("total")).select("ty", "tx", (-F.col("top.c")).alias("class_id"))
    central = X.channels(tok.where((F.col("y") % 4).isin(1, 2) & (F.col("x") % 4).isin(1, 2))).select(F.expr("y div 4").alias("ty"), F.expr("x div 4").alias("tx"), "ch", "v")
    return major.join(central, ["ty", "tx"]).groupBy("ty", "tx", "class_id", "ch").agg(F.round(F.avg("v"), 6).alias("mean"))


@query(_sql("op_A08_class_statistics", (" WHERE ch < 6", "")))
def op_A08_class_statistics_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.class_statistics(X.tokens(spark, sf_dir), CHANNELS).select("i", "j", F.round("cov", 8).alias("cov"))


@query(_sql("op_K06_argmax", (" WHERE ch < 8", "")))
def op_K06_argmax_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the largest score, the first of equals."""
    s = F.transform("feat", lambda v, i: F.struct(F.round(v.cast("double"), 1).alias("s"), (-(i + 1)).alias("c")))
    return X.tokens(spark, sf_dir).select("vec_id", (-F.array_max(s)["c"]).cast("long").alias("class_id"))


@query(_sql("op_K09_class_ranking", (" WHERE ch < 6", "")))
def op_K09_class_ranking_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.transform("feat", lambda v, i: F.struct((-F.round(v.cast("double"), 2)).alias("s"), (i + 1).alias("c")))
    return X.tokens(spark, sf_dir).select("vec_id", F.array_join(F.transform(F.array_sort(s), lambda q: q["c"].cast("string")), ",").alias("ranking"))


@query(_sql("op_M21_hann_blend", (" WHERE vec_id < 200", "")))
def op_M21_hann_blend_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens as windows of their own."""
    every = F.explode(F.sequence(F.lit(0), F.lit(7)))
    t = X.tokens(spark, sf_dir).select("image_id", F.col("y").alias("wy"), F.col("x").alias("wx"), every.alias("iy")).select("*", every.alias("ix"))
    w = t.withColumn("value", F.expr("(wy * 7 + wx * 3 + iy + ix) % 11").cast("double"))
    return grid.hann_blend(w, "value", 8, 4).select("y", "x", F.round("value", 6).alias("value"))
