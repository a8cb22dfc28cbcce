"""Queries on token features: statistics, rankings, linear heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import features as H
from tessella.operators import grid
from tessella.plans.registry import query
from tessella.sources import fixtures as X

TOK, CHAN, PIX = X.TOK, X.CHAN, X.PIX
STATS = "stats AS (SELECT ch, avg(v) AS mean, greatest(stddev_pop(v), 1e-4) AS std FROM chan GROUP BY ch)"
CONTRAST = "con AS (SELECT class_id, ch, abs((s / n - (ts - s) / (tn - n)) / std) AS contrast FROM (SELECT class_id, ch, count(*) AS n, sum(v) AS s FROM chan GROUP BY ALL) JOIN (SELECT ch, count(*) AS tn, sum(v) AS ts FROM chan GROUP BY ch) USING (ch) JOIN stats USING (ch))"


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.channels(X.tokens(spark, sf_dir))


@query(f"WITH {CHAN}, {STATS} SELECT ch, round(mean, 6) AS mean, round(std, 6) AS std FROM stats")
def op_A01_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.channel_stats(_channels(spark, sf_dir)).select("ch", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {CHAN} SELECT ch, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 0.15), 6) AS std FROM chan GROUP BY ch")
def op_A02_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.channel_stats(_channels(spark, sf_dir), 0.15).select("ch", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {CHAN} SELECT y // 4 AS ty, x // 4 AS tx, ch, round(avg(v), 6) AS mean FROM chan GROUP BY ALL HAVING count(*) = 16")
def op_A03_tile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each whole 4 x 4 tile of tokens; partial tiles are left out."""
    t = _channels(spark, sf_dir).groupBy(F.expr("y div 4").alias("ty"), F.expr("x div 4").alias("tx"), "ch").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return t.where("n = 16").select("ty", "tx", "ch", F.round("mean", 6).alias("mean"))


@query(f"WITH {CHAN}, t AS (SELECT y // 4 AS ty, x // 4 AS tx, class_id, count(*) // 64 AS n FROM chan GROUP BY ALL), m AS (SELECT ty, tx, class_id FROM t WHERE n * 100 >= 20 * (SELECT sum(n) FROM t u WHERE u.ty = t.ty AND u.tx = t.tx) QUALIFY row_number() OVER (PARTITION BY ty, tx ORDER BY n DESC, class_id) = 1) SELECT ty, tx, m.class_id, ch, round(avg(v), 6) AS mean FROM m JOIN chan ON ty = y // 4 AND tx = x // 4 AND ch < 8 AND y % 4 IN (1, 2) AND x % 4 IN (1, 2) GROUP BY ALL")
def op_A04_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central tokens' means of the tiles whose commonest class holds a share (here 20 %) of the tile."""
    tok = X.tiles(X.tokens(spark, sf_dir), 4)
    t = tok.groupBy("ty", "tx", "class_id").agg(F.count("*").alias("n")).groupBy("ty", "tx").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("class_id")).alias("c"))).alias("top"))
    major = t.where(F.col("top.n") * 100 >= 20 * F.col("total")).select("ty", "tx", (-F.col("top.c")).alias("class_id"))
    central = X.channels(tok.where((F.col("y") % 4).isin(1, 2) & (F.col("x") % 4).isin(1, 2))).where("ch < 8").select(F.expr("y div 4").alias("ty"), F.expr("x div 4").alias("tx"), "ch", "v")
    return major.join(central, ["ty", "tx"]).groupBy("ty", "tx", "class_id", "ch").agg(F.round(F.avg("v"), 6).alias("mean"))


@query(f"""WITH {CHAN}, few AS (SELECT * FROM chan WHERE ch < 6), m AS (SELECT class_id, ch, avg(v) AS m FROM few GROUP BY ALL),
 p AS (SELECT a.ch AS i, b.ch AS j, sum((a.v - ma.m) * (b.v - mb.m)) / count(*) AS c FROM few a JOIN few b ON a.vec_id = b.vec_id AND a.ch <= b.ch JOIN m ma ON ma.class_id = a.class_id AND ma.ch = a.ch JOIN m mb ON mb.class_id = b.class_id AND mb.ch = b.ch GROUP BY ALL)
 SELECT i, j, round(CASE WHEN i = j THEN c + 0.0025 ELSE c * 0.8 END, 8) AS cov FROM p""")
def op_A08_class_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.class_statistics(X.tokens(spark, sf_dir), 6).select("i", "j", F.round("cov", 8).alias("cov"))


@query(f"WITH {CHAN}, m AS (SELECT ch, median(v) AS m FROM chan GROUP BY ch), d AS (SELECT ch, median(abs(v - m)) AS mad FROM chan JOIN m USING (ch) GROUP BY ch) SELECT ch, round(mad, 8) AS mad FROM d ORDER BY round(mad, 8) DESC, ch LIMIT 16")
def op_A17_mad_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 channels of the largest median absolute deviation: two exact-median passes."""
    ch = _channels(spark, sf_dir)
    m = ch.groupBy("ch").agg(F.median("v").alias("m"))
    d = ch.join(F.broadcast(m), "ch").groupBy("ch").agg(F.round(F.median(F.abs(F.col("v") - F.col("m"))), 8).alias("mad"))
    return d.orderBy(F.desc("mad"), "ch").limit(16)


@query(f"WITH {PIX} SELECT truth, round(quantile_cont(value, 0.95), 6) AS p95 FROM pix GROUP BY truth")
def op_A18_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.raster(spark, sf_dir).groupBy("truth").agg(F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query(f"WITH {PIX} SELECT truth, sha256(string_agg(y || ',' || x, ';' ORDER BY y, x)) AS digest FROM pix WHERE NOT support GROUP BY truth")
def op_A20_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-sensitive digest of each class's cells outside the support."""
    p = X.raster(spark, sf_dir).where("not support").groupBy("truth").agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("c"))
    return p.select("truth", F.sha2(F.array_join(F.transform("c", lambda s: F.concat_ws(",", s["y"].cast("string"), s["x"].cast("string"))), ";"), 256).alias("digest"))


@query(f"WITH {CHAN}, {STATS}, {CONTRAST}, r AS (SELECT class_id, ch, row_number() OVER (PARTITION BY class_id ORDER BY round(contrast, 9) DESC, ch) AS r FROM con) SELECT DISTINCT ch FROM r WHERE r <= 3")
def op_K01_classwise_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.top_channels(H.contrasts(_channels(spark, sf_dir)), 3).select("ch").distinct()


@query(f"WITH {CHAN}, {STATS}, {CONTRAST}, r AS (SELECT ch, row_number() OVER (ORDER BY round(contrast, 9) DESC, ch) AS rank FROM con WHERE class_id = 4) SELECT rank, ch FROM r WHERE rank <= 16")
def op_K02_binary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = H.contrasts(_channels(spark, sf_dir)).where("class_id = 4")
    return H.top_channels(c, 16).select(F.col("rank").cast("long").alias("rank"), "ch")


@query(f"WITH {CHAN} SELECT vec_id, first(ch + 1 ORDER BY round(v, 1) DESC, ch) AS class_id FROM chan WHERE ch < 8 GROUP BY vec_id")
def op_K06_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the largest score, the first of equals."""
    s = F.transform(F.slice("feat", 1, 8), lambda v, i: F.struct(F.round(v.cast("double"), 1).alias("s"), (-(i + 1)).alias("c")))
    return X.tokens(spark, sf_dir).select("vec_id", (-F.array_max(s)["c"]).cast("long").alias("class_id"))


@query(f"""WITH {PIX}, m AS (SELECT round(value, 1) AS margin, truth FROM pix WHERE truth IN (1, 2)), g AS (SELECT margin, count(*) FILTER (truth = 2) AS tp, count(*) FILTER (truth = 1) AS fp FROM m GROUP BY 1),
 c AS (SELECT margin, sum(tp) OVER w / sum(tp) OVER () AS se, 1 - sum(fp) OVER w / sum(fp) OVER () AS sp FROM g WINDOW w AS (ORDER BY margin DESC)) SELECT margin AS threshold, round(se, 6) AS sensitivity, round(sp, 6) AS specificity FROM c WHERE se >= 0.95 ORDER BY sp DESC, margin DESC LIMIT 1""")
def op_K07_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.raster(spark, sf_dir).where("truth in (1, 2)").select(F.round("value", 1).alias("margin"), F.col("truth").alias("class_id"))
    return H.threshold_sweep(m, {}, 2, 0.95).select("threshold", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


@query(f"WITH {PIX}, t AS (SELECT y // 8 AS ty, x // 8 AS tx, count(*) FILTER (pred <> truth) AS area FROM pix GROUP BY ALL) SELECT ty, tx, area, row_number() OVER (ORDER BY area DESC, ty, tx) AS rank FROM t QUALIFY rank <= 50")
def op_K08_component_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 first by area, then position."""
    t = X.tiles(X.raster(spark, sf_dir)).groupBy("ty", "tx").agg(F.count_if(F.col("pred") != F.col("truth")).alias("area")).orderBy(F.desc("area"), "ty", "tx").limit(50)
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("area"), "ty", "tx")).cast("long"))  # 50 rows


@query(f"WITH {CHAN} SELECT vec_id, string_agg(ch + 1, ',' ORDER BY round(v, 2) DESC, ch) AS ranking FROM chan WHERE ch < 6 GROUP BY vec_id")
def op_K09_class_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.transform(F.slice("feat", 1, 6), lambda v, i: F.struct((-F.round(v.cast("double"), 2)).alias("s"), (i + 1).alias("c")))
    return X.tokens(spark, sf_dir).select("vec_id", F.array_join(F.transform(F.array_sort(s), lambda q: q["c"].cast("string")), ",").alias("ranking"))


@query(f"WITH {CHAN}, c AS (SELECT ch AS id, round(avg(v), 3) AS score, ch % 5 AS cost FROM chan GROUP BY ch) SELECT id, score, cost FROM c WHERE score >= (SELECT max(score) FROM c) - 0.005 ORDER BY cost, id LIMIT 1")
def op_K10_near_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what lies within 0.005 of the best, the cheapest, then the first."""
    c = _channels(spark, sf_dir).groupBy(F.col("ch").alias("id")).agg(F.round(F.avg("v"), 3).alias("score")).withColumn("cost", F.col("id") % 5)
    return c.withColumn("best", F.max("score").over(Window.partitionBy(F.lit(1)))).where(F.col("score") >= F.col("best") - 0.005).orderBy("cost", "id").limit(1).select("id", "score", "cost")


@query(f"WITH {PIX}, f AS (SELECT f, avg((CASE WHEN value < f THEN truth ELSE pred END = truth)::INT) AS score FROM pix, (VALUES (0), (50), (100), (200)) t(f) GROUP BY f) SELECT max(f)::BIGINT AS floor FROM f WHERE score >= (SELECT score FROM f WHERE f = 0) - 0.005")
def op_K11_floor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest floor whose score is within 0.005 of no floor's: all floors in one pass."""
    floors = (0, 50, 100, 200)
    score = lambda f: F.avg((F.when(F.col("value") < f, F.col("truth")).otherwise(F.col("pred")) == F.col("truth")).cast("int"))
    one = X.raster(spark, sf_dir).agg(*(score(f).alias(f"s{f}") for f in floors))
    return one.select(F.greatest(*(F.when(F.col(f"s{f}") >= F.col("s0") - 0.005, F.lit(f)) for f in floors)).cast("long").alias("floor"))


@query(f"""WITH {CHAN}, m AS (SELECT class_id, ch, avg(v) AS c FROM chan GROUP BY ALL), k AS (SELECT ch FROM m GROUP BY ch ORDER BY round(var_pop(c), 12) DESC, ch LIMIT 16)
 SELECT class_id, ch, round(2 * c, 6) AS coef, round(-sum(c * c) OVER (PARTITION BY class_id), 6) AS intercept FROM m WHERE ch IN (SELECT ch FROM k)""")
def op_M07_centroid_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.centroid_head(_channels(spark, sf_dir), 16).select("class_id", "ch", F.round("coef", 6).alias("coef"), F.round("intercept", 6).alias("intercept"))


@query(f"""WITH {CHAN}, m AS (SELECT class_id, ch, avg(v) AS c FROM chan GROUP BY ALL), k AS (SELECT ch FROM m GROUP BY ch ORDER BY round(var_pop(c), 12) DESC, ch LIMIT 16),
 s AS (SELECT vec_id, m.class_id, sum(2 * c * v - c * c) AS s FROM chan JOIN m USING (ch) WHERE ch IN (SELECT ch FROM k) GROUP BY ALL) SELECT vec_id, first(class_id ORDER BY round(s, 9) DESC, class_id) AS class_id FROM s GROUP BY vec_id""")
def op_M05_centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear scores of the centroid head and their argmax."""
    ch = _channels(spark, sf_dir)
    head = F.broadcast(H.centroid_head(ch, 16).withColumnRenamed("class_id", "k"))
    s = ch.join(head, "ch").groupBy("vec_id", "k").agg(F.round(F.sum(F.col("coef") * F.col("v")) + F.first("intercept"), 9).alias("s"))
    return s.groupBy("vec_id").agg((-F.max(F.struct("s", (-F.col("k")).alias("c")))["c"]).alias("class_id"))


@query()
def op_M01_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge fit, scored on its own tokens: overlap by class."""
    tok = X.tokens(spark, sf_dir)
    head = H.fit_ridge(tok, 64)
    p = H.ridge_scores(tok, head).withColumn("pred", H.first_best("scores", head.classes))
    return p.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("class_id")).alias("hits"))


@query(f"WITH {TOK}, t AS (SELECT *, vec_id % 7 = 0 AS gap FROM tok) SELECT a.vec_id, first(b.vec_id ORDER BY (a.y - b.y) ** 2 + (a.x - b.x) ** 2, b.y, b.x) AS source FROM t a JOIN t b ON a.gap AND NOT b.gap GROUP BY a.vec_id")
def op_J06_nearest_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokens(spark, sf_dir).withColumn("gap", F.col("vec_id") % 7 == 0).select(*grid.KEY, "vec_id", "gap")
    return grid.nearest_filled(t, ["vec_id"], "gap").select((F.col("y") * X.TOKEN_WIDTH + F.col("x")).alias("vec_id"), F.col("vec_id").alias("source"))


@query(f"""WITH {CHAN}, half AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM chan WHERE ch = 0 GROUP BY ALL HAVING count(*) = 4), s AS (SELECT max(y) AS my, max(x) AS mx FROM half), d AS (SELECT y, x FROM tok WHERE y < 20 AND x < 20),
 t AS (SELECT d.y, d.x, least(greatest((d.y + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE, 0::DOUBLE), my::DOUBLE) AS py, least(greatest((d.x + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE, 0::DOUBLE), mx::DOUBLE) AS px, my, mx FROM d, s), c AS (SELECT *, least(floor(py), greatest(my - 1, 0))::BIGINT AS y0, least(floor(px), greatest(mx - 1, 0))::BIGINT AS x0 FROM t),
 k AS (SELECT y, x, least(y0 + dy, my) AS sy, least(x0 + dx, mx) AS sx, (CASE dy WHEN 0 THEN 1 - (py - y0) ELSE py - y0 END) * (CASE dx WHEN 0 THEN 1 - (px - x0) ELSE px - x0 END) AS w FROM c, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)) SELECT k.y, k.x, round(sum(w * h.v), 6) AS v FROM k JOIN half h ON h.y = sy AND h.x = sx GROUP BY ALL""")
def op_J05_scale_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-scale grid read at the full grid's cells."""
    tok = X.tokens(spark, sf_dir)
    ch = X.channels(tok).where("ch = 0")
    half = ch.groupBy(F.lit("e0").alias("image_id"), F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.avg("v").alias("v"), F.count("*").alias("n")).where("n = 4")
    h, w = half.agg(F.max("y") + 1, F.max("x") + 1).first()
    return grid.bilinear(half, "v", h, w, 0.5, tok.where("y < 20 and x < 20")).select("y", "x", F.round("v", 6).alias("v"))


@query(f"WITH {TOK} SELECT y // 2 AS ty, x // 2 AS tx, count(*) AS spots, count(DISTINCT class_id) AS classes FROM tok GROUP BY ALL HAVING count(DISTINCT class_id) > 1")
def op_J07_spot_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on which spots of different classes fall."""
    return X.tokens(spark, sf_dir).groupBy(F.expr("y div 2").alias("ty"), F.expr("x div 2").alias("tx")).agg(F.count("*").alias("spots"), F.countDistinct("class_id").alias("classes")).where("classes > 1")
