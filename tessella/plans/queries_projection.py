"""Queries on projected masks, assembled shards, matched parts and polygons as regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import components, features, grid, heads, projection, vector
from tessella.plans.durable import whole
from tessella.plans.queries_cells import SHAPE, WEIGHTS
from tessella.plans.queries_regions import COMP
from tessella.plans.registry import query
from tessella.sources import fixtures as X
from tessella.sources import readers

PIX, TOK, CHAN = X.PIX, X.TOK, X.CHAN


def _kernel(t: str, a: float) -> str:
    return f"CASE WHEN {t} < 1 THEN (({a + 2}::DOUBLE * {t} - {a + 3}::DOUBLE) * {t} * {t} + 1) WHEN {t} < 2 THEN ((({t} - 5) * {t} + 8) * {t} - 4) * {a}::DOUBLE ELSE 0 END"


def _resize(name: str, n: str, m: str) -> str:
    """SQL of a table (o, s, w) for resizing n to m."""
    return f"""{name}_c AS (SELECT o, n, greatest(n / m, 1.0) AS f, (o + 0.5::DOUBLE) * n / m AS c FROM (SELECT ({n})::DOUBLE AS n, ({m})::DOUBLE AS m FROM g) z, range(100000) r(o) WHERE o < m),
 {name}_k AS (SELECT o, s, abs((s - c + 0.5) / f) AS t FROM {name}_c, range(100000) q(s) WHERE s >= greatest(floor(c - 2 * f + 0.5), 0) AND s < least(floor(c + 2 * f + 0.5), n)),
 {name} AS (SELECT o, s, ({_kernel('t', -0.5)}) / sum({_kernel('t', -0.5)}) OVER (PARTITION BY o) AS w FROM {name}_k)"""


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The first three channels as scores of classes 1 to 3 on the token grid, and its height."""
    t = X.tokens(spark, sf_dir)
    h = t.agg(F.max("y") + 1).first()[0]
    return X.channels(t).where("ch < 3").select(F.lit("e0").alias("image_id"), "y", "x", (F.col("ch") + 1).alias("class_id"), F.col("v").alias("score")), h


G = "g AS (SELECT max(y) + 1 AS gh FROM tok)"
SIDE = 5  # pixels a token in these queries' frames


@query(f"""WITH {CHAN}, {G}, {_resize('ux', '20', f'{20 * SIDE}')}, {_resize('uy', 'gh', f'gh * {SIDE}')}, {_resize('dx', f'{20 * SIDE - 3}', '61')}, {_resize('dy', f'gh * {SIDE} - 7', 'gh * 3 + 1')},
 wx AS (SELECT b.o, a.s, sum(a.w * b.w) AS w FROM dx b JOIN ux a ON a.o = b.s WHERE a.o < {20 * SIDE - 3} GROUP BY ALL), wy AS (SELECT b.o, a.s, sum(a.w * b.w) AS w FROM dy b JOIN uy a ON a.o = b.s, g WHERE a.o < gh * {SIDE} - 7 GROUP BY ALL),
 p AS (SELECT c.y, wx.o AS x, c.ch, sum(wx.w * c.v) AS v FROM chan c JOIN wx ON wx.s = c.x WHERE c.ch < 3 GROUP BY ALL), q AS (SELECT wy.o AS y, p.x, p.ch, sum(wy.w * p.v) AS v FROM p JOIN wy ON wy.s = p.y GROUP BY ALL)
 SELECT y, x, first(ch + 1 ORDER BY round(v, 9) DESC, ch) AS label FROM q WHERE ch <> 1 GROUP BY y, x""")
def op_R01_roi_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores enlarged, cropped and shrunk to a display, then the best of two allowed classes."""
    s, h = _scores(spark, sf_dir)
    return projection.roi_mask(s, (h, X.TOKEN_WIDTH), (h * SIDE - 7, X.TOKEN_WIDTH * SIDE - 3), (h * 3 + 1, 61), (1, 3), SIDE).select("y", "x", "label")


def _remap(name: str, n: str, m: str) -> str:
    return f"""{name} AS (SELECT o, greatest(0, least(b + k, n - 1))::BIGINT AS s, sum({_kernel('abs(p - b - k)', -0.75)}) AS w FROM (SELECT o, n, p, floor(p) AS b FROM (SELECT o, ({n}) AS n, (o + 0.5::DOUBLE) / {SIDE} - 0.5 AS p FROM g, range(100000) r(o) WHERE o < {m}) z) y, (VALUES (-1), (0), (1), (2)) t(k) GROUP BY ALL)"""


@query(f"""WITH {CHAN}, {G}, {_remap('wx', '20', str(20 * SIDE))}, {_remap('wy', 'gh', f'gh * {SIDE}')},
 p AS (SELECT c.y, wx.o AS x, c.ch, sum(wx.w * c.v) AS v FROM chan c JOIN wx ON wx.s = c.x WHERE c.ch < 3 GROUP BY ALL), q AS (SELECT wy.o AS y, p.x, p.ch, sum(wy.w * p.v) AS v FROM p JOIN wy ON wy.s = p.y GROUP BY ALL)
 SELECT y, x, CASE WHEN (y // 8 + x // 8) % 5 = 0 THEN 0 ELSE first(ch + 1 ORDER BY round(v, 9) DESC, ch) END AS label FROM q GROUP BY y, x""")
def op_R02_project_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores remapped to pixels, the best class on the support, 0 off it."""
    s, h = _scores(spark, sf_dir)
    cells = spark.range(h * SIDE * X.TOKEN_WIDTH * SIDE).select(F.lit("e0").alias("image_id"), F.expr(f"id div {X.TOKEN_WIDTH * SIDE}").alias("y"), (F.col("id") % (X.TOKEN_WIDTH * SIDE)).alias("x"))
    support = cells.withColumn("on", F.expr("(y div 8 + x div 8) % 5 <> 0"))
    return projection.project_mask(s, (h, X.TOKEN_WIDTH), support, (1, 2, 3), SIDE).select("y", "x", "label")


@query(f"""WITH {PIX}, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM pix), o AS (SELECT y, x, pred, h, w FROM pix, s)
 SELECT y, x, pred AS label, (SELECT count(*) FROM range(-1, 2) a(i) WHERE (y // 16 + i) BETWEEN 0 AND (h - 1) // 16 AND y >= (y // 16 + i) * 16 - 3 AND y < least((y // 16 + i) * 16 + 16, h) + 3) * (SELECT count(*) FROM range(-1, 2) b(j) WHERE (x // 16 + j) BETWEEN 0 AND (w - 1) // 16 AND x >= (x // 16 + j) * 16 - 3 AND x < least((x // 16 + j) * 16 + 16, w) + 3) AS seen FROM o""")
def op_R25_core_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster cut into shards with halos, and assembled from their cores once all halos agree."""
    p = X.raster(spark, sf_dir)
    frame = p.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    w = whole(readers.windows(frame, 16, 3))  # as many as the raster has cells by 256, from a frame of one row
    near = lambda c: F.explode(F.transform(F.sequence(F.floor((F.col(c) - 3) / 16), F.floor((F.col(c) + 3) / 16)), lambda k: k * 16))  # noqa: E731  the cores in whose halo a cell may lie
    cells = p.select(*grid.KEY, F.col("pred").alias("label"), near("y").alias("core_y")).select("*", near("x").alias("core_x"))
    within = lambda c, at, n: (F.col(c) >= F.col(at)) & (F.col(c) < F.col(at) + F.col(n))
    spans = w.select("image_id", "core_y", "core_x", "core_h", "core_w", F.col("y").alias("at_y"), F.col("x").alias("at_x"), "h", "w")
    shards = cells.join(spans, ["image_id", "core_y", "core_x"]).where(within("y", "at_y", "h") & within("x", "at_x", "w")).drop("at_y", "at_x", "h", "w")
    return projection.assembled(shards, frame).select("y", "x", "label", "seen")


@query(f"""WITH {PIX}, s AS (SELECT max(y) // 8 AS my, max(x) // 8 AS mx FROM pix), c AS (SELECT least((y + 1) // 8, my) * 100000 + least((x + 1) // 8, mx) AS part, (y // 8) * 100000 + x // 8 AS other, count(*) AS cells FROM pix, s GROUP BY ALL)
 SELECT part, max(struct_pack(cells := cells, other := other)).other AS other, max(cells) AS cells FROM c GROUP BY part""")
def op_J09_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted tiles, each with the tile that shares most cells with it."""
    p = X.raster(spark, sf_dir)
    my, mx = p.agg(F.expr("max(y) div 8"), F.expr("max(x) div 8")).first()
    shifted = p.select(*grid.KEY, F.expr(f"least((y + 1) div 8, {my}) * 100000 + least((x + 1) div 8, {mx})").alias("part"))
    return projection.one_to_one(shifted, p.select(*grid.KEY, F.expr("(y div 8) * 100000 + x div 8").alias("part"))).select("part", "other", "cells")


@query(f"WITH {CHAN}, {PIX}, {SHAPE}, {WEIGHTS} SELECT group_id, ch, sum(n)::BIGINT AS mass, round(sum(n * v) / sum(n), 6) AS mean FROM wt JOIN chan ON chan.y = ty AND chan.x = tx GROUP BY ALL")
def op_A06_polygon_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass and mean token of each class, its region given by polygons: rings, the cells whose centres they hold, their tokens."""
    tok, p = X.tokens(spark, sf_dir), X.raster(spark, sf_dir)
    gh = tok.agg(F.max("y") + 1).first()[0]
    h, w = p.agg(F.max("y") + 1, F.max("x") + 1).first()
    cells = vector.rasterize(vector.polygonize(components.label_components(p, "pred", block=64)))
    weights = cells.groupBy(F.col("label").alias("group_id"), S.token_of(F.col("y"), h, gh).alias("y"), S.token_of(F.col("x"), w, X.TOKEN_WIDTH).alias("x")).agg(F.count("*").alias("n"))
    return weights.join(X.channels(tok), ["y", "x"]).groupBy("group_id", "ch").agg(F.sum("n").alias("mass"), F.round(F.sum(F.col("n") * F.col("v")) / F.sum("n"), 6).alias("mean"))


@query(f"WITH {PIX}, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM pix) SELECT y, x, round((0.15::DOUBLE + 0.85::DOUBLE * power(sin(pi() * (((y + 0.5::DOUBLE) * (h * 3) / h) % 90) / 90), 2) * power(sin(pi() * (((x + 0.5::DOUBLE) * (w * 3) / w) % 90) / 90), 2)) * (support)::INT, 9) AS weight FROM pix, s")
def op_R23_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft weights of cells by their place in 90-pixel tiles of a frame three times as fine; 0 off the support."""
    p = X.raster(spark, sf_dir)
    h, w = p.agg(F.max("y") + 1, F.max("x") + 1).first()
    weight = projection.evidence_weight(F.col("y"), F.col("x"), h * 3, w * 3, h, w, 90.0)
    return p.select("y", "x", F.round(weight * F.col("support").cast("int"), 9).alias("weight"))


@query(f"{COMP}, a AS (SELECT c, count(*) AS n, min(l) AS l FROM comp JOIN lab USING (id) GROUP BY c) SELECT l AS label, count(*) AS parts, sum(n)::DOUBLE AS area FROM a GROUP BY l")
def op_V05_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons cut at tile edges, dissolved by class: parts and area of each class."""
    p = X.tiles(X.raster(spark, sf_dir), 32)
    cut = p.withColumn("both", F.expr("(ty * 100000 + tx) * 10 + pred"))
    rings = vector.polygonize(components.label_components(cut, "both", block=64)).withColumn("label", F.col("label") % 10)
    out = vector.dissolve(rings, 64)
    part = out.groupBy("component", "label").agg(F.sum(vector.ring_area("points")).alias("a"))
    return part.groupBy("label").agg(F.count("*").alias("parts"), F.sum("a").alias("area"))


@query(f"WITH {PIX} SELECT count(*) AS cells, 0::BIGINT AS different FROM pix WHERE support")
def op_S19_support_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A support mask and the polygons bound to it: its cells, and how many the two select differently."""
    on = X.raster(spark, sf_dir).where("support").select(*grid.KEY, F.lit(1).cast("long").alias("label"))
    back = vector.rasterize(vector.polygonize(components.label_components(on, "label", block=64)))
    both = on.join(back.select(*grid.KEY, F.col("label").alias("b")), list(grid.KEY), "full")
    return both.agg(F.count("*").alias("cells"), F.count_if(~F.col("label").eqNullSafe(F.col("b"))).alias("different"))


@query(f"WITH {CHAN}, f AS (SELECT vec_id, class_id, ch, v FROM chan UNION ALL SELECT vec_id, class_id, 64, 1.0 FROM tok) SELECT a.class_id, a.ch AS i, b.ch AS j, round(sum(a.v * b.v), 6) AS g FROM f a JOIN f b ON b.vec_id = a.vec_id AND a.ch <= b.ch GROUP BY ALL")
def op_M02_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class's sums of products of channels (64 stands for the constant one): all that a ridge head is solved from."""
    return features.gram_products(X.tokens(spark, sf_dir), 64).select("class_id", "i", "j", F.round("v", 6).alias("g"))


@query(f"""WITH {PIX}, b AS (SELECT truth, y // 32 AS r, x // 32 AS c, sha256(string_agg(y || ',' || x, ';' ORDER BY y, x)) AS d FROM pix WHERE NOT support GROUP BY ALL)
 SELECT truth, sha256(string_agg(r || ',' || c || ',' || d, ';' ORDER BY r, c)) AS digest FROM b GROUP BY truth""")
def op_A20_block_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each class's cells off the support, by way of digests of blocks: no task holds more than a block's cells, or a class's blocks."""
    p = X.raster(spark, sf_dir).where("not support")
    return features.block_digests(p, "truth", 32).select("truth", "digest")


@query()
def op_M09_numeric_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scaled, balanced logistic head of three groups on all tokens: hits by group."""
    tok = X.tokens(spark, sf_dir).withColumn("class_id", 1 + F.col("class_id") % 3)
    p = heads.numeric_probabilities(tok, heads.fit_numeric(tok))
    best = F.array_position("p", F.array_max("p"))
    return p.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(best == F.col("class_id")).alias("hits"))
