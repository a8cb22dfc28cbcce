"""Queries on regions: repair, polygons, classifier heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import components, grid, heads, repair, selection, vector
from tessella.plans.queries_cells import CC, REACH
from tessella.plans.registry import query
from tessella.sources import fixtures as X

PIX, TOK, CHAN = X.PIX, X.TOK, X.CHAN
ROW = 1 << 31


@query()
def op_R11_roi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(X.raster(spark, sf_dir), "pred", 6, "roi").select("y", "x", "label")


@query()
def op_R12_wsi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.raster(spark, sf_dir).withColumn("pred", F.when(F.col("event_id") % 17 == 0, F.lit(0)).otherwise(F.col("pred")))
    return repair.repair(p, "pred", 6, "wsi", "support").select("y", "x", "label")


@query()
def op_R13_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(X.raster(spark, sf_dir), "pred", 6, "single").select("y", "x", "label")


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.polygonize(components.label_components(X.raster(spark, sf_dir), "pred", block=64))


COMP = f"WITH RECURSIVE {PIX}, {CC.format(more='')}, {REACH}, comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id)"


@query(f"{COMP}, same AS (SELECT p.c, count(*) AS n FROM link JOIN comp p ON p.id = u JOIN comp q ON q.id = v AND q.c = p.c GROUP BY p.c) SELECT comp.c // 100000 AS y, comp.c % 100000 AS x, count(*)::DOUBLE AS area, 4 * count(*) - 2 * coalesce(any_value(n), 0) AS perimeter FROM comp LEFT JOIN same ON same.c = comp.c GROUP BY comp.c")
def op_V02_polygonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and edge length of each component's rings; holes count off."""
    p = F.col("points")
    length = F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])), F.lit(0.0), lambda s, v: s + v)
    per = _rings(spark, sf_dir).groupBy("component").agg(F.sum(vector.ring_area("points")).alias("area"), F.sum(length).cast("long").alias("perimeter"))
    return per.select(F.expr(f"component div {ROW}").alias("y"), (F.col("component") % ROW).alias("x"), "area", "perimeter")


@query(f"{COMP}, a AS (SELECT c, count(*) AS n, min(l) AS l FROM comp JOIN lab USING (id) GROUP BY c) SELECT l AS label, count(*) AS parts FROM a GROUP BY l")
def op_V04_outer_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer rings by class: one a component, of positive area."""
    r = _rings(spark, sf_dir).where(~F.col("hole") & (vector.ring_area("points") > 0))
    return r.groupBy("label").agg(F.count("*").alias("parts"))


@query(f"WITH {PIX} SELECT count(*) AS cells, 0::BIGINT AS different FROM pix")
def op_V12_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster to rings to raster: no cell differs."""
    p = X.raster(spark, sf_dir).select(*grid.KEY, F.col("pred").alias("label"))
    back = vector.rasterize(_rings(spark, sf_dir))
    both = p.join(back.select(*grid.KEY, F.col("label").alias("b")), list(grid.KEY), "full")
    return both.agg(F.count("*").alias("cells"), F.count_if(~F.col("label").eqNullSafe(F.col("b"))).alias("different"))


@query(f"{COMP}, a AS (SELECT c, count(*) AS n FROM comp GROUP BY c) SELECT c // 100000 AS y, c % 100000 AS x FROM a WHERE n >= 4")
def op_V03_drop_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components left when parts under 4 pixels go; outer-ring areas, so enclosed components don't count off."""
    r = _rings(spark, sf_dir)
    small = r.groupBy("component").agg(F.sum(vector.ring_area("points")).alias("a")).where("a < 4").select("component")
    kept = vector.drop_small(r, 4, 1).join(small, "component", "left_anti").select("component").distinct()
    return kept.select(F.expr(f"component div {ROW}").alias("y"), (F.col("component") % ROW).alias("x"))


@query(f"""WITH {CHAN}, e AS (SELECT vec_id, ch, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM chan WHERE ch < 5), s AS (SELECT vec_id, ch, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
 SELECT vec_id, ch, round(p, 6) AS p FROM s""")
def op_M24_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = heads.softmax(F.transform(F.slice("feat", 1, 5), lambda v: v.cast("double")))
    return X.tokens(spark, sf_dir).select("vec_id", F.posexplode(p).alias("ch", "p")).select("vec_id", F.col("ch").cast("long").alias("ch"), F.round("p", 6).alias("p"))


@query(f"""WITH {CHAN}, e AS (SELECT vec_id, ch, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM chan WHERE ch < 3), s AS (SELECT vec_id, ch, e / sum(e) OVER (PARTITION BY vec_id) * power([0.2, 0.3, 0.5][ch + 1]::DOUBLE, -0.5::DOUBLE) AS q FROM e)
 SELECT vec_id, ch, round(q / sum(q) OVER (PARTITION BY vec_id), 6) AS p FROM s""")
def op_M10_prior_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = heads.prior_corrected(heads.softmax(F.transform(F.slice("feat", 1, 3), lambda v: v.cast("double"))), (0.2, 0.3, 0.5), -0.5)
    return X.tokens(spark, sf_dir).select("vec_id", F.posexplode(p).alias("ch", "p")).select("vec_id", F.col("ch").cast("long").alias("ch"), F.round("p", 6).alias("p"))


@query()
def op_M08_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced logistic head on classes 1 to 4: overlap with its own training labels."""
    tok = X.tokens(spark, sf_dir).where("class_id <= 4")
    p = heads.predict_logistic(tok, heads.fit_logistic(tok, C=0.3))
    return p.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("class_id")).alias("hits"))


@query()
def op_K03_select_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 channels by pairwise relevance and redundancy, in order."""
    taken = selection.select_pairwise(X.tokens(spark, sf_dir), 16)
    return spark.createDataFrame(list(enumerate(taken)), "rank long, ch long")


@query()
def op_M11_fold_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels 0 to 7 of each token from the others' channels 8 to 31, each quadrant by the other three: mean squared error by quadrant."""
    tok = X.tokens(spark, sf_dir)
    h = tok.agg(F.max("y") + 1).first()[0]
    rows = tok.select("vec_id", F.slice("feat", 9, 24).alias("x"), F.slice("feat", 1, 8).alias("y"), ((F.col("y") * 2 >= h).cast("int") * 2 + (F.col("x") * 2 >= X.TOKEN_WIDTH).cast("int")).alias("fold"))
    fits = selection.fold_ridge(rows, 100.0)

    def out_of_fold(k: int):
        coef, intercept = fits[k]
        return F.array(*(F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in coef[:, j])), lambda a, b: a * b), F.lit(float(intercept[j])), lambda s, v: s + v) for j in range(coef.shape[1])))

    p = rows.withColumn("p", F.coalesce(*(F.when(F.col("fold") == k, out_of_fold(k)) for k in sorted(fits))))
    err = F.aggregate(F.zip_with("p", "y", lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda s, v: s + v) / 8
    return p.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(err), 6).alias("mse"))


@query()
def op_R15_single_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of two classes, small parts with one contact relabelled."""
    p = X.raster(spark, sf_dir).withColumn("pred", 1 + F.col("pred") % 2)
    return repair.relabel_single_contact(p, "pred", 6).select("y", "x", "label")


@query()
def op_R18_tissue_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of a synthetic stain: each class has its own colour."""
    p = X.raster(spark, sf_dir)
    h, w = p.agg(F.max("y") + 1, F.max("x") + 1).first()
    grey = F.when(F.col("pred") < 3, 240).otherwise(120)
    rgb = p.select(*grid.KEY, grey.alias("r"), grey.alias("g"), (grey + 5).alias("b"))
    return repair.tissue_support(rgb, h, w, 1.0, 1.0, 30.0, 30.0).select("y", "x", "on")


@query(f"{COMP} SELECT c // 100000 AS y, c % 100000 AS x, count(*) * 6.0::DOUBLE AS area FROM comp GROUP BY c")
def op_S25_source_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the components' rings in source coordinates, 2 and 3 times as fine along x and y."""
    r = _rings(spark, sf_dir).withColumn("points", vector.scaled("points", 2.0, 3.0))
    per = r.groupBy("component").agg(F.sum(vector.ring_area("points")).alias("area"))
    return per.select(F.expr(f"component div {ROW}").alias("y"), (F.col("component") % ROW).alias("x"), "area")


@query(f"{COMP}, a AS (SELECT c, count(*) AS area, min(l) AS l FROM comp JOIN lab USING (id) GROUP BY c) SELECT c // 100000 AS y, c % 100000 AS x, name, area FROM a JOIN (VALUES (1, 'one'), (2, 'two'), (3, 'three'), (4, 'four')) t(id, name) ON t.id = l WHERE area > 5")
def op_J12_polygon_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons with the properties of the region they came from."""
    labelled = components.label_components(X.raster(spark, sf_dir), "pred")
    props = components.component_table(labelled).where("area > 5").select("component", "label", "area")
    names = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "label long, name string")
    outer = vector.polygonize(labelled).where(~F.col("hole")).select("component").distinct()
    met = outer.join(props, "component").join(F.broadcast(names), "label")
    return met.select(F.expr(f"component div {ROW}").alias("y"), (F.col("component") % ROW).alias("x"), "name", "area")


@query(f"{COMP}, s AS (SELECT c, count(*) AS n FROM comp GROUP BY c), k AS (SELECT id, CASE WHEN n >= 4 THEN l ELSE 0 END AS b, l AS a FROM comp JOIN s USING (c) JOIN lab USING (id)) SELECT a AS class_id, round(sum((a = b)::INT) / count(*), 6) AS kept FROM k GROUP BY a")
def op_A19_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each class's cells that a cleanup of parts under 4 cells keeps."""
    labelled = components.label_components(X.raster(spark, sf_dir), "pred")
    size = components.component_table(labelled).select("component", "area")
    return labelled.join(size, "component").groupBy(F.col("label").alias("class_id")).agg(F.round(F.count_if(F.col("area") >= 4) / F.count("*"), 6).alias("kept"))
