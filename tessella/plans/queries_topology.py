"""Queries on the planar topology of a raster, on contracted small regions, and on kernels over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import components, contraction, features, field, grid, heads, overlay, pls, stencil, topology, vector
from tessella.plans.queries_channels import CHANNELS, _sql
from tessella.plans.registry import query
from tessella.sources import fixtures as X

PIX = X.PIX
ROW = 1 << 31

#: Unit edges between cells of different labels (off the raster: null), their ends with the direction into the edge, and corners.
EDGES = f"""{PIX}, lab AS (SELECT y, x, pred AS l FROM pix),
 e AS (SELECT coalesce(b.y, a.y + 1) AS y, coalesce(b.x, a.x) AS x, 0 AS d FROM lab a FULL JOIN lab b ON b.y = a.y + 1 AND b.x = a.x WHERE a.l IS DISTINCT FROM b.l
  UNION ALL SELECT coalesce(b.y, a.y), coalesce(b.x, a.x + 1), 1 FROM lab a FULL JOIN lab b ON b.y = a.y AND b.x = a.x + 1 WHERE a.l IS DISTINCT FROM b.l),
 named AS (SELECT (y * 100000 + x) * 2 + d AS id, y, x, d FROM e),
 fin AS (SELECT id, y, x, d AS way FROM named UNION ALL SELECT id, y + d, x + 1 - d, d + 2 FROM named),
 deg AS (SELECT y, x, count(*) AS n FROM fin GROUP BY y, x)"""


def _coverage(spark: SparkSession, sf_dir: str) -> topology.Coverage:
    return topology.Coverage(components.label_components(X.raster(spark, sf_dir), "pred", block=64), block=64)


@query(f"WITH {EDGES} SELECT y, x, n AS arcs FROM deg WHERE n > 2")
def op_V06_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners at which three or four arcs end."""
    return _coverage(spark, sf_dir).junctions().select("y", "x", "arcs")


@query(f"""WITH RECURSIVE {EDGES}, link AS (SELECT a.id AS u, b.id AS v FROM fin a JOIN fin b ON b.y = a.y AND b.x = a.x AND b.id <> a.id JOIN deg ON deg.y = a.y AND deg.x = a.x AND n = 2),
 reach(root, id) AS (SELECT id, id FROM named s WHERE NOT EXISTS (SELECT 1 FROM link WHERE u = s.id AND v < s.id) UNION SELECT root, v FROM reach JOIN link ON u = id),
 arc AS (SELECT id, min(root) AS c FROM reach GROUP BY id),
 p AS (SELECT c, fin.y, fin.x, way, n FROM fin JOIN arc USING (id) JOIN deg USING (y, x)),
 f AS (SELECT c, count(*) // 2 AS length, max(n) = 2 AS closed, min((y * 100000 + x) * 4 + way) FILTER (n > 2) AS first, min((y * 100000 + x) * 4) AS low FROM p GROUP BY c)
 SELECT coalesce(first, low) // 400000 AS y, coalesce(first, low) // 4 % 100000 AS x, coalesce(first, low) % 4 AS direction, length, closed FROM f""")
def op_V06_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal lines between two regions: where each begins, which way, how long it is."""
    return _coverage(spark, sf_dir).arcs.select(F.col("y0").alias("y"), F.col("x0").alias("x"), F.col("d0").cast("long").alias("direction"), "length", "closed")


@query(f"WITH {PIX} SELECT pred AS label, count(*)::DOUBLE AS area FROM pix GROUP BY pred")
def op_V06_face_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by class from shoelace sums along arcs; no ring is assembled."""
    labelled = components.label_components(X.raster(spark, sf_dir), "pred", block=64)
    areas = topology.Coverage(labelled, block=64).face_areas()
    return areas.join(components.component_table(labelled).select("image_id", "component", "label"), ["image_id", "component"]).groupBy("label").agg(F.sum("area").alias("area"))


@query(f"WITH {PIX} SELECT count(*)::DOUBLE AS area, 0::BIGINT AS crossing, true AS fewer FROM pix")
def op_V06_shared_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs simplified to one cell, those at the frame kept: what neighbours gain and lose adds up to nothing, and no arcs cross."""
    c = _coverage(spark, sf_dir)
    frame = (F.col("left") == topology.OUTSIDE) | (F.col("right") == topology.OUTSIDE)
    points = topology.fitted(c, c.arcs.select("image_id", "arc", F.when(frame, 0.0).otherwise(1.0).alias("tolerance")))
    area = c.face_areas(points).agg(F.round(F.sum("area"), 6).alias("area"))
    crossing = topology.crossing(points).agg(F.count("*").alias("crossing"))
    fewer = points.agg(F.count("*").alias("n")).crossJoin(c.points.agg(F.count("*").alias("m"))).select((F.col("n") < F.col("m")).alias("fewer"))  # one row each
    return area.crossJoin(crossing).crossJoin(fewer)


#: Tiles of 8 cells in two classes; in the whole ones a part of one cell, or of two, by the cell's value, and a hole of one cell or of two.
SPECKS = f"""{PIX}, t AS (SELECT y // 8 AS ty, x // 8 AS tx, count(*) AS n, max(value) FILTER (y % 8 = 2 AND x % 8 = 2) AS v FROM pix GROUP BY ALL),
 s AS (SELECT y, x, ty, tx, n, v, 1 + (ty + tx) % 2 AS tile, CASE WHEN n = 64 AND y % 8 = 2 AND x % 8 = 2 OR n = 64 AND v > 50 AND y % 8 = 2 AND x % 8 = 3 THEN 9
  WHEN n = 64 AND y % 8 = 5 AND x % 8 = 5 OR n = 64 AND v > 100 AND y % 8 = 5 AND x % 8 = 6 THEN 0 ELSE 1 + (ty + tx) % 2 END AS label FROM pix JOIN t ON ty = y // 8 AND tx = x // 8)"""


def _specks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.tiles(X.raster(spark, sf_dir))
    at = lambda y, x: (F.col("y") % 8 == y) & (F.col("x") % 8 == x)
    t = p.groupBy("image_id", "ty", "tx").agg(F.count("*").alias("n"), F.max(F.when(at(2, 2), F.col("value"))).alias("v"))
    p = p.join(t, ["image_id", "ty", "tx"])
    whole, tile = F.col("n") == 64, 1 + (F.col("ty") + F.col("tx")) % 2
    part = whole & (at(2, 2) | (at(2, 3) & (F.col("v") > 50)))
    hole = whole & (at(5, 5) | (at(5, 6) & (F.col("v") > 100)))
    return p.select(*grid.KEY, F.when(part, 9).when(hole, 0).otherwise(tile).cast("long").alias("label"))


@query(f"WITH {SPECKS} SELECT y, x, CASE WHEN label = 9 AND v > 50 THEN 9 WHEN label = 0 AND v > 100 THEN 0 ELSE tile END AS label FROM s")
def op_R14_small_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and holes of one cell go, those of two stay."""
    return contraction.fill_small_regions(_specks(spark, sf_dir), "label", 2, block=64).select("y", "x", "label")


@query()
def op_R14_small_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions of fewer than six cells of the predicted raster merged, the largest first."""
    return contraction.fill_small_regions(X.raster(spark, sf_dir), "pred", 6, block=64).select("y", "x", "label")


@query(f"WITH {SPECKS} SELECT ty * 8 AS y, tx * 8 AS x, n::DOUBLE AS outer_area, CASE WHEN n = 64 THEN (CASE WHEN v > 50 THEN 2 ELSE 0 END) + (CASE WHEN v > 100 THEN 2 ELSE 0 END) ELSE 0 END::DOUBLE AS holes FROM t UNION ALL SELECT ty * 8 + 2, tx * 8 + 2, 2.0, 0.0 FROM t WHERE n = 64 AND v > 50")
def op_V03_small_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of outer rings and of holes left when parts and holes of less than two cells are dropped."""
    labelled = components.label_components(_specks(spark, sf_dir), "label", block=64)
    kept = vector.drop_small(vector.polygonize(labelled), 2, 2).withColumn("a", F.abs(vector.ring_area("points")))
    per = kept.groupBy("component").agg(F.sum(F.when(~F.col("hole"), F.col("a"))).alias("outer_area"), F.coalesce(F.sum(F.when(F.col("hole"), F.col("a"))), F.lit(0.0)).alias("holes"))
    return per.select(F.expr(f"component div {ROW}").alias("y"), (F.col("component") % ROW).alias("x"), "outer_area", "holes")


def _stained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four classes' probabilities and a stain by class, from the raster."""
    p = X.raster(spark, sf_dir)
    share = lambda k: F.when(F.col("pred") == k, 0.5 + (F.col("event_id") % 13) * 0.01).otherwise(0.1 + 0.013 * k + (F.col("event_id") % 7) * 0.002)
    red = (60 + 35 * F.col("truth") + (F.col("event_id") * 7) % 11).cast("int")
    return p.select(*grid.KEY, F.array(*map(share, range(1, 5))).alias("p"), red.alias("r"), (red + 10).alias("g"), (F.lit(255) - red).alias("b"), F.col("support").alias("inside"))


def _diffusion_sql(rounds: int = stencil.ROUNDS) -> str:
    """Two passes of a blur with mirrored edges, conductances between neighbours, and one CTE a step."""
    share = lambda k: f"CASE WHEN pred = {k} THEN 0.5::DOUBLE + (event_id % 13) * 0.01::DOUBLE ELSE 0.1::DOUBLE + 0.013::DOUBLE * {k} + (event_id % 7) * 0.002::DOUBLE END"
    mirrored = lambda c, n: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= {n} THEN 2 * {n} - 2 - ({c}) ELSE {c} END"
    columns = lambda f: ", ".join(f"{f(c)} AS {c}" for c in "rgb")
    ps = [f"p{k}" for k in range(1, 5)]
    out = [
        PIX, f"raw AS (SELECT y, x, support AS inside, {', '.join(f'{share(k)} AS p{k}' for k in range(1, 5))}, 60 + 35 * truth + (event_id * 7) % 11 AS red FROM pix)",
        "size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM raw)",
        f"c AS (SELECT y, x, inside, {', '.join(f'CASE WHEN inside THEN {p} / ({'+'.join(ps)}) ELSE 0 END AS {p}' for p in ps)}, red::DOUBLE AS r, red + 10.0::DOUBLE AS g, 255.0::DOUBLE - red AS b FROM raw)",
        "taps AS (SELECT k, exp(-0.5::DOUBLE * k * k) / (SELECT sum(exp(-0.5::DOUBLE * j * j)) FROM range(-3, 4) t(j)) AS w FROM range(-3, 4) t(k))",
        f"b1 AS (SELECT c.y, c.x, {columns(lambda v: f'sum(taps.w * s.{v})')} FROM c CROSS JOIN taps CROSS JOIN size JOIN c s ON s.x = c.x AND s.y = {mirrored('c.y + k', 'h')} GROUP BY c.y, c.x)",
        f"b2 AS (SELECT c.y, c.x, {columns(lambda v: f'-ln((round_even(sum(taps.w * s.{v}), 0) + 1) / 256)')} FROM b1 c CROSS JOIN taps CROSS JOIN size JOIN b1 s ON s.y = c.y AND s.x = {mirrored('c.x + k', 'size.w')} GROUP BY c.y, c.x)",
        f"n AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2, {stencil.STRENGTH}::DOUBLE * ({stencil.FLOOR}::DOUBLE + {1 - stencil.FLOOR}::DOUBLE * exp(-((u.r - v.r) ** 2 + (u.g - v.g) ** 2 + (u.b - v.b) ** 2) / {2 * stencil.CONTRAST**2}::DOUBLE)) AS w FROM c a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) ON a.inside JOIN c b ON b.y = a.y + dy AND b.x = a.x + dx AND b.inside JOIN b2 u ON u.y = a.y AND u.x = a.x JOIN b2 v ON v.y = b.y AND v.x = b.x)",
        "own AS (SELECT y, x, 1 + sum(w) AS w FROM n GROUP BY y, x)", "q0 AS (SELECT y, x, p1, p2, p3, p4 FROM c WHERE inside)",
    ]
    for k in range(rounds):
        out.append(f"q{k + 1} AS (SELECT c.y, c.x, {', '.join(f'(c.{p} + coalesce(s.{p}, 0)) / coalesce(own.w, 1) AS {p}' for p in ps)} FROM c LEFT JOIN own ON own.y = c.y AND own.x = c.x LEFT JOIN (SELECT n.y, n.x, {', '.join(f'sum(w * q.{p}) AS {p}' for p in ps)} FROM n JOIN q{k} q ON q.y = n.y2 AND q.x = n.x2 GROUP BY n.y, n.x) s ON s.y = c.y AND s.x = c.x WHERE c.inside)")
    best = "CASE WHEN q.p1 IS NULL THEN 0 WHEN q.p1 >= greatest(q.p2, q.p3, q.p4) THEN 1 WHEN q.p2 >= greatest(q.p3, q.p4) THEN 2 WHEN q.p3 >= q.p4 THEN 3 ELSE 4 END"
    return f"WITH {', '.join(out)} SELECT c.y, c.x, {best}::BIGINT AS label FROM c LEFT JOIN q{rounds} q ON q.y = c.y AND q.x = c.x"


@query(_diffusion_sql())
def op_R19_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen steps of diffusion along the stain, by blocks with a halo of 24."""
    return stencil.diffuse(_stained(spark, sf_dir), block=64).select("y", "x", "label")


R21 = {"smoothness": 0.8, "rounds": 5, "sigma": 0.3, "margin": 0.44, "distance_um": 1.0}


def _refinement_sql() -> str:
    """Cells that may move by a self join within the distance, and one CTE a step; the others keep their probabilities."""
    head = _diffusion_sql(0).removeprefix("WITH ").split(", taps AS")[0].replace("CASE WHEN inside THEN p1 / (p1+p2+p3+p4) ELSE 0 END", "p1")
    ps = [f"p{k}" for k in range(1, 5)]
    for p in ps[1:]:
        head = head.replace(f"CASE WHEN inside THEN {p} / (p1+p2+p3+p4) ELSE 0 END", p)
    best = "CASE WHEN p1 >= greatest(p2, p3, p4) THEN 1 WHEN p2 >= greatest(p3, p4) THEN 2 WHEN p3 >= p4 THEN 3 ELSE 4 END"
    density = lambda c: f"-ln(({c} + 1) / 256)"
    out = [
        head, f"l AS (SELECT *, CASE WHEN inside THEN {best} ELSE 0 END AS raw, list_reverse(list_sort([p1, p2, p3, p4])) AS s FROM c)",
        "nb AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2, a.raw <> b.raw AS differs, a.r AS r1, b.r AS r2, a.g AS g1, b.g AS g2, a.b AS b1, b.b AS b2 FROM l a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) ON a.inside JOIN l b ON b.y = a.y + dy AND b.x = a.x + dx AND b.inside)",
        "edge AS (SELECT DISTINCT y, x FROM nb WHERE differs)",
        f"mv AS (SELECT l.y, l.x FROM l WHERE inside AND s[1] - s[2] <= {R21['margin']} AND EXISTS (SELECT 1 FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) JOIN edge ON edge.y = l.y + dy AND edge.x = l.x + dx))",
        f"n AS (SELECT y, x, y2, x2, {R21['smoothness']}::DOUBLE * exp(-(({density('r1')} - {density('r2')}) ** 2 + ({density('g1')} - {density('g2')}) ** 2 + ({density('b1')} - {density('b2')}) ** 2) / {2 * R21['sigma'] ** 2}::DOUBLE) AS w FROM nb)",
        "own AS (SELECT y, x, 1 + sum(w) AS w FROM n GROUP BY y, x)", "q0 AS (SELECT y, x, p1, p2, p3, p4 FROM l)",
    ]
    for k in range(R21["rounds"]):
        moved = ", ".join(f"CASE WHEN mv.y IS NULL THEN l.{p} ELSE (l.{p} + coalesce(s.{p}, 0)) / coalesce(own.w, 1) END AS {p}" for p in ps)
        out.append(f"q{k + 1} AS (SELECT l.y, l.x, {moved} FROM l LEFT JOIN mv ON mv.y = l.y AND mv.x = l.x LEFT JOIN own ON own.y = l.y AND own.x = l.x LEFT JOIN (SELECT n.y, n.x, {', '.join(f'sum(w * q.{p}) AS {p}' for p in ps)} FROM n JOIN q{k} q ON q.y = n.y2 AND q.x = n.x2 GROUP BY n.y, n.x) s ON s.y = l.y AND s.x = l.x)")
    return f"WITH {', '.join(out)} SELECT l.y, l.x, raw::BIGINT AS raw, mv.y IS NOT NULL AS movable, (CASE WHEN mv.y IS NULL THEN raw ELSE (SELECT {best} FROM q{R21['rounds']} q WHERE q.y = l.y AND q.x = l.x) END)::BIGINT AS label FROM l LEFT JOIN mv ON mv.y = l.y AND mv.x = l.x"


@query(_refinement_sql())
def op_R21_boundary_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure cells at borders moved by the stain, five steps; all others stay."""
    cells = _stained(spark, sf_dir).withColumnRenamed("inside", "support")
    return stencil.refine_boundaries(cells, (1.0, 1.0), block=64, keep_classes=False, **R21).select("y", "x", "raw", "movable", "label")


@query(f"""WITH {PIX}, o(dy, dx, a) AS (VALUES (0, 0, 0.375), (0, 1, 0.375), (1, 0, 0.125), (1, 1, 0.125)),
 m AS (SELECT p.pred AS a, 10 + q.pred AS b, o.a AS area FROM pix q CROSS JOIN o JOIN pix p ON p.y = q.y + dy AND p.x = q.x + dx) SELECT a, b, round(sum(area)::DOUBLE, 6) AS area FROM m GROUP BY a, b""")
def op_V13_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact overlaps of the classes' polygons with themselves moved by a quarter and a half of a cell; within either set there are none."""
    c = _rings_of(spark, sf_dir)
    moved = c.select("image_id", (F.col("label") + 10).alias("label"), F.transform("points", lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.25).alias("y"))).alias("points"))
    got = overlay.overlaps(c.select("image_id", "label", "points").unionByName(moved), "label")
    return got.where("area > 1e-7").select("a", "b", F.round("area", 6).alias("area"))


def _rings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = components.label_components(X.raster(spark, sf_dir), "pred", block=64)
    names = components.component_table(labelled).select("image_id", "component", "label")
    return topology.Coverage(labelled, block=64).polygons().join(names, ["image_id", "component"])


@query(f"WITH {EDGES} SELECT (sum(n) // 2)::BIGINT AS within FROM deg WHERE n > 2")
def op_V19_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many arcs between junctions stay within the distance that they were simplified by: all."""
    c = _coverage(spark, sf_dir)
    far = topology.displacement(c.points, topology.simplify(c.points, 2.0), 4.0)
    return far.join(c.arcs.where("not closed").select("image_id", "arc"), ["image_id", "arc"]).agg(F.count_if(F.col("distance") <= 2.0 + 1e-9).alias("within"))


@query("WITH tok AS (SELECT vec_id, vec_id // 20 AS y, vec_id % 20 AS x, label FROM embeddings) SELECT vec_id, round(CASE WHEN label = 3 THEN 2.0::DOUBLE ELSE 0 END + 0.015::DOUBLE * (label % 4), 5) AS rhs FROM tok")
def op_R22_field_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smooth field over the token grid by conjugate gradients, put back into its equations by plain joins: the right sides again."""
    tok = X.tokens(spark, sf_dir)
    guide = tok.select(*grid.KEY, F.transform(F.slice("feat", 1, 3), lambda v: v.cast("double")).alias("g"))
    own = tok.select(*grid.KEY, "vec_id", F.when(F.col("class_id") == 4, 1.0).otherwise(0.0).alias("m"), ((F.col("class_id") - 1) % 4).cast("double").alias("prior"))
    rows = field.conductances(guide, "g", (8.0, 8.0), 16.0).join(own, list(grid.KEY)).withColumn("system", F.col("image_id"))
    rows = rows.select("system", "vec_id", "y", "x", "right", "left", "down", "up", (F.col("m") + 0.015).alias("diagonal"), F.array(2 * F.col("m") + 0.015 * F.col("prior")).alias("rhs"))
    u = field.solve(rows, block=16).select("y", "x", F.col("u")[0].alias("u"))
    out = rows.join(u, ["y", "x"]).withColumn("sum", F.col("diagonal") * F.col("u"))
    for side, dy, dx in (("right", 0, 1), ("left", 0, -1), ("down", 1, 0), ("up", -1, 0)):
        other = u.select((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("u").alias("v"))
        out = out.join(other, ["y", "x"], "left").withColumn("sum", F.col("sum") + F.when(F.col(side) > 0, F.col(side) * (F.col("u") - F.col("v"))).otherwise(0.0)).drop("v")
    return out.select("vec_id", F.round("sum", 5).alias("rhs"))


@query()
def op_R20_guided_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token probabilities to native labels: interpolated, diffused at half the size, smoothed."""
    p = _stained(spark, sf_dir)
    h, w = p.agg(F.max("y") + 1, F.max("x") + 1).first()
    tokens = p.where("y % 14 = 7 and x % 14 = 7").select("image_id", F.expr("y div 14").alias("y"), F.expr("x div 14").alias("x"), "p")
    th, tw = tokens.agg(F.max("y") + 1, F.max("x") + 1).first()
    return stencil.guided_labels(tokens, (th, tw), p.withColumnRenamed("inside", "support"), (h, w), (0.5, 0.5), block=64).select("y", "x", "label")


@query()
def op_M17_pls_lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIMPLS on all channels with a discriminant on its scores: hits by class on its own tokens."""
    tok = X.tokens(spark, sf_dir)
    head = pls.fit_pls_lda(tok, CHANNELS)
    best = features.ridge_scores(tok, head).withColumn("best", features.first_best("scores", head.classes))
    return best.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("best") == F.col("class_id")).alias("hits"))


def _listed(tok: DataFrame, p: Column) -> DataFrame:
    return tok.select("vec_id", F.posexplode(p).alias("ch", "p")).select("vec_id", F.col("ch").cast("long").alias("ch"), F.round("p", 6).alias("p"))


@query(_sql("op_M24_softmax", (" WHERE ch < 5", "")))
def op_M24_softmax_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(X.tokens(spark, sf_dir), heads.softmax(F.transform("feat", lambda v: v.cast("double"))))


@query(_sql("op_M10_prior_correction", (" WHERE ch < 3", ""), ("power([0.2, 0.3, 0.5][ch + 1]::DOUBLE, -0.5::DOUBLE)", f"power((ch + 1) / {CHANNELS * (CHANNELS + 1) / 2}::DOUBLE, -0.5::DOUBLE)")))
def op_M10_prior_correction_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = [(k + 1) / (CHANNELS * (CHANNELS + 1) / 2) for k in range(CHANNELS)]
    return _listed(X.tokens(spark, sf_dir), heads.prior_corrected(heads.softmax(F.transform("feat", lambda v: v.cast("double"))), prior, -0.5))
