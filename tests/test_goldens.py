"""Hand-computed cases and brute-force models of the grid operators."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import components, features, grid, heads, metrics, repair, selection, vector


def raster(spark, rows, name="label"):
    cells = [("a", y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(cells, f"image_id string, y long, x long, {name} long")


def array(df, shape, name="label"):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def test_boundary_context_lengths(spark):
    adj = grid.adjacency(raster(spark, [[1, 2], [1, 3]]), "label", 1.0, 2.0)
    assert {(r.g1, r.g2): r.len_um for r in adj.collect()} == {(1, 2): 2.0, (1, 3): 2.0, (2, 3): 1.0}
    means = {1: 1.0, 2: 2.0, 3: 4.0}
    lens = {(1, 2): 2.0, (1, 3): 2.0, (2, 3): 1.0}
    near = {g: [(n, next(x for x in k if x != g)) for k, n in lens.items() if g in k] for g in means}
    contrast = {g: means[g] - sum(n * means[o] for n, o in v) / sum(n for n, _ in v) for g, v in near.items()}
    assert contrast == pytest.approx({1: -2.0, 2: 0.0, 3: 8 / 3})


def test_tile_qc_is_strict_and_exact(spark):
    df = spark.createDataFrame([(9, 100), (10, 100), (11, 100), (None, 100)], "bad long, area long")
    assert [r[0] for r in df.select(S.below_share(F.col("bad"), F.col("area"), 10, 100)).collect()] == [True, False, False, False]


def test_spacing_refuses_bad_values(spark):
    good = spark.range(1).select(S.spacing(F.lit(0.5), F.lit(0.25)).alias("s")).first().s
    assert (good.x, good.y) == (0.5, 0.25)
    for x in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite positive"):
            spark.range(1).select(S.spacing(F.lit(x), F.lit(1.0))).collect()


def test_dotted_path_and_remap(spark):
    df = spark.createDataFrame([('{"a": {"b": "7"}}', 3), ('{"a": 1}', 4)], "j string, l long")
    assert [tuple(r) for r in df.select(S.dotted(F.col("j"), "a.b"), S.remap(F.col("l"), {3: 9, 4: None})).collect()] == [("7", 9), (None, 0)]


def plain_components(a, eight):
    seen, out = {}, {}
    for start in zip(*np.nonzero(a), strict=True):
        if start in seen:
            continue
        stack, name = [start], min(start, start)
        seen[start] = name
        while stack:
            y, x = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = y + dy, x + dx
                    if (dy or dx) and (eight or not (dy and dx)) and 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and a[q] == a[y, x] and q not in seen:
                        seen[q] = name
                        stack.append(q)
    for p, n in seen.items():
        out.setdefault(n, set()).add(p)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("block", [4, 7, 64])
def test_components_over_block_seams(spark, eight, block):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (17, 23))
    got = {}
    for r in components.label_components(raster(spark, a.tolist()), "label", eight, block).collect():
        got.setdefault(r.component, set()).add((r.y, r.x))
    assert {frozenset(v) for v in got.values()} == plain_components(a, eight)
    assert all(c == min(y * (1 << 31) + x for y, x in v) for c, v in got.items())


def plain_repair(a, below, mode, support=None, passes=8):
    a = a.copy()
    for _ in range(1 if mode == "single" else passes):
        changed = 0
        for value in [*sorted({int(v) for v in a.ravel()} - {0}), *([0] if support is not None and mode != "roi" else [])]:
            edits = []
            for part in plain_components((a == value).astype(int), True):
                if len(part) >= below:
                    continue
                ys, xs = [p[0] for p in part], [p[1] for p in part]
                if value == 0 and (min(ys) == 0 or min(xs) == 0 or max(ys) == a.shape[0] - 1 or max(xs) == a.shape[1] - 1 or not all(support[p] for p in part)):
                    continue
                ring = {(y + dy, x + dx) for y, x in part for dy in (-1, 0, 1) for dx in (-1, 0, 1)} - set(part)
                votes = Counter(int(a[q]) for q in ring if 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and a[q] != value)
                if mode == "wsi" and any(v > 0 for v in votes):
                    votes = Counter({k: v for k, v in votes.items() if k > 0})
                new = min(votes, key=lambda k: (-votes[k], k)) if votes else 0
                edits += [(p, new) for p in part]
            for p, new in edits:
                a[p] = new
            changed += len(edits)
        if not changed:
            break
    return a


@pytest.mark.parametrize("mode", ["roi", "wsi", "single"])
def test_repair_against_a_plain_model(spark, mode):
    rng = np.random.default_rng(5)
    a = np.kron(rng.integers(1, 4, (4, 4)), np.ones((4, 4), int))
    spots = rng.random(a.shape) < 0.15
    a[spots] = rng.integers(0 if mode != "roi" else 1, 4, spots.sum())
    on = rng.random(a.shape) < 0.9
    df = raster(spark, a.tolist()).join(raster(spark, on.astype(int).tolist(), "on"), ["image_id", "y", "x"]).withColumn("on", F.col("on") == 1)
    support = "on" if mode == "wsi" else None
    got = array(repair.repair(df, "label", 5, mode, support, block=8), a.shape)
    assert (got == plain_repair(a, 5, mode, on if support else None)).all()


def test_repair_threshold(spark):
    assert repair.threshold_pixels(400, 0.5, 0.5) == 1600 and repair.threshold_pixels(100, 3, 1) == 34
    a = np.ones((12, 12), int)
    a[2:6, 2:7] = 2
    for below, left in ((20, 20), (21, 0)):
        assert (array(repair.repair(raster(spark, a.tolist()), "label", below, "roi", block=8), a.shape) == 2).sum() == left


def test_rings_round_trip(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 4, (15, 18))
    labelled = components.label_components(raster(spark, a.tolist()), "label", block=64)
    rings = vector.polygonize(labelled)
    back = vector.rasterize(rings)
    assert vector.round_trip_differences(raster(spark, a.tolist()), back).count() == 0
    assert back.count() == back.select("y", "x").distinct().count() == (a > 0).sum()
    areas = rings.groupBy("component").agg(F.sum(vector.ring_area("points")).alias("a")).collect()
    sizes = {r.component: r.area for r in components.component_table(labelled).collect()}
    assert {r.component: r.a for r in areas} == sizes


def test_ring_with_a_hole_and_its_feature(spark):
    a = np.ones((3, 3), int)
    a[1, 1] = 0
    rings = vector.polygonize(components.label_components(raster(spark, a.tolist()), "label")).select("*", vector.ring_area("points").alias("a")).orderBy("hole").collect()
    assert [(r.hole, r.a, len(r.points)) for r in rings] == [(False, 9.0, 5), (True, -1.0, 5)]
    df = spark.createDataFrame([(8, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0)])], "c int, p array<struct<x:double,y:double>>")
    moved = df.select("c", vector.scaled("p", 8.0, 8.0).alias("p"))
    assert moved.first().p[1].x == 80.0
    feature = json.loads(moved.select(vector.feature_json("p", "c")).first()[0])
    assert feature["geometry"]["coordinates"][0][2] == [80.0, 80.0] and feature["properties"] == {"class_id": 8}


def test_threshold_sweep_golden(spark):
    m = [(-1.0, 1), (-0.8, 2), (-0.2, 1), (0.1, 2), (0.3, 1), (0.7, 2)]
    got = features.threshold_sweep(spark.createDataFrame(m, "margin double, class_id int"), {}, 2, 2 / 3).first()
    assert got.threshold == 0.1 and got.sensitivity == pytest.approx(2 / 3)


def test_ridge_equals_weighted_normal_equations(spark):
    rng = np.random.default_rng(13)
    y = np.repeat(np.arange(1, 5), [10, 20, 30, 4])
    x = rng.normal(size=(64, 12))
    x[np.arange(64), y - 1] += 5
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "vec_id long, feat array<double>, class_id int").repartition(3)
    head = features.fit_ridge(df, 12, 10.0)
    w = np.array([np.sum(y == c) ** -0.5 for c in y])
    w /= w.mean()
    t = np.where(y[:, None] == np.arange(1, 5), 1.0, -1.0)
    mx, mt = (w[:, None] * x).sum(0) / w.sum(), (w[:, None] * t).sum(0) / w.sum()
    coef = np.linalg.solve((x - mx).T @ (w[:, None] * (x - mx)) + 10 * np.eye(12), (x - mx).T @ (w[:, None] * (t - mt)))
    assert np.allclose(head.coef, coef) and np.allclose(head.intercept, mt - mx @ coef)
    pred = features.ridge_scores(df, head).withColumn("p", features.first_best("scores", head.classes)).collect()
    assert [r.p for r in sorted(pred)] == [head.classes[i] for i in np.argmax(x @ coef + mt - mx @ coef, axis=1)]


def test_logistic_gradient_vanishes(spark):
    rng = np.random.default_rng(2)
    y = np.repeat([2, 4], [30, 50])
    x = rng.normal(size=(80, 5)) + y[:, None] / 4
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "feat array<double>, class_id int")
    model, _ = heads.fit_logistic(df, 0.3)
    b, a = model.coefficients.toArray(), model.intercept
    w = np.where(y == 2, 80 / 60, 80 / 100)
    p = 1 / (1 + np.exp(-(x @ b + a)))
    assert np.abs(0.3 * x.T @ (w * (p - (y == 4))) + b).max() < 1e-4


def test_fold_ridge_leaves_its_fold_out(spark):
    rng = np.random.default_rng(4)
    x, f = rng.normal(size=(60, 4)), np.arange(60) % 3
    y = x @ rng.normal(size=(4, 2)) + rng.normal(size=(60, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), int(c)) for a, b, c in zip(x, y, f, strict=True)], "x array<double>, y array<double>, fold int").repartition(4)
    for k, (coef, intercept) in selection.fold_ridge(df, 2.0).items():
        own = f != k
        mx, my = x[own].mean(0), y[own].mean(0)
        want = np.linalg.solve((x[own] - mx).T @ (x[own] - mx) + 2 * np.eye(4), (x[own] - mx).T @ (y[own] - my))
        assert np.allclose(coef, want) and np.allclose(intercept, my - mx @ want)


def test_selection_penalises_redundancy(spark):
    rng = np.random.default_rng(6)
    y = np.repeat([1, 2], 100)
    base = rng.normal(size=200) + 3.0 * y
    x = np.stack([base, base + rng.normal(size=200) * 0.01, rng.normal(size=200) + 2.2 * y, rng.normal(size=200)], axis=1)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "feat array<double>, class_id int")
    assert selection.select_pairwise(df, 2)[1] == 2


def test_boundary_f1_without_interfaces(spark):
    one = raster(spark, [[1, 1], [1, 1]]).withColumn("p", F.col("label"))
    assert metrics.boundary_f1(one, "label", "p", 2.0, 1.0, 1.0).first().f1 is None
    two = raster(spark, [[1, 2], [1, 2]]).withColumn("p", F.lit(1))
    assert metrics.boundary_f1(two, "label", "p", 2.0, 1.0, 1.0).first().f1 == 0.0


def test_nearest_filled_far_cells(spark):
    rng = random.Random(1)
    cells = [("a", y, x, y * 100 + x, (y, x) not in {(0, 0), (30, 30)} and rng.random() < 2) for y in range(31) for x in range(31)]
    df = spark.createDataFrame(cells, "image_id string, y long, x long, v long, gap boolean")
    got = {(r.y, r.x): r.v for r in grid.nearest_filled(df, ["v"], "gap").collect()}
    assert len(got) == 31 * 31 - 2
    for (y, x), v in got.items():
        assert v == min((y * y + x * x, 0, 0, 0), ((30 - y) ** 2 + (30 - x) ** 2, 30, 30, 3030))[3]


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(8)
    df = raster(spark, rng.integers(0, 3, (9, 11)).tolist()).withColumn("v", F.col("label").cast("double"))
    runs = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted((r.y, r.x, round(r.v, 9)) for r in grid.gaussian(df, "v", 0.75, 9, 11).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]


def test_tissue_support_islands_and_holes(spark):
    a = np.full((40, 40), 250)
    a[5:30, 5:30] = 100
    a[12:16, 12:16] = 250  # a hole of 16 cells, less after the blur
    a[34:38, 34:38] = 100  # an island
    cells = [("a", y, x, int(v), int(v), int(v)) for y, row in enumerate(a) for x, v in enumerate(row)]
    df = spark.createDataFrame(cells, "image_id string, y long, x long, r int, g int, b int")
    on = array(repair.tissue_support(df, 40, 40, 1.0, 1.0, 50.0, 50.0, block=16).withColumn("label", F.col("on").cast("int")), a.shape)
    assert on[13, 13] == 1 and on[36, 36] == 0 and on[0, 0] == 0 and on[10, 10] == 1
    plain = array(repair.tissue_support(df, 40, 40, 1.0, 1.0, 1.0, 1.0, block=16).withColumn("label", F.col("on").cast("int")), a.shape)
    assert plain[13, 13] == 0 and plain[36, 36] == 1


def test_relabel_single_contact(spark):
    a = np.ones((12, 12), int)
    a[:, 6:] = 2
    a[2, 2] = 2  # an island in class 1
    a[5, 5:7] = [2, 1]  # two islands side by side, each in the other's class
    a[8, 9] = 0  # a hole in class 2
    a[0, 0] = 2  # at the frame
    got = array(repair.relabel_single_contact(raster(spark, a.tolist()), "label", 3, block=5), a.shape)
    want = a.copy()
    want[2, 2], want[8, 9], want[0, 0] = 1, 2, 1
    want[5, 5:7] = [1, 2]
    assert (got == want).all()
    kept = array(repair.relabel_single_contact(raster(spark, a.tolist()), "label", 3, True, block=5), a.shape)
    assert kept[0, 0] == 2 and kept[2, 2] == 1
    with pytest.raises(ValueError, match="two classes"):
        repair.relabel_single_contact(raster(spark, [[1, 1]]), "label", 3)


def test_distances_by_image_and_without_targets(spark):
    a = spark.createDataFrame([(i, y, x) for i in ("p", "q") for y in range(0, 9, 4) for x in range(0, 300, 97)] + [("p", 2000, 5)], "image_id string, y long, x long")
    b = spark.createDataFrame([("p", 3, 250), ("p", 70, 1), ("p", 1, 0), ("p", 1, 1)], "image_id string, y long, x long")
    got = {(r.image_id, r.y, r.x): r.d for r in grid.distances(a, b, 0.5, 2.0).collect()}
    want = {}
    for r in a.where("image_id = 'p'").collect():
        want["p", r.y, r.x] = min((((r.y - t.y) * 2.0) ** 2 + ((r.x - t.x) * 0.5) ** 2) ** 0.5 for t in b.collect())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert grid.distances(a, b.limit(0), 1.0, 1.0).count() == 0


def test_nearest_cells_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    cells = lambda n: sorted({(f"i{rng.randrange(2)}", rng.randrange(150), rng.randrange(150)) for _ in range(n)})
    a, b = cells(300), cells(60)
    got = {(r.image_id, r.y, r.x): (r.sy, r.sx) for r in grid.nearest_cells(*(spark.createDataFrame(t, "image_id string, y long, x long") for t in (a, b))).collect()}
    assert got == {p: min((((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, q[1], q[2]) for q in b if q[0] == p[0]))[1:] for p in a}


def test_geojson_keeps_holes(spark, tmp_path):
    from tessella.operators import components, vector
    from tessella.sources import sinks

    ring = spark.createDataFrame([("e", y, x, 1) for y in range(3) for x in range(3) if (y, x) != (1, 1)], "image_id string, y long, x long, label long")
    sinks.write_geojson(vector.polygonize(components.label_components(ring, "label")), str(tmp_path / "g"))
    shapes = [json.loads(r.value)["geometry"]["coordinates"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    area = lambda ring: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring[:-1], ring[1:], strict=True)) / 2
    assert len(shapes) == 1 and [area(r) for r in shapes[0]] == [9.0, -1.0]


def test_bound_files_match_whole_paths(spark, tmp_path):
    import hashlib

    from tessella.sources import readers

    refs = []
    for name, content in (("a.npy", b"one"), ("ya.npy", b"two")):
        (tmp_path / name).write_bytes(content)
        refs.append((name, str(tmp_path / name), hashlib.sha256(content).hexdigest()))
    got = readers.bound_files(spark, spark.createDataFrame(refs, "name string, path string, sha256 string")).collect()
    assert sorted((r.name, bytes(r.content)) for r in got) == [("a.npy", b"one"), ("ya.npy", b"two")]


def test_ridge_from_class_grams(spark):
    rng = np.random.default_rng(2)
    rows = [([float(v) for v in rng.normal(c, 1, 5)], c, i % 2) for i, c in enumerate([1, 2, 3] * 30 + [1] * 10)]
    tok = spark.createDataFrame(rows, "feat array<float>, class_id long, fold long").repartition(3)
    grams = features.class_grams(tok, 5, "fold")
    for folds, balanced in (([0, 1], True), ([1], True), ([0], False)):
        a, b = features.ridge_of(grams, folds, 7.0, balanced), features.fit_ridge(tok.where(F.col("fold").isin(folds)), 5, 7.0, balanced)
        assert a.classes == b.classes and np.allclose(a.coef, b.coef) and np.allclose(a.intercept, b.intercept)


def test_threshold_sweep_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(c, 1.5), c) for c in (0, 1) for _ in range(400)] + [(0.25, 0), (0.25, 1)] * 5
    got = features.threshold_sweep(spark.createDataFrame(rows, "margin double, class_id long"), {}, 1, 0.8).first()
    p, n = sum(c for _, c in rows), sum(1 - c for _, c in rows)
    cuts = [(1 - sum(m >= t for m, c in rows if not c) / n, t, sum(m >= t for m, c in rows if c) / p) for t in {m for m, _ in rows}]
    want = max((s, t, e) for s, t, e in cuts if e >= 0.8)
    assert (got.threshold, round(got.specificity, 9), round(got.sensitivity, 9)) == (want[1], round(want[0], 9), round(want[2], 9))


def test_assembly_refuses_gaps_and_disagreement(spark):
    from tessella.operators import projection

    frame = spark.createDataFrame([("e", 2, 4)], "image_id string, height long, width long")
    shards = [("e", y, x, 0, c, 2, 2, 1) for c in (0, 2) for y in (0, 1) for x in range(max(0, c - 1), min(4, c + 3))]
    make = lambda rows: spark.createDataFrame(rows, "image_id string, y long, x long, core_y long, core_x long, core_h long, core_w long, label long")
    assert sorted((r.y, r.x, r.label, r.seen) for r in projection.assembled(make(shards), frame).collect()) == [(y, x, 1, 2 if x in (1, 2) else 1) for y in (0, 1) for x in range(4)]
    odd = [(*s[:-1], 2) if (s[1], s[2], s[4]) == (0, 1, 2) else s for s in shards]
    with pytest.raises(Exception, match="disagree"):
        projection.assembled(make(odd), frame).collect()
    with pytest.raises(Exception, match="gap|uncovered"):
        projection.assembled(make([s for s in shards if (s[1], s[2]) != (1, 3)]), frame).collect()


def test_dissolve_refuses_overlapping_classes(spark):
    square = lambda i, label, x: ("e", i, label, 0, False, [{"x": float(a), "y": float(b)} for a, b in ((x, 0), (x + 4, 0), (x + 4, 4), (x, 4), (x, 0))])
    make = lambda *rows: spark.createDataFrame(rows, vector.RINGS)
    got = vector.dissolve(make(square(1, 1, 0), square(2, 1, 4), square(3, 2, 8))).select("label", vector.ring_area("points").alias("a")).collect()
    assert sorted(map(tuple, got)) == [(1, 32.0), (2, 16.0)]
    with pytest.raises(Exception, match="overlap"):
        vector.dissolve(make(square(1, 1, 0), square(2, 2, 2))).collect()


def test_feature_contract(spark):
    names = [f"c{i}" for i in range(1280)]
    one = F.struct(*(F.lit(0.5).alias(n) for n in names))
    encoder = lambda revision, sha: F.struct(F.lit(revision).alias("revision"), F.lit(sha).alias("sha256")).alias("encoder")
    table = spark.range(1).select(one.alias("s"), encoder("r1", "0" * 64)).select("s.*", "encoder")
    assert S.feature_contract(table, "virchow2-spatial", names).select("c7", "encoder.revision").first() == (0.5, "r1")
    for bad in ((table, "other", names), (table, "virchow2-pooled", names), (table, "virchow2-spatial", names[::-1]), (table.withColumn("c3", F.lit("x")), "virchow2-spatial", names), (table.drop("c9"), "virchow2-spatial", names)):
        with pytest.raises(ValueError):
            S.feature_contract(*bad)
    for revision, sha in (("", "0" * 64), ("r1", "0" * 63), ("r1", "A" * 64), (None, "0" * 64)):
        with pytest.raises(Exception, match="encoder needs"):
            S.feature_contract(table.drop("encoder").select("*", encoder(revision, sha)), "virchow2-spatial", names).select("encoder").collect()
