"""Exact overlaps and validity of polygon sets."""

import math

import numpy as np
import pytest

from tessella.operators import components, overlay, topology

SCHEMA = "image_id string, component long, ring long, points array<struct<x:double,y:double>>"


def rings(spark, parts):
    return spark.createDataFrame([("a", k, i, [(float(x), float(y)) for x, y in [*p, p[0]]]) for i, (k, p) in enumerate(parts)], SCHEMA)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def found(df):
    return {(r.a, r.b): r.area for r in df.collect()}


@pytest.mark.parametrize("band", [0.7, 16.0, 1000.0])
def test_areas_of_shapes_made_by_hand(spark, band):
    circle = [(50 + 10 * math.cos(2 * math.pi * k / 60), 50 + 10 * math.sin(2 * math.pi * k / 60)) for k in range(60)]
    polygon = 30 * 100 * math.sin(2 * math.pi / 60)
    parts = [
        (1, box(0, 0, 10, 10)), (2, box(5, 5, 20, 8)),  # 5 * 3
        (3, [(0, 20), (10, 20), (0, 30)]), (4, [(10, 30), (0, 30), (10, 20)]),  # one edge in common, no area
        (5, [(0, 40), (8, 40), (0, 48)]), (6, [(8, 48), (0, 48), (4, 40)]),  # triangles that cross
        (7, circle), (8, box(50, 30, 90, 70)), (9, box(45.5, 49.25, 46.5, 50.75)),  # half of it, and a small one inside
        (10, box(0, 100, 9, 109)), (10, box(3, 103, 6, 106)), (11, box(4, 104, 8, 105)),  # a hole counts off
    ]
    got = found(overlay.overlaps(rings(spark, parts), band=band))
    want = {(1, 2): 15.0, (5, 6): 32 / 3, (7, 8): polygon / 2, (7, 9): 1.5, (10, 11): 2.0}
    assert {k for k, v in got.items() if v > 1e-9} == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_what_is_invalid_is_named(spark):
    parts = [(1, box(0, 0, 10, 10)), (2, box(10, 0, 20, 10)), (3, box(19, 5, 30, 9)), (4, [(50, 0), (60, 10), (60, 0), (50, 10)]), (5, [(70, 0), (75, 0), (80, 0)])]
    df = rings(spark, parts).unionByName(spark.createDataFrame([("a", 6, 9, [(0.0, 90.0), (5.0, 90.0), (5.0, 95.0), (0.0, 95.0)])], SCHEMA))
    got = {(r.owner, r.other, r.problem) for r in overlay.invalid(df).collect()}
    assert got == {(2, 3, "overlap"), (4, None, "crosses itself"), (5, None, "no area"), (6, None, "not closed")} or got == {(2, 3, "overlap"), (4, None, "crosses itself"), (4, None, "no area"), (5, None, "no area"), (5, None, "crosses itself"), (6, None, "not closed")}
    assert overlay.invalid(rings(spark, parts[:2])).isEmpty() and overlay.overlaps(df.limit(0)).isEmpty()


def test_ladder_takes_the_largest_share_that_the_guards_admit(spark):
    """A staircase between two labels; a tight guard refuses large tolerances, an impossible one leaves all as it was."""
    y, x = np.mgrid[:40, :50]
    a = np.where(x > y + 5, 1, 2)
    df = spark.createDataFrame([("a", int(i), int(j), int(a[i, j])) for i in range(40) for j in range(50)], "image_id string, y long, x long, label long")
    labelled = components.label_components(df, "label")
    coverage, labels = topology.Coverage(labelled), components.component_table(labelled).select("image_id", "component", "label")
    points, attempts = overlay.compacted(coverage, labels, 1.0)
    assert len(attempts) == 1 and attempts[0]["admitted"] and attempts[0]["overlap"] < 1e-7 and points.count() < coverage.points.count() / 4
    n = {1: int((a == 1).sum()), 2: int((a == 2).sum())}
    areas = {r.label: r.area for r in coverage.face_areas(points).join(labels, ["image_id", "component"]).collect()}
    both = {r.label: 0.0 for r in labels.collect()}
    assert math.isclose(sum(areas.values()), 2000.0) and all(attempts[0]["iou"][k] <= min(n[k], areas[k]) / max(n[k], areas[k]) + 1e-12 for k in both)
    assert math.isclose(attempts[0]["changed"], sum(1 - v for v in attempts[0]["iou"].values()) / 2, abs_tol=0.02)
    points, attempts = overlay.compacted(coverage, labels, 1.0, minimum_iou=1.0 + 1e-9)
    assert len(attempts) == 5 and not any(t["admitted"] for t in attempts) and points.count() == coverage.points.count()
    same = overlay.agreement(coverage.polygons().join(labels, ["image_id", "component"]), coverage.polygons().join(labels, ["image_id", "component"]))
    assert same["changed"] < 1e-12 and all(math.isclose(v, 1) for v in same["iou"].values())
