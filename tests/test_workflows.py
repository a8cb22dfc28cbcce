"""A whole run: train, predict, publish, verify, evaluate; and the numeric head of three groups."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import workflows
from tessella.operators import features, heads, projection


def test_train_predict_publish_verify_evaluate(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("e", y, x, [float(v) for v in rng.normal(0, 1, 6) + 4 * np.eye(6)[int(x >= 5)]], 1 + int(x >= 5)) for y in range(8) for x in range(10)]
    tok = spark.createDataFrame(rows, "image_id string, y long, x long, feat array<float>, class_id long")
    digest = workflows.train(tok, 6, str(tmp_path / "head"))
    head = workflows.load_head(spark, str(tmp_path / "head"))
    mask = workflows.predict(tok, head, (8, 10), (30, 38), (30, 38), (20.0, 20.0), [1, 2], side=4)
    receipt = workflows.publish(mask, str(tmp_path / "mask"), "run", {"head": digest})
    assert workflows.verify(spark, str(tmp_path / "mask"), {"head": digest}) == 2 and receipt.first().ts == receipt.first().ts
    truth = mask.select("image_id", "y", "x", (1 + (F.col("x") >= 20).cast("long")).alias("label"))
    assert all(r.iou > 0.95 for r in workflows.evaluate(mask, truth).collect())
    with pytest.raises(ValueError):
        workflows.verify(spark, str(tmp_path / "mask"), {"head": "other"})
    workflows.sinks.write_mask(mask.where("y > 0"), str(tmp_path / "other"))
    with pytest.raises(ValueError):
        workflows.verify(spark, str(tmp_path / "other"), {"head": digest}, str(tmp_path / "mask.receipt"))
    for a, b in ((mask.where("y < 15"), truth), (mask, truth.where("x < 20"))):
        with pytest.raises(Exception, match="same cells"):
            workflows.evaluate(a, b).collect()


def test_segment_slide_exports_clean_polygons(spark, tmp_path):
    """Two halves on a box of tissue: the mask is the support, classes below the floor are out, polygons are native and agree."""
    rows = [("s", y, x, [10.0 * (x < 6), 10.0 * (x >= 6)]) for y in range(10) for x in range(12)]
    tok = spark.createDataFrame(rows, "image_id string, y long, x long, feat array<float>")
    head = features.Ridge([1, 2, 3], np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), np.array([0.0, 0.0, -100.0]))
    box = [(6.0, 5.0), (44.0, 5.0), (44.0, 36.0), (6.0, 36.0), (6.0, 5.0)]
    tissue = spark.createDataFrame([("s", 1, 1, box)], "image_id string, component long, label long, points array<struct<x:double,y:double>>")
    frame = spark.createDataFrame([("s", 40, 48)], "image_id string, height long, width long")
    path = str(tmp_path / "slide")
    receipt = workflows.segment_slide(tok, head, (10, 12), tissue, frame, (10.0, 10.0), (5.0, 5.0), path, "r", {"head": "h"}, side=4).first()
    mask = {(r.y, r.x): r.label for r in workflows.sinks.read_mask(spark, f"{path}/mask").collect()}
    assert len(mask) == 40 * 48 and all((v > 0) == (5 <= y < 36 and 6 <= x < 44) for (y, x), v in mask.items())
    assert set(mask.values()) == {0, 1, 2} and all(v == 1 + (x >= 24) for (_, x), v in mask.items() if v)
    assert receipt.inputs["classes"] == "[1, 2]" and workflows.verify(spark, f"{path}/mask", dict(receipt.inputs)) == 3
    shapes = [json.loads(r.value) for r in spark.read.text(f"{path}/polygons").collect()]
    assert {s["properties"]["class_id"]: sorted(map(tuple, s["geometry"]["coordinates"][0]))[-1] for s in shapes} == {1: (48.0, 72.0), 2: (88.0, 72.0)}
    with pytest.raises(Exception, match="exists"):
        workflows.segment_slide(tok, head, (10, 12), tissue, frame, (10.0, 10.0), (5.0, 5.0), path, "r", {}, side=4)


def test_binary_head_decides_at_zero(spark):
    rows = [("a", y, x, c, v) for y in range(4) for x in range(6) for c, v in ((2, 5.0), (4, 1.0 if x >= 3 else -1.0))]
    scores = spark.createDataFrame(rows, "image_id string, y long, x long, class_id long, score double")
    got = {(r.y, r.x): r.label for r in projection.roi_mask(scores, (4, 6), (16, 24), (16, 24), [2, 4], 4, [2, 4]).collect()}
    assert all(got[y, x] == (4 if x >= 12 else 2) for y, x in got)
    assert {r.label for r in projection.roi_mask(scores, (4, 6), (16, 24), (16, 24), [2, 4], 4).collect()} == {2}
    with pytest.raises(ValueError):
        projection.roi_mask(scores, (4, 6), (16, 24), (16, 24), [2], 4, [2, 4])


def test_presence_floor(spark):
    scores = spark.createDataFrame([("a", 0, x, c, float(c == (1 if x < 97 else 2))) for x in range(100) for c in (1, 2, 3)], "image_id string, y long, x long, class_id long, score double")
    cells = scores.select("image_id", "y", "x").distinct()
    assert workflows.present_classes(scores, cells, 0.02) == [1, 2] and workflows.present_classes(scores, cells, 0.04) == [1] and workflows.present_classes(scores, cells, 0.99) == [1]
    with pytest.raises(ValueError):
        workflows.present_classes(scores, cells.limit(0), 0.02)


def test_numeric_head(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), [float(v) for v in rng.normal(0, 1, 4) + 3 * np.eye(4)[c]]) for c in (1, 2, 3) for _ in range(60)]
    tok = spark.createDataFrame(rows, "class_id long, feat array<float>")
    head = heads.fit_numeric(tok)
    got = heads.numeric_probabilities(tok, head).collect()
    assert head["class_ids"] == [1, 2, 3] and all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    assert np.mean([1 + int(np.argmax(r.p)) == r.class_id for r in got]) > 0.9
    with pytest.raises(ValueError):
        heads.fit_numeric(tok.where("class_id < 3"))
