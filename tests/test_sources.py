"""Sources and sinks: bindings, manifests, arrays, spots, masks."""

import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import types as T

from tessella.sources import readers, sinks


def test_bound_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"xyz")
    good = hashlib.sha256(b"abc").hexdigest()
    refs = [("a", str(tmp_path / "a.bin"), good.upper()), ("b", str(tmp_path / "b.bin"), None)]
    schema = "name string, path string, sha256 string"
    got = {r.name: bytes(r.content) for r in readers.bound_files(spark, spark.createDataFrame(refs, schema)).collect()}
    assert got == {"a": b"abc", "b": b"xyz"}
    with pytest.raises(Exception, match="checksum differs"):
        readers.bound_files(spark, spark.createDataFrame([("b", str(tmp_path / "b.bin"), good)], schema)).collect()


def npy(a):
    f = io.BytesIO()
    np.save(f, a)
    return f.getvalue()


def test_npy_rows(spark):
    a = np.arange(30, dtype=np.float16).reshape(10, 3)
    files = spark.createDataFrame([("p", bytearray(npy(a)))], "path string, content binary")
    got = {r.row: list(r.feat) for r in readers.npy_rows(files, 3, "float16").collect()}
    assert got == {i: a[i].tolist() for i in range(10)}
    for columns, dtype in ((4, None), (3, "float32")):
        with pytest.raises(Exception, match="expected"):
            readers.npy_rows(files, columns, dtype).collect()


def test_pixel_size(spark):
    xml = '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image><Pixels PhysicalSizeX="0.5" PhysicalSizeY="0.25" SizeX="100" SizeY="80"/></Image></OME>'
    got = spark.createDataFrame([(xml,)], "x string").select(readers.pixel_size("x").alias("s")).first().s
    assert (got.mpp_x, got.mpp_y, got.width, got.height) == (0.5, 0.25, 100, 80)


def test_strict_manifest(spark):
    schema = T.StructType([T.StructField("model", T.StringType(), False), T.StructField("mpp", T.DoubleType(), True)])
    read = lambda text: readers.strict_manifest(spark.createDataFrame([(text,)], "j string"), "j", schema, ("annotation",)).first().manifest
    assert read('{"model": "m", "mpp": 0.5}').mpp == 0.5 and read('{"model": "m"}').mpp is None
    for text, why in (('{"mpp": 1}', "missing keys: model"), ('{"model": "m", "x": 1}', "unknown keys: x"), ('{"model": "m", "annotation": 1}', "forbidden keys: annotation"), ("[1]", "not a JSON object")):
        with pytest.raises(Exception, match=why):
            read(text)


def test_annotation_grid(spark):
    codes = np.full((31, 31), 99)
    codes[7, 7], codes[7, 21], codes[21, 7], codes[21, 21] = 11, 22, 11, 22
    df = spark.createDataFrame([("a", y, x, int(codes[y, x])) for y in range(31) for x in range(31)], "image_id string, y long, x long, code int")
    got = {(r.y, r.x): r.label for r in readers.annotation_grid(df, "code", {11: 1, 22: 2}).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 2}
    with pytest.raises(Exception, match="unmapped code 22"):
        readers.annotation_grid(df, "code", {11: 1}).collect()


def test_spots_filter_tissue(spark):
    c = spark.createDataFrame([("s1", 10, 20, 1), ("s2", 30, 40, 1), ("s3", 50, 60, 0)], "spot_id string, pxl_col_in_fullres int, pxl_row_in_fullres int, in_tissue int")
    m = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", "c")], "spot_id string, cluster_id string")
    assert sorted(map(tuple, readers.spots(c, m, "cluster_id").collect())) == [("s1", 10.0, 20.0, "a"), ("s2", 30.0, 40.0, "b")]
    mixed = spark.createDataFrame([("s1", 7.0, 1.0, 2.0)], "spot_id string, imagecol double, y double, x double")
    assert [tuple(r) for r in readers.spots(mixed, m, "cluster_id").collect()] == [("s1", 2.0, 1.0, "a")]
    for wrong in (m, mixed.drop("x")):
        with pytest.raises(ValueError, match="no coordinate"):
            readers.spots(wrong, m, "cluster_id")


def test_ordered_groups(spark):
    make = lambda rows: spark.createDataFrame(rows, "row_index long, group int")
    assert readers.ordered_groups(make([(0, 1), (1, 2), (2, 1)]), 3).count() == 3
    for rows in ([(0, 1), (2, 1)], [(0, 1), (0, 1)], [(0, 1), (1, 3)], [(0, 2), (1, 2)]):
        with pytest.raises(ValueError):
            readers.ordered_groups(make(rows), 2)


def test_windows_partition_the_image(spark):
    w = readers.windows(spark.createDataFrame([("a", 10, 7)], "image_id string, height long, width long"), 4, 2).collect()
    seen = np.zeros((10, 7), int)
    for r in w:
        seen[r.core_y : r.core_y + r.core_h, r.core_x : r.core_x + r.core_w] += 1
        assert r.y >= 0 and r.x >= 0 and r.y + r.h <= 10 and r.x + r.w <= 7 and r.y <= r.core_y and r.x <= r.core_x
    assert (seen == 1).all()


def test_mask_and_state_sinks(spark, tmp_path):
    m = spark.createDataFrame([("a", y, x, (y + x) % 3) for y in range(20) for x in range(20)], "image_id string, y long, x long, label long")
    path = str(tmp_path / "mask")
    sinks.write_mask(m, path, block=8)
    assert sinks.read_mask(spark, path).exceptAll(m).count() == 0 and sinks.read_mask(spark, path, (0, 0), (1, 1)).count() == 64
    with pytest.raises(Exception, match="already exists"):
        sinks.write_mask(m, path)
    state = json.dumps({"a": [1, 2]})
    digest = sinks.save_state(spark, state, str(tmp_path / "state"))
    assert digest == hashlib.sha256(state.encode()).hexdigest() and sinks.load_state(spark, str(tmp_path / "state")) == state
    r = sinks.receipt(spark, "r1", "mask-v1", {"mask": digest}, {}).first()
    assert (r.status, r.inputs["mask"]) == ("COMPLETE", digest) and r.ts


def test_geojson_sink(spark, tmp_path):
    rings = spark.createDataFrame([("a", 1, 3, False, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]), ("a", 1, 3, True, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])], "image_id string, component long, label long, hole boolean, points array<struct<x:double,y:double>>")
    sinks.write_geojson(rings, str(tmp_path / "g"), 2.0, 3.0)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert len(lines) == 1 and lines[0]["geometry"]["coordinates"][0][2] == [4.0, 6.0] and lines[0]["properties"] == {"class_id": 3}
