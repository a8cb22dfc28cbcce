"""Scans: checksum-bound files, arrays, manifests, annotation rasters, spot tables, windows."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bound_files(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """(name, path, content) of files listed as (name, path, sha256); an error if a file's digest differs.

    A null sha256 binds nothing. Files are read by Spark's binary source; a missing file fails the read.
    """
    listed = {r.path: (r.name, r.sha256) for r in refs.select("name", "path", "sha256").collect()}  # a manifest's few references
    files = spark.read.format("binaryFile").load(list(listed))
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def whole(path: str) -> str:
        p = hadoop.Path(path)
        return p.getFileSystem(conf).makeQualified(p).toString()

    want = spark.createDataFrame([(n, p, whole(p), s) for p, (n, s) in listed.items()], "name string, listed string, full string, sha256 string")
    met = files.join(F.broadcast(want), F.col("path") == F.col("full"))
    same = F.col("sha256").isNull() | (F.sha2("content", 256) == F.lower("sha256"))
    return met.select("name", F.col("listed").alias("path"), F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), "listed"))).alias("content"))


def npy_rows(files: DataFrame, columns: int, dtype: str | None = None) -> DataFrame:
    """(path, row, feat array<float>) of 2-D .npy files (path, content): no pickles, the width and dtype checked.

    Decoded in Arrow batches on the executors; half precision widens to float.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 2 or a.shape[1] != columns or (dtype and a.dtype != np.dtype(dtype)):
                    raise ValueError(f"{path}: expected {dtype or 'numbers'} of shape (n, {columns}), found {a.dtype} {a.shape}")
                for at in range(0, len(a), 4096):
                    part = np.ascontiguousarray(a[at : at + 4096], np.float32)
                    feat = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, columns, dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int64)), feat], ["path", "row", "feat"])

    return files.select("path", "content").mapInArrow(run, "path string, row long, feat array<float>")


def pixel_size(xml: str) -> DataFrame | F.Column:
    """(mpp_x, mpp_y, width, height) from a column of OME-XML."""
    get = lambda attr, kind: F.xpath_string(F.col(xml), F.lit(f"//*[local-name()='Pixels']/@{attr}")).cast(kind)
    return F.struct(get("PhysicalSizeX", "double").alias("mpp_x"), get("PhysicalSizeY", "double").alias("mpp_y"), get("SizeX", "long").alias("width"), get("SizeY", "long").alias("height"))


def windows(images: DataFrame, core: int, halo: int) -> DataFrame:
    """(image_id, core_y, core_x, core_h, core_w, y, x, h, w): cores that partition each image, and their clipped halos."""
    grid = images.select("image_id", "height", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1, F.lit(core).cast("long"))).alias("core_y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1, F.lit(core).cast("long"))).alias("core_x"))
    grid = grid.withColumns({"core_h": F.least(F.lit(core), F.col("height") - F.col("core_y")), "core_w": F.least(F.lit(core), F.col("width") - F.col("core_x"))})
    y, x = F.greatest(F.col("core_y") - halo, F.lit(0)), F.greatest(F.col("core_x") - halo, F.lit(0))
    h = F.least(F.col("core_y") + F.col("core_h") + halo, F.col("height")) - y
    w = F.least(F.col("core_x") + F.col("core_w") + halo, F.col("width")) - x
    return grid.select("image_id", "core_y", "core_x", "core_h", "core_w", y.alias("y"), x.alias("x"), h.alias("h"), w.alias("w"))


def strict_manifest(manifests: DataFrame, column: str, schema: T.StructType, forbidden: Sequence[str] = ()) -> DataFrame:
    """(manifest struct): parsed JSON; an error for a missing required field, an unknown or a forbidden key, or bad JSON."""
    keys = F.json_object_keys(F.col(column))
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    needed = F.array(*(F.lit(f.name) for f in schema.fields if not f.nullable)).cast("array<string>")
    odd = F.array_except(keys, known)
    fail = lambda text, names: F.raise_error(F.concat(F.lit(text), F.array_join(names, ", ")))
    banned = F.array_intersect(keys, F.array(*map(F.lit, forbidden)).cast("array<string>"))
    parsed = F.from_json(F.col(column), T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))
    checked = (
        F.when(keys.isNull(), F.raise_error(F.lit("not a JSON object"))).when(F.size(banned) > 0, fail("forbidden keys: ", banned)).when(F.size(odd) > 0, fail("unknown keys: ", odd))
        .when(F.size(F.array_except(needed, keys)) > 0, fail("missing keys: ", F.array_except(needed, keys))).otherwise(parsed)
    )
    return manifests.select(checked.alias("manifest"))


def annotation_grid(raster: DataFrame, code: str, classes: dict[int, int | None], token: int = 14) -> DataFrame:
    """(image_id, y, x, label): annotation codes at token centres (7, 21, ...), mapped; 0 for None; an unmapped code is an error."""
    half = token // 2
    at = raster.where(((F.col("y") - half) % token == 0) & ((F.col("x") - half) % token == 0))
    pairs = [F.lit(v) for k, c in classes.items() for v in (k, c or 0)]
    label = F.element_at(F.create_map(*pairs), F.col(code).cast("int"))
    checked = F.when(label.isNull(), F.raise_error(F.concat(F.lit("unmapped code "), F.col(code).cast("string")))).otherwise(label)
    return at.select("image_id", F.expr(f"(y - {half}) div {token}").alias("y"), F.expr(f"(x - {half}) div {token}").alias("x"), checked.cast("long").alias("label"))


#: Pairs of columns (x, y) by which spot tables are recognised, in order of preference. Fixed values.
SPOT_COLUMNS = (("pxl_col_in_fullres", "pxl_row_in_fullres"), ("imagecol", "imagerow"), ("sdimx", "sdimy"), ("x", "y"))


def spots(coordinates: DataFrame, metadata: DataFrame, cluster: str, spot: str = "spot_id", tissue: str = "in_tissue") -> DataFrame:
    """(spot_id, x, y, cluster): coordinates joined with cluster metadata on the spot; spots off the tissue go."""
    found = [pair for pair in SPOT_COLUMNS if set(pair) <= set(coordinates.columns)]
    if not found:
        raise ValueError("no coordinate columns are recognised")
    x, y = found[0]
    inside = coordinates.where(F.col(tissue).cast("int") == 1) if tissue in coordinates.columns else coordinates
    return inside.select(F.col(spot).alias("spot_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).join(metadata.select(F.col(spot).alias("spot_id"), F.col(cluster).alias("cluster")), "spot_id")


def ordered_groups(labels: DataFrame, rows: int) -> DataFrame:
    """(row_index, group) once row_index is exactly 0..rows-1 and groups are 1..max without gaps; else an error."""
    s = labels.agg(F.count("*").alias("n"), F.countDistinct("row_index").alias("d"), F.min("row_index").alias("lo"), F.max("row_index").alias("hi"), F.countDistinct("group").alias("g"), F.min("group").alias("g0"), F.max("group").alias("g1")).first()
    if (s.n, s.d, s.lo, s.hi) != (rows, rows, 0, rows - 1):
        raise ValueError("row_index must be 0..rows-1, each once")
    if s.g0 != 1 or s.g != s.g1 or s.g1 > 254:
        raise ValueError("groups must be 1..n without gaps, 254 at most")
    return labels.select("row_index", "group")
