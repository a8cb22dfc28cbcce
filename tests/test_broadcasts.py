"""Tables that grow with the raster are joined by exchanges: Spark takes them to be small by their files or by one row they come from."""

import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import components, repair, vector
from tessella.plans import durable, queries_cells, queries_projection, queries_regions, queries_whole  # noqa: F401
from tessella.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def sent_whole(df):
    """Keys of the joins that got one side whole, as the plan was in the end."""
    df.collect()
    return [set(re.findall(r"(\w+)#", keys)) for keys in re.findall(r"BroadcastHashJoin \[(.*?)\]", df._jdf.queryExecution().executedPlan().toString())]


@pytest.mark.parametrize("name", ["op_A13_region_covering", "op_J12_polygon_properties", "op_K08_component_order_whole", "op_R15_single_contact", "op_R25_core_assembly", "op_A19_agreement"])
def test_cells_and_regions_are_not_sent_to_every_task(spark, monkeypatch, name):
    monkeypatch.setattr(durable, "BROADCAST", 0)
    assert not [k for k in sent_whole(QUERIES[name](spark, SF)) if k & {"y", "x", "component", "part", "p", "core_y"}]


def test_repaired_cells_are_sent_only_up_to_a_number(spark, monkeypatch):
    cells = spark.createDataFrame([("a", i // 20, i % 20, 2 if i == 105 else 1) for i in range(400)], "image_id string, y long, x long, label long")
    assert {"y", "x"} <= set().union(*sent_whole(cells.transform(lambda d: durable.joined_left(durable.stash(d), durable.stash(d.select("y", "x", F.lit(3).alias("new"))), ["y", "x"]))))
    monkeypatch.setattr(durable, "BROADCAST", 0)
    told = []
    monkeypatch.setattr(repair, "stash", lambda df, cells=False: told.append((cells, sent_whole(df))) or durable.stash(df, cells))
    got = repair.repair(cells, "label", 3, "wsi").collect()
    assert {r.label for r in got} == {1} and len(got) == 400
    assert told and all(cells for cells, _ in told) and not [k for _, keys in told for k in keys if k & {"y", "x", "component"}]


def test_renamed_parts_join_only_where_there_are_any(spark):
    one = spark.createDataFrame([("a", y, x, 1 + (x > 3)) for y in range(4) for x in range(8)], "image_id string, y long, x long, label long")
    for block in (4, 3):  # no part goes on beyond a seam, all do
        assert sorted((r.component % (1 << 31), r.label) for r in components.component_table(components.label_components(one, "label", block=block)).collect()) == [(0, 1), (4, 2)]


def test_many_components_are_traced_in_one_call(spark, monkeypatch):
    """Rings of whole blocks and of blocks cut anywhere are the same; tracing goes on over batches, and no call is made for a component."""
    a = [[1 if (y * 7 + x * x) % 5 else 2 for x in range(23)] for y in range(19)]
    cells = spark.createDataFrame([("a", y, x, v) for y, row in enumerate(a) for x, v in enumerate(row)], "image_id string, y long, x long, label long")
    labelled = durable.stash(components.label_components(cells, "label"))
    rings = [sorted((r.component, r.ring, r.hole, [tuple(p) for p in r.points]) for r in vector.polygonize(labelled, block).collect()) for block in (256, 5, 1)]
    assert rings[0] == rings[1] == rings[2] and len(rings[0]) > 20
    assert "FlatMapGroupsInPandas" not in vector.polygonize(labelled, 1)._jdf.queryExecution().toString()
    monkeypatch.setattr(vector, "EDGES_AT_ONCE", 3)
    import pyarrow as pa

    squares = [("a", c, 1, *e) for c in range(4) for e in ((0, c, 0, c + 1), (0, c + 1, 1, c + 1), (1, c, 0, c), (1, c + 1, 1, c))]
    kind = pa.schema([("image_id", pa.string()), *((c, pa.int64()) for c in ("component", "label", "y0", "x0", "y1", "x1"))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, row, strict=True)) for row in squares[i : i + 3]], kind) for i in range(0, 16, 3)]
    got = [r for b in vector._followed(iter(batches)) for r in b.to_pylist()]
    assert [(r["component"], r["hole"], len(r["points"])) for r in got] == [(c, False, 5) for c in range(4)]


def test_small_regions_are_contracted_many_in_a_call(spark, monkeypatch):
    """Two images with the same specks: groups that don't touch share a call, images don't."""
    from tessella.operators import contraction

    told = []
    monkeypatch.setattr(contraction, "stash", lambda df, cells=False: told.append(df._jdf.queryExecution().optimizedPlan().toString()) or durable.stash(df, cells))
    specks = {(y, x): 5 for y in range(1, 11, 3) for x in range(1, 11, 3)}
    cells = spark.createDataFrame([(i, y, x, specks.get((y, x), 1 + (i == "b"))) for i in "ab" for y in range(12) for x in range(12)], "image_id string, y long, x long, label long")
    got = contraction.fill_small_regions(cells, "label", 3).collect()
    assert len(got) == 288 and {(r.image_id, r.label) for r in got} == {("a", 1), ("b", 2)}
    calls = [keys for plan in told for keys in re.findall(r"FlatMapGroupsInPandas \[(.*?)\]", plan) if "call#" in keys or "group#" in keys]
    assert calls and all("call#" in k and "image_id#" in k for k in calls)
