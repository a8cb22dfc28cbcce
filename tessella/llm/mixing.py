"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, free_names, stash, unit_hash

WEIGHTS, SHARE, CEILING = (5.0, 2.0, 1.0), 1.5, 2.0
FAN = 64  # items that one node of the reduction tree combines, on average


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, take the weights in turn and split share * all sizes. A target stops at
    ceiling * its source's size and the excess is dealt again by weight: the result is min(cap, level * weight) at the
    one level that spends everything, found from running sums over sources ordered by cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    s = sizes.withColumn("w", w).withColumn("cap", ceiling * F.col("source_size").cast("double"))
    full = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * share
    spent, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("own", (total - spent) / (F.sum("w").over(everything) - used))  # the level if those before are full
    level = F.max("own").over(everything)  # it rises while a source overflows at its own level, and falls from then on
    return s.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def _item(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _meet(seed: int):
    """One step of the reduction of a node's items: the carried item meets the next, one of the two becomes integral.

    Words move between them: up to the most that keeps both probabilities in [0, 1], either way, with the odds that keep
    each item's expectation; so their words in sum stay as they are.
    """
    def step(state: Column, y: Column) -> Column:
        x = state["carry"]
        u = unit_hash(x["h"], y["h"], F.lit(seed))
        up = F.least((1 - x["p"]) * x["mass"], y["p"] * y["mass"])
        down = F.least(x["p"] * x["mass"], (1 - y["p"]) * y["mass"])
        rise = u * (up + down) < down
        x_ends = F.when(rise, (1 - x["p"]) * x["mass"] <= y["p"] * y["mass"]).otherwise(x["p"] * x["mass"] <= (1 - y["p"]) * y["mass"])
        px = F.when(rise, x["p"] + up / x["mass"]).otherwise(x["p"] - down / x["mass"])
        py = F.when(rise, y["p"] - up / y["mass"]).otherwise(y["p"] + down / y["mass"])
        ended = F.when(x_ends, _item(h=x["h"], mass=x["mass"], p=rise.cast("double"))).otherwise(_item(h=y["h"], mass=y["mass"], p=(~rise).cast("double")))
        going = F.when(x_ends, _item(h=y["h"], mass=y["mass"], p=F.least(F.greatest(py, F.lit(0.0)), F.lit(1.0)))).otherwise(_item(h=x["h"], mass=x["mass"], p=F.least(F.greatest(px, F.lit(0.0)), F.lit(1.0))))
        return F.struct(F.concat(state["done"], F.array(ended)).alias("done"), going.alias("carry"))

    return step


def pivotal(items: DataFrame, seed: int = 7, fan: int = FAN) -> DataFrame:
    """(stratum, h, up int) from (stratum, h long, mass double > 0, p double in (0, 1)): p rounded, its sum of masses kept.

    A reduction tree: items are dealt by hash to nodes of `fan` on average, each node folds its items and hands its one
    fractional residual up; the last residual of a stratum is drawn by its own p. h must be distinct within a stratum.
    """
    kind = "array<struct<h:bigint,mass:double,p:double>>"
    level, done = items.select("stratum", "h", "mass", "p"), None
    depth = 0
    while True:
        per = level.groupBy("stratum").agg(F.count("*").alias("n"))
        most = per.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        nodes = per.select(F.col("stratum").alias("s_"), F.ceil(F.col("n") / fan).cast("long").alias("nodes"))
        # a deeper level draws other nodes: the hash is salted by the depth
        dealt = level.join(nodes, level["stratum"].eqNullSafe(nodes["s_"])).withColumn("node", F.pmod(F.xxhash64("h", F.lit(seed + 1 + depth)), F.col("nodes")))
        packed = dealt.groupBy("stratum", "node").agg(F.array_sort(F.collect_list(F.struct("h", "mass", "p"))).alias("x"))
        folded = packed.select("stratum", F.aggregate(
            F.slice("x", 2, F.size("x")), F.struct(F.array().cast(kind).alias("done"), F.element_at("x", 1).alias("carry")), _meet(seed + depth),
        ).alias("r"))
        folded = stash(folded.select("stratum", F.explode(F.concat("r.done", F.array("r.carry"))).alias("i")).select("stratum", "i.*"))
        ended = folded.where("p <= 0 or p >= 1")
        done = ended if done is None else done.unionByName(ended)
        level = folded.where("p > 0 and p < 1")
        depth += 1
    last = level.withColumn("p", (unit_hash("h", F.lit(seed - 1)) < F.col("p")).cast("double"))
    done = last if done is None else done.unionByName(last)
    return done.select("stratum", "h", F.col("p").cast("int").alias("up"))


def _keys(doc_id: Column, text: Column, source: Column) -> tuple[Column, Column]:
    """Two independent hashes of all that tells rows apart here; a null differs from any value."""
    told = [c for x in (doc_id.cast("string"), source.cast("string"), text) for c in (x.isNull(), x)]
    return F.xxhash64(*told), F.xxhash64(F.lit(1), *reversed(told))


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Rows with their size and keys h and g."""
    h, g = _keys(F.col(doc_id), F.col(text), F.col(source))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), h.alias("h"), g.alias("g"))


def mix(docs: DataFrame, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, h, g): how many words, and whole copies, the mix takes of each row.

    Every row of a source is worth f = target / source_size copies (2 at most): floor(f) of them for certain, the rest by
    pivotal rounding over word masses, so a source's taken words differ from its target by less than one row's size.
    Rows alike in all of doc_id, source and text are one item of that many rows, whose copies are dealt evenly. Rows
    without words (null, empty or blank texts) are drawn one by one and take 0 words; a source without words has target
    0 and its rows are kept once. Nothing depends on partitions or row order, so reruns agree.
    """
    rows = stash(_keyed(docs, doc_id, text, source))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, ceiling)
    plan = stash(plan)
    few = plan.count() <= 50_000  # else the join is left to Spark, which splits a hot source
    p = plan.withColumnRenamed("source", "s_")
    items = rows.groupBy("source", "doc_id", "size", "h", "g").agg(F.count("*").alias("rows"))
    items = items.join(F.broadcast(p) if few else p, items["source"].eqNullSafe(p["s_"])).drop("s_")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    items = items.withColumn("whole", f * F.col("rows")).withColumn("base", F.floor(F.col("whole") + 1e-9).cast("long"))
    items = stash(items.withColumn("p", F.greatest(F.col("whole") - F.col("base"), F.lit(0.0))))
    live = items.where("size > 0 and p > 0").select(F.col("source").alias("stratum"), "h", F.col("size").cast("double").alias("mass"), "p")
    up = pivotal(live, seed).withColumnsRenamed({"h": "h_", "stratum": "s_"})
    out = items.join(up, (items["h"] == up["h_"]) & items["source"].eqNullSafe(up["s_"]), "left")
    lone = F.when(F.col("size") == 0, (unit_hash("h", F.lit(seed)) < F.col("p")).cast("int")).otherwise(F.lit(0))
    out = out.withColumn("all_copies", F.col("base") + F.coalesce("up", lone))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.floor(F.col("all_copies") / F.col("rows")) + (F.col("i") <= F.col("all_copies") % F.col("rows")).cast("long")
    out = out.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies", "h", "g")


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with each row as often as mix() copies it, all columns kept. Rows alike in doc_id, source and text share their copies evenly.

    Rows of a source without words stay once; an empty table stays empty.
    """
    took = mix(docs, seed).groupBy("h", "g").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    h, g, h2, g2, copies, rows, i, r, c = free_names(docs, "h", "g", "h2", "g2", "copies", "rows", "i", "r", "c")
    plain = [F.col(f"`{x}`") for x in docs.columns]
    own = _keys(F.col("doc_id"), F.col("text"), F.col("source"))
    took = took.select(*(F.col(x).alias(y) for x, y in (("h", h2), ("g", g2), ("copies", copies), ("rows", rows))))
    keyed = docs.withColumns({h: own[0], g: own[1]})
    joined = keyed.join(took, (F.col(h) == F.col(h2)) & (F.col(g) == F.col(g2)))
    upto = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    lone = joined.where((F.col(rows) == 1) & (F.col(copies) > 0)).withColumn(i, upto(copies)).select(*plain)
    many = joined.where(F.col(rows) > 1).withColumn(r, F.row_number().over(Window.partitionBy(h, g).orderBy(h)))
    many = many.withColumn(c, F.floor(F.col(copies) / F.col(rows)) + (F.col(r) <= F.col(copies) % F.col(rows)).cast("long"))
    return lone.unionByName(many.where(F.col(c) > 0).withColumn(i, upto(c)).select(*plain))
