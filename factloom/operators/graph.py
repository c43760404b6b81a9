"""Walks, chains, components and neighbourhoods over typed, weighted, temporal edges.

Loops run once per level or doubling, never per node; each cuts its lineage with checkpoint()."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.score import neutral
from factloom.functions.temporal import edge_active
from factloom.session import cut


def active(edges: DataFrame, t: Column, types: Iterable[str] | None = None, min_weight: float = 0.0) -> DataFrame:
    """Edges with both ends, active at t, of the types, of min_weight or more (0 or less: of any weight)."""
    e = edges.where(edge_active(t) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    if types:
        e = e.where(F.col("edge_type").isin(*types))
    return e.where(F.col("weight") >= min_weight) if min_weight > 0 else e


def edges_from(edges: DataFrame, nodes: DataFrame, t: Column, types: Iterable[str] | None = None) -> DataFrame:
    return active(edges, t, types).join(nodes.select("ns", F.col("id").alias("src")).distinct(), ["ns", "src"], "left_semi")


def edges_to(edges: DataFrame, nodes: DataFrame, t: Column, types: Iterable[str] | None = None) -> DataFrame:
    return active(edges, t, types).join(nodes.select("ns", F.col("id").alias("dst")).distinct(), ["ns", "dst"], "left_semi")


def walk(seeds: DataFrame, edges: DataFrame, max_levels: int) -> DataFrame:
    """(ns, id, depth): nodes within max_levels - 1 hops of a seed (seeds are level 1, depth 0), each at its least depth.

    seeds: ns, id. edges: the ones to follow, from src to dst. Cycles, repeated edges and seeds do no harm."""
    step = edges.select("ns", F.col("src").alias("id"), "dst").distinct()
    fronts = [cut(seeds.select("ns", "id").distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, max_levels):
        out = fronts[-1].join(step, ["ns", "id"]).select("ns", F.col("dst").alias("id")).distinct()
        new = cut(out.join(reduce(DataFrame.unionByName, fronts), ["ns", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        fronts.append(new)
    return reduce(DataFrame.unionByName, fronts)


def walk_paths(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(ns, seed, id, depth, path): per seed the first path to each node, by fewest hops, then heavier edge, then edge id."""
    step = edges.select("ns", F.col("src").alias("id"), "dst", F.coalesce("weight", F.lit(0.0)).alias("w"), F.col("id").alias("edge"))
    fronts = [cut(seeds.select("ns", F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0)).withColumn("path", F.array("id")))]
    for depth in range(1, max_hops + 1):
        seen = reduce(DataFrame.unionByName, fronts).select("ns", "seed", F.col("id").alias("dst"))
        out = fronts[-1].join(step, ["ns", "id"]).join(seen, ["ns", "seed", "dst"], "left_anti")
        best = F.min_by(F.struct("id", "path"), F.struct(-F.col("w"), "edge", "path"))
        out = out.groupBy("ns", "seed", "dst").agg(best.alias("p"))
        new = cut(out.select("ns", "seed", F.col("dst").alias("id"), F.lit(depth).alias("depth"), F.concat("p.path", F.array("dst")).alias("path")))
        if new.isEmpty():
            break
        fronts.append(new)
    return reduce(DataFrame.unionByName, fronts)


def subgraph(seeds: DataFrame, edges: DataFrame, max_levels: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a walk, and the edges with both ends among them."""
    n = walk(seeds, edges, max_levels)
    e = edges.join(n.select("ns", F.col("id").alias("src")), ["ns", "src"], "left_semi").join(n.select("ns", F.col("id").alias("dst")), ["ns", "dst"], "left_semi")
    return n, e


def best_parents(edges: DataFrame, edge_type: str, incoming: bool = True) -> DataFrame:
    """(ns, id, parent, weight): of each node the heaviest edge of the type, ties by parent: a function on nodes."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    e = edges.where((F.col("edge_type") == edge_type) & (F.col("weight") > 0) & (F.col("src") != F.col("dst")))
    n = F.row_number().over(Window.partitionBy("ns", here).orderBy(F.desc("weight"), there, "id"))
    return e.withColumn("_n", n).where("_n = 1").select("ns", F.col(here).alias("id"), F.col(there).alias("parent"), "weight")


def chains(nodes: DataFrame, edges: DataFrame, edge_type: str = "supports", max_steps: int = 20, incoming: bool = True) -> DataFrame:
    """(ns, id, steps, compound, path) of every node: the chain along its best parents, up to a node that is on it already.

    compound: the node's confidence times weight and confidence of each step (unknown confidence 0.5). Chains grow by doubling: each
    round appends the chain of its last node, so max_steps steps take log2(max_steps) joins."""
    up = best_parents(edges, edge_type, incoming)
    conf = nodes.select("ns", "id", neutral(F.col("confidence")).alias("c"))
    step = up.join(conf.select("ns", F.col("id").alias("parent"), "c"), ["ns", "parent"])
    ahead = cut(step.select("ns", "id", F.array("parent").alias("to"), F.array(F.col("weight") * F.col("c")).alias("by")))
    reach = 1
    while reach < max_steps:
        more = ahead.select("ns", F.col("id").alias("last"), F.col("to").alias("to2"), F.col("by").alias("by2"))
        ends = ahead.withColumn("last", F.element_at("to", -1)).join(more, ["ns", "last"], "left")
        # only a full chain goes on; a shorter one has reached its root
        join = lambda x: F.when(F.col(f"{x}2").isNotNull(), F.concat(x, f"{x}2")).otherwise(F.col(x)).alias(x)
        ahead = cut(ends.select("ns", "id", join("to"), join("by")))
        reach *= 2
    none = lambda t: F.array().cast(f"array<{t}>")
    all_ = conf.join(ahead, ["ns", "id"], "left").withColumn("path", F.slice(F.concat(F.array("id"), F.coalesce("to", none("string"))), 1, max_steps + 1))
    again = F.array_position(F.transform("path", lambda x, i: F.array_position("path", x) <= i), F.lit(True))
    steps = F.when(again > 0, again - 2).otherwise(F.size("path") - 1).cast("int")
    all_ = all_.withColumn("steps", steps)
    compound = F.aggregate(F.slice(F.coalesce("by", none("double")), F.lit(1), F.col("steps")), F.col("c"), lambda a, x: a * x)
    return all_.select("ns", "id", "steps", compound.alias("compound"), F.slice("path", F.lit(1), F.col("steps") + 1).alias("path"))


def provenance_depth(nodes: DataFrame, edges: DataFrame, max_steps: int = 10) -> DataFrame:
    """(ns, id, depth): length of the chain of incoming derived_from edges."""
    return chains(nodes, edges.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-9))), "derived_from", max_steps).select("ns", "id", F.col("steps").alias("depth"))


def _stars(e: DataFrame) -> bool:
    """Whether edges (a, b) form stars around a."""
    ends = e.select("ns", F.col("a").alias("n"), F.lit(0).alias("leaf")).unionByName(e.select("ns", F.col("b").alias("n"), F.lit(1).alias("leaf")))
    n = ends.groupBy("ns", "n").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("centre"))
    return n.where("leaf > 1 or (leaf = 1 and centre = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(ns, id, component): connected components, named by their least id: hooking with pointer jumping.

    Rounds grow with the logarithm of the longest chain. Alternating large and small star: every node links to
    the least neighbour it knows, until all are stars: no node is both a centre and a leaf, or a leaf of two. Nodes of a hot centre stay
    linked by single edges."""
    e = edges.where("src <> dst").select("ns", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = cut(e)
    while not _stars(e):
        both = e.select("ns", "a", "b").unionByName(e.select("ns", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("ns", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, ["ns", "a"]).select("ns", F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: each node's smaller neighbours, and itself, link to the least of them
        up = large.groupBy("ns", "b").agg(F.min("a").alias("m"))
        small = large.join(up, ["ns", "b"])
        small = small.select("ns", F.col("m").alias("x"), F.col("b").alias("y")).unionByName(small.select("ns", F.col("m").alias("x"), F.col("a").alias("y")))
        e = cut(small.where("x <> y").select("ns", F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return e.select("ns", F.col("b").alias("id"), F.col("a").alias("component")).unionByName(e.select("ns", F.col("a").alias("id"), F.col("a").alias("component"))).distinct()


def conflict_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ns, component, members, low, high, gap): components of contradicts edges among the nodes, widest gap of confidence first."""
    e = edges.where("edge_type = 'contradicts'")
    key = nodes.select("ns", "id").distinct()
    e = e.join(key.withColumnRenamed("id", "src"), ["ns", "src"], "left_semi").join(key.withColumnRenamed("id", "dst"), ["ns", "dst"], "left_semi")
    c = components(e).join(nodes.select("ns", "id", neutral(F.col("confidence")).alias("c")), ["ns", "id"])
    g = c.groupBy("ns", "component").agg(F.count("*").alias("members"), F.min("c").alias("low"), F.max("c").alias("high")).where("members >= 2")
    return g.withColumn("gap", F.round(F.col("high") - F.col("low"), 6))


def cascade(seeds: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(ns, id, depth): what a retraction of the seeds reaches along outgoing derived_from edges, the seeds at depth 0."""
    return walk(seeds, edges.where("edge_type = 'derived_from'"), max_depth + 1)


def context(edges: DataFrame) -> DataFrame:
    """(ns, id, relation, other, weight): all neighbours in both directions, with the relation's reading."""
    out = edges.select("ns", F.col("src").alias("id"), F.concat(F.lit("out:"), "edge_type").alias("relation"), F.col("dst").alias("other"), "weight")
    into = edges.select("ns", F.col("dst").alias("id"), F.concat(F.lit("in:"), "edge_type").alias("relation"), F.col("src").alias("other"), "weight")
    return out.unionByName(into)


def topological_order(depends_on: dict[str, Iterable[str]]) -> list[str]:
    """Order of a write batch in which everything follows what it depends on; unknown names are ignored, cycles are an error."""
    left = {k: {x for x in v if x in depends_on and x != k} for k, v in depends_on.items()}
    if any(k in set(v) for k, v in depends_on.items()):
        raise ValueError("an item depends on itself")
    order: list[str] = []
    while left:
        ready = [k for k, v in left.items() if not v]
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        order += ready
        for k in ready:
            del left[k]
        for v in left.values():
            v.difference_update(ready)
    return order
