"""Bounded traversals: closures, call depths, shortest and simple paths.

Frontiers are DataFrames; every level is one join with the edges and one anti join with what has
been seen, and is written before the next, so plans stay small and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..graph import Graph


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """(seed, node, depth): nodes that edges (src, dst) lead to from each of ``seeds`` (seed), with the
    least number of steps, up to ``depth`` of them (None: all). The seed itself has depth 0."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = frontier = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("depth")).distinct())
    level = 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(level).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def callers(graph: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """The transitive callers of ``seeds`` (seed), without the seeds themselves."""
    return reach(graph.kind("CALLS").select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth).where("depth > 0")


def callees(graph: Graph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """What ``seeds`` (seed) call, transitively."""
    return reach(graph.kind("CALLS"), seeds, depth).where("depth > 0")


def call_depths(graph: Graph) -> DataFrame:
    """(uid, depth): steps from the nearest symbol that calls and is never called; 0 where none leads."""
    calls = graph.inner("CALLS")
    roots = calls.select("src").distinct().join(calls.select(F.col("dst").alias("src")), "src", "left_anti")
    edges = cut(calls.select("src", "dst").distinct())
    seen = frontier = cut(roots.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("depth")))
    level = 0
    while not frontier.isEmpty():
        level += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(level).cast("long")))
        seen = seen.unionByName(frontier)
    return graph.symbols.select("uid").join(seen.withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("depth", F.lit(0)).alias("depth"))


def both_ways(graph: Graph) -> DataFrame:
    """(src, dst, step) of all edges between symbols, each in both directions."""
    own = graph.symbols.select(F.col("uid").alias("own_uid"))
    edges = graph.edges.join(own, F.col("source_uid") == F.col("own_uid"), "left_semi").join(own, F.col("target_uid") == F.col("own_uid"), "left_semi")
    step = F.struct(F.col("source_uid").alias("source"), F.col("target_uid").alias("target"), F.col("kind").alias("relationship")).alias("step")
    return edges.select(F.col("source_uid").alias("src"), F.col("target_uid").alias("dst"), step).union(edges.select("target_uid", "source_uid", step))


STEPS = "array<struct<source:string,target:string,relationship:string>>"


def _start(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.array("seed").alias("nodes"), F.expr(f"cast(array() as {STEPS})").alias("edges"))


def shortest_paths(steps: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """``pairs`` (a, b) with nodes and edges of a shortest path of at most ``depth`` steps, the one with
    the smallest nodes among several; null where there is none."""
    steps = cut(steps)
    seen = frontier = cut(_start(pairs))
    for _ in range(min(depth, 10)):
        ways = frontier.join(steps, F.col("node") == F.col("src")).join(seen.select("seed", F.col("node").alias("dst")), ["seed", "dst"], "left_anti")
        ways = ways.select("seed", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("step")).alias("edges"))
        frontier = cut(ways.groupBy("seed", "node").agg(F.min(F.struct("nodes", "edges")).alias("way")).select("seed", "node", "way.*"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return pairs.join(seen.select(F.col("seed").alias("a"), F.col("node").alias("b"), "nodes", "edges"), ["a", "b"], "left")


def all_paths(steps: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """(a, b, nodes, edges): every simple path of at most ``depth`` steps between the ends of each of
    ``pairs``; parallel edges give a path each. A path ends where it first meets its target.

    Half of the steps are taken from each ``a`` and half back from each ``b``, once and not for every pair;
    halves that meet and share no other node are a path, if their ends are a pair."""
    steps, pairs = cut(steps), cut(pairs.distinct())
    half = lambda end: cut(pairs.select(end).distinct().select(end, F.col(end).alias("node"), F.array(end).alias("nodes"), F.expr(f"cast(array() as {STEPS})").alias("edges")))
    fore, back = half("a"), half("b")
    out = fore.join(pairs.where("a = b"), "a").select("a", "b", "nodes", "edges")
    for length in range(1, min(depth, 10) + 1):
        if length % 2:
            ways = fore.join(steps, F.col("node") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")))
            fore = last = cut(ways.select("a", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("step")).alias("edges")))
        else:
            ways = back.join(steps, F.col("node") == F.col("dst")).where(~F.array_contains("nodes", F.col("src")))
            back = last = cut(ways.select("b", F.col("src").alias("node"), F.concat(F.array("src"), "nodes").alias("nodes"), F.concat(F.array("step"), "edges").alias("edges")))
        if last.isEmpty():
            break
        rest = back.select("b", "node", F.slice("nodes", 2, depth).alias("after"), F.col("edges").alias("late"))
        met = fore.join(rest, "node").where(~F.arrays_overlap("nodes", "after")).join(pairs, ["a", "b"], "left_semi")
        out = out.unionByName(met.select("a", "b", F.concat("nodes", "after").alias("nodes"), F.concat("edges", "late").alias("edges")))
    return out


def any_path(steps: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """One simple path for each of ``pairs`` that has any: the shortest, then smallest."""
    return shortest_paths(steps, pairs, depth).where("nodes IS NOT NULL")


def find_path(graph: Graph, a: str, b: str, depth: int = 10) -> DataFrame:
    """The steps (step, uid, relationship) of a shortest undirected path over all kinds; non-symbols may
    lie on it and are left out of the steps. A step against an edge's direction has "_REV" after its kind."""
    e = graph.edges
    step = F.struct(F.col("source_uid").alias("source"), F.col("target_uid").alias("target"), F.col("kind").alias("relationship")).alias("step")
    steps = e.select(F.col("source_uid").alias("src"), F.col("target_uid").alias("dst"), step).union(e.select("target_uid", "source_uid", step))
    pairs = graph.symbols.sparkSession.createDataFrame([(a, b)], "a string, b string")
    way = shortest_paths(steps, pairs, depth).where("nodes IS NOT NULL").select(F.posexplode("nodes").alias("step", "uid"), "edges", "nodes")
    edge = F.get(F.col("edges"), F.col("step") - 1)
    label = F.when(F.col("step") == 0, F.lit(None)).otherwise(F.concat(edge["relationship"], F.when(edge["target"] == F.col("uid"), "").otherwise("_REV")))
    return way.select("step", "uid", label.alias("relationship")).join(graph.symbols.select("uid"), "uid", "left_semi")
