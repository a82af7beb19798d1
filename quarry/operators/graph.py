"""Directed graphs as edge tables: every step is a join over all edges, nothing is walked on the driver."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import discard, materialize


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge (src, dst, conf) per pair: the most confident."""
    return edges.groupBy("src", "dst").agg(F.max("conf").alias("conf"))


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) connected by a path of one edge or more; works on cyclic graphs.

    Paths double in length each round, so the rounds are logarithmic in the longest path. Null ends
    connect nothing.
    """
    known = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "reach")
    size = known.count()
    while True:
        step = known.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        before, known = known, materialize(known.union(step).distinct(), "reach")
        discard(before)
        grown = known.count()
        if grown == size:
            return known
        size = grown


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) with level = length of the longest path that ends in the node; nodes on or behind a cycle have none.

    Each round takes all nodes without an open incoming edge off the graph.
    """
    left = materialize(nodes.select("id").distinct(), "nodes")
    open_edges = materialize(edges.select("src", "dst").distinct(), "edges")
    done: DataFrame | None = None
    for level in count():  # every round takes a node off, or ends
        free = materialize(left.join(open_edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"), "wave")
        if free.isEmpty():
            break
        wave = free.withColumn("level", F.lit(level))
        done = wave if done is None else done.unionByName(wave)
        before = left, open_edges
        left = materialize(left.join(free, "id", "left_anti"), "nodes")
        open_edges = materialize(open_edges.join(free.withColumnRenamed("id", "src"), "src", "left_anti"), "edges")
        discard(*before)
    return done if done is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) of an acyclic graph that no longer path replaces."""
    e = edges.select("src", "dst").distinct()
    longer = e.select("src", F.col("dst").alias("mid")).join(closure(e).select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
    return e.join(longer, ["src", "dst"], "left_anti")


def core(edges: DataFrame) -> DataFrame:
    """Edges left when edges from a node without predecessor or into one without successor are taken off again and again: empty iff acyclic."""
    e = materialize(edges, "core")
    size, now = -1, e.count()
    while now not in (0, size):
        inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        before, e = e, materialize(inner.select(*edges.columns), "core")
        discard(before)
        size, now = now, e.count()
    return e


def break_cycles(edges: DataFrame) -> DataFrame:
    """The edges (src, dst, conf) taken away to make the graph acyclic.

    Self-loops go first, then of every two opposite edges the less confident one. Then, round by
    round, each cyclic component loses its least confident edge. Of equal edges the smallest
    (src, dst) goes. An edge lies on a cycle iff its source is reached from its target; a component is
    named by the smallest node that is reached from a node and reaches it.
    """
    all_edges = best_edges(edges)
    back = all_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("conf").alias("_other"))
    weaker = F.struct("conf", "src", "dst") < F.struct("_other", "dst", "src")
    removed = materialize(all_edges.join(back, ["src", "dst"]).where(F.col("src").eqNullSafe(F.col("dst")) | weaker).select("src", "dst", "conf"), "opposite")
    left = all_edges.join(removed.select("src", "dst"), ["src", "dst"], "left_anti")
    while True:
        cyc = core(left)
        if cyc.isEmpty():
            return removed
        reach = closure(cyc)
        mutual = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
        name = mutual.groupBy("src").agg(F.min("dst").alias("component"))
        on_cycle = cyc.join(mutual.select("src", "dst").distinct(), ["src", "dst"]).join(name, "src")
        worst = on_cycle.groupBy("component").agg(F.min(F.struct("conf", "src", "dst")).alias("w")).select("w.src", "w.dst", "w.conf")
        worst = materialize(worst, "worst")
        removed = removed.unionByName(worst)
        left = materialize(left.join(worst.select("src", "dst"), ["src", "dst"], "left_anti"), "left")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, reliable): edges at each node, and those of confidence 0.8 or more."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "conf")
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.count_if(F.col("conf") >= 0.8).alias("reliable"))


def violations(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges (src, dst) whose source comes after its target in ``positions`` (id, pos)."""
    p = lambda c: positions.select(F.col("id").alias(c), F.col("pos").alias(f"{c}_pos"))
    return edges.join(p("src"), "src").join(p("dst"), "dst").where("src_pos > dst_pos").select("src", "dst", "src_pos", "dst_pos")
