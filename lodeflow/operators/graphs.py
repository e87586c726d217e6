"""Iterative graph operators on edge tables (src, dst): degrees, ranks, closures, cycles and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lodeflow.session import checkpoint


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, with zeros for isolated nodes; repeated edges count once."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("node").distinct().join(sums, "node", "left").na.fill(0, ["out_degree", "in_degree"])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    touched = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.select("node").distinct().join(touched, "node", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85, tolerance: float | None = None, weights: DataFrame | None = None) -> DataFrame:
    """node, score: power iteration with the mass of dangling nodes spread evenly.

    Edges are written once, with the out-degree of their source; a round is one job, in which the dangling mass is one row. No nodes
    give no rows. With a tolerance the iteration ends once the summed change is below
    tolerance times the number of nodes. ``weights`` (node, weight) personalises: jumps and dangling mass go to nodes by their weight.
    """
    plain = edges.select("src", "dst").where("src != dst").distinct()
    out = plain.groupBy("src").agg(F.count("*").alias("n_out"))
    e = checkpoint(plain.join(out, "src").select("src", "dst", "n_out"))
    vertices = nodes.select("node").distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("sends")), "node", "left")
    if weights is None:
        vertices = checkpoint(vertices)
        share = F.lit(1.0 / max(1, vertices.count()))
        vertices = vertices.withColumn("jump", share)
    else:
        total = weights.agg(F.sum("weight").alias("_w"))
        named = weights.groupBy("node").agg(F.sum("weight").alias("weight")).crossJoin(F.broadcast(total))  # one row
        vertices = checkpoint(vertices.join(named.select("node", (F.col("weight") / F.col("_w")).alias("jump")), "node", "left").na.fill(0.0, ["jump"]))
    ranks = vertices.withColumn("score", F.col("jump"))
    count = vertices.count() if tolerance is not None else 0
    for _ in range(iterations):
        lost = ranks.where("sends is null").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        got = e.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("n_out")).alias("got"))
        moved = ranks.join(got, "node", "left").crossJoin(F.broadcast(lost))  # one row
        new = F.col("jump") * (1.0 - damping + damping * F.col("lost")) + damping * F.coalesce("got", F.lit(0.0))
        before = ranks
        ranks = checkpoint(moved.select("node", "sends", "jump", new.alias("score")))
        if tolerance is not None:
            change = ranks.join(before.select("node", F.col("score").alias("old")), "node").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            if (change or 0.0) < tolerance * count:
                break
    return ranks.select("node", "score")


def min_max(df: DataFrame, column: str) -> DataFrame:
    """The column scaled to [0, 1]; 1 everywhere if all values are equal."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, scaled).drop("_lo", "_hi")  # one row


def closure(edges: DataFrame, depth: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst) with a path from a start (``node``) to dst, without the start itself but on a cycle.

    Semi-naive rounds from the stated starts: only pairs that are new go on, and only they are written. Without
    starts every source is one, which is the whole relation and only fit for graphs whose pairs can be stored.
    """
    e = checkpoint(edges.select("src", "dst").distinct())
    front = e if starts is None else starts.select(F.col("node").alias("src")).distinct().join(e, "src").select("src", "dst")
    parts, step = [checkpoint(front)], 1
    while (depth is None or step < depth) and not parts[-1].isEmpty():
        reached = parts[-1].select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        known = reduce(DataFrame.unionByName, parts)
        parts.append(checkpoint(reached.join(known, ["src", "dst"], "left_anti")))
        step += 1
    return reduce(DataFrame.unionByName, parts)


def peeled(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an incoming or without an outgoing edge are taken away until none is left.

    No edge is left if and only if the graph has no cycle.
    """
    e = checkpoint(edges.select("src", "dst").distinct())
    n = e.count()
    while n:
        e = checkpoint(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, e.count()
        if n == before:
            break
    return e


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: what is left after peeling is split into strongly connected parts by colours.

    The greatest node that reaches a node is its colour; what reaches the node of its own colour within it is one strong part.
    Rounds write a row per node or edge; no pairs of nodes are formed.
    """
    found = []
    e = edges.select("src", "dst").distinct()
    loops = e.where("src = dst").select(F.col("src").alias("node"))
    e = peeled(e.where("src != dst"))
    while not e.isEmpty():
        colour = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node"))
        total = None
        while True:
            sent = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("got"))
            colour = checkpoint(colour.join(sent, "node", "left").select("node", F.greatest("colour", "got").alias("colour")))
            now = colour.agg(F.bit_xor(F.xxhash64("node", "colour"))).first()[0]
            if now == total:
                break
            total = now
        inside = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inside = checkpoint(inside.where("a = b").select("src", "dst"))
        part = front = checkpoint(colour.where("node = colour").select("node"))
        while not front.isEmpty():
            back = inside.join(front.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
            front = checkpoint(back.join(part, "node", "left_anti"))
            part = part.unionByName(front)
        # A strong part of one node is on no cycle: it has no edge within the part.
        ends = inside.join(part.withColumnRenamed("node", "src"), "src", "left_semi").join(part.withColumnRenamed("node", "dst"), "dst", "left_semi")
        found.append(checkpoint(ends.select(F.col("src").alias("node")).distinct()))
        e = peeled(e.join(part.withColumnRenamed("node", "src"), "src", "left_anti").join(part.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return reduce(DataFrame.unionByName, [loops, *found]).distinct()


def propagate(labelled: DataFrame, edges: DataFrame, transitive: bool = False) -> DataFrame:
    """Nodes that get a label because a node they point to has one: one hop, or until nothing changes."""
    known = labelled.select("node").distinct()
    if transitive:
        edges = checkpoint(edges.select("src", "dst").distinct())
    new, front = None, known
    while True:
        hop = edges.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(known, "node", "left_anti")
        if not transitive:
            return hop
        front = checkpoint(hop)
        new = front if new is None else new.unionByName(front)
        if front.isEmpty():
            return new
        known = known.unionByName(front)


def reachable(starts: DataFrame, edges: DataFrame, depth: int, blocked: DataFrame | None = None) -> DataFrame:
    """start, node, hops: what each start reaches in at most ``depth`` hops, by the shortest way.

    No path goes through a blocked node (a sanitizer), nor ends in one. Starts don't reach
    themselves by no hop; on a cycle they do.
    """
    e = edges.select("src", "dst").distinct()
    if blocked is not None:
        wall = blocked.select(F.col("node").alias("dst")).distinct()
        e = e.join(wall, "dst", "left_anti").select("src", "dst")
    e = checkpoint(e)
    front = starts.select(F.col("node").alias("start"), "node").distinct()
    known = None
    for hop in range(1, depth + 1):
        step = front.select("start", F.col("node").alias("src")).join(e, "src").select("start", F.col("dst").alias("node")).distinct()
        if known is not None:
            step = step.join(known, ["start", "node"], "left_anti")
        front = checkpoint(step.withColumn("hops", F.lit(hop)))
        known = front if known is None else known.unionByName(front)
        if front.isEmpty():
            break
    return known


def sanitized_paths(starts: DataFrame, ends: DataFrame, edges: DataFrame, sanitizers: DataFrame, depth: int) -> DataFrame:
    """start, node, is_sanitized for each reached end: true if every way passes a sanitizer."""
    targets = ends.select("node").distinct()
    any_way = reachable(starts, edges, depth).join(targets, "node", "left_semi").select("start", "node")
    clean_way = reachable(starts, edges, depth, sanitizers).select("start", "node", F.lit(True).alias("_open"))
    return any_way.join(clean_way, ["start", "node"], "left").select("start", "node", F.col("_open").isNull().alias("is_sanitized"))
