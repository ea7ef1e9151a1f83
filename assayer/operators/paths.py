"""Paths through a knowledge graph: which targets can be reached from which sources, and over how many edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import checkpointed

#: Edges of one node that one task reads; a node with more is dealt out over several.
HUB = 10_000


def spread_edges(edges: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (source, slot, target), and (source, slots) of the nodes that have more than ``hub``: their edges lie in so many slots."""
    known = edges.select("source", "target").filter("source is not null and target is not null").distinct()
    known = checkpointed(known)
    hubs = checkpointed(known.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub).select("source", F.ceil(F.col("n") / hub).cast("int").alias("slots")))
    slot = F.coalesce(F.pmod(F.xxhash64("target"), F.col("slots")), F.lit(0)).cast("int")
    return checkpointed(known.join(hubs, "source", "left").select("source", slot.alias("slot"), "target")), hubs


def step(frontier: DataFrame, edges: DataFrame, hubs: DataFrame, *carried: str) -> DataFrame:
    """Where one more edge leads from the nodes of ``frontier``, with its other columns; distinct. A row at a hub meets each of its slots, so no task reads all of them."""
    met = frontier.join(hubs.withColumnRenamed("source", "node"), "node", "left")
    met = met.select("node", *carried, F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot"))
    return met.join(edges.withColumnRenamed("source", "node"), ["node", "slot"]).select(*carried, F.col("target").alias("node")).distinct()


def distance_to_any(targets: DataFrame, edges: DataFrame, hops: int, hub: int = HUB) -> DataFrame:
    """(node, left): the fewest edges, at most ``hops``, from each node to any of ``targets`` (node). One row per node, whatever the number of targets."""
    back, hubs = spread_edges(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), hub)
    reached = checkpointed(targets.select("node").filter("node is not null").distinct().withColumn("left", F.lit(0)))
    frontier = reached
    for k in range(1, hops + 1):
        frontier = checkpointed(step(frontier.select("node"), back, hubs).join(reached, "node", "left_anti").withColumn("left", F.lit(k)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


#: Class pairs up to which their distances are sent to every task.
FEW = 10_000


def classes(known: DataFrame, node: str, other: str) -> DataFrame:
    """(node, name) of all nodes with edges: nodes that have the same nodes at the other end have one name, 128 bits of a hash of their
    number and of sums over hashes of them."""
    sums = known.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(other).cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), other)).alias("y"))
    return checkpointed(sums.select("node", F.unhex(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in "nxy")))).alias("name")))


def _classed(pairs: DataFrame, leaving: DataFrame, arriving: DataFrame) -> DataFrame:
    """All columns of pairs, with the classes origin of source and goal of target, null where no edge is."""
    out = pairs.join(leaving.select(F.col("node").alias("source"), F.col("name").alias("origin")), "source", "left")
    return out.join(arriving.select(F.col("node").alias("target"), F.col("name").alias("goal")), "target", "left")


def _between(pairs: DataFrame, edges: DataFrame, hops: int, hub: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(origin, goal, hops) of the pairs' classes, with the fewest edges, one at least, of a walk; and the classes.

    Sources from which edges lead to the same nodes are equally far from every other node, and so are targets to which edges come from the same nodes. So classes of
    sources walk, and arrive at the classes of targets by their last edge: a node with a million alike neighbours costs as much as with one.

    All classes walk at once: each round joins what was reached last with the edges and drops what the class has met before, so cycles and self-loops end. A
    node goes on only if some target is near enough for the edges that are left, and a class only until all of its targets are found. Each round is
    checkpointed: its work is that of its own rows, and lost executors cost no more than one.
    """
    known, hubs = spread_edges(edges, hub)
    leaving, arriving = classes(known, "source", "target"), classes(known, "target", "source")
    rest = _classed(pairs.select("source", "target").filter("source <> target"), leaving, arriving).filter("origin is not null and goal is not null")
    rest = checkpointed(rest.select("origin", "goal").distinct())
    plain = known.select("source", "target")
    direct = checkpointed(_classed(plain, leaving, arriving).select("origin", "goal").distinct().join(rest, ["origin", "goal"]).withColumn("hops", F.lit(1))) if hops else rest.withColumn("hops", F.lit(0)).limit(0)
    found, rest = direct, checkpointed(rest.join(direct, ["origin", "goal"], "left_anti"))
    if hops < 2 or rest.isEmpty():
        return found, leaving, arriving
    goals = rest.select(F.col("goal").alias("name")).distinct()
    last = plain.join(arriving.join(goals, "name", "left_semi").withColumnRenamed("node", "target"), "target").select("source", F.col("name").alias("target"))
    last, last_hubs = spread_edges(last, hub)
    near = checkpointed(distance_to_any(last.select(F.col("source").alias("node")), edges, hops - 2, hub))
    origins = lambda: rest.select("origin").distinct()
    first = plain.join(leaving.withColumnRenamed("node", "source"), "source").select(F.col("name").alias("origin"), F.col("target").alias("node")).distinct()
    frontier = checkpointed(first.join(near.select("node"), "node", "left_semi").join(origins(), "origin", "left_semi").select("origin", "node"))
    seen = frontier
    for k in range(2, hops + 1):
        if frontier.isEmpty():
            break
        hit = step(frontier, last, last_hubs, "origin").select("origin", F.col("node").alias("goal"))
        hit = checkpointed(hit.join(rest, ["origin", "goal"]).withColumn("hops", F.lit(k)))
        found = found.unionByName(hit)
        rest = checkpointed(rest.join(hit, ["origin", "goal"], "left_anti"))
        if k == hops:
            break
        on = step(frontier.join(origins(), "origin", "left_semi"), known, hubs, "origin").join(near.filter(F.col("left") <= hops - 1 - k).select("node"), "node", "left_semi")
        frontier = checkpointed(on.join(seen, ["origin", "node"], "left_anti").select("origin", "node"))
        seen = seen.unionByName(frontier)
    found = checkpointed(found)
    return F.broadcast(found) if found.count() <= FEW else found, leaving, arriving


def _measured(pairs: DataFrame, edges: DataFrame, hops: int, hub: int) -> DataFrame:
    """All columns of pairs, and hops, null where no path is short enough. A node is its own target over no edge, in the graph or not."""
    near, leaving, arriving = _between(pairs, edges, hops, hub)
    far = _classed(pairs, leaving, arriving).join(near, ["origin", "goal"], "left")
    return far.select(*pairs.columns, F.when(F.col("source") == F.col("target"), F.lit(0)).otherwise(F.col("hops")).alias("hops"))


def distances(pairs: DataFrame, edges: DataFrame, hops: int, hub: int = HUB) -> DataFrame:
    """(source, target, hops) of the distinct pairs (source, target) that a directed path of at most ``hops`` edges joins, with the fewest edges of one."""
    return _measured(pairs.select("source", "target").distinct(), edges, hops, hub).filter("hops is not null")


def path_exists(paths: DataFrame, edges: DataFrame, hops: int = 3, hub: int = HUB) -> DataFrame:
    """(sample_id, path_exists, hops) of every row of paths (sample_id, source, target): whether the graph leads from source to target over at most ``hops``
    edges, and over how few. A row without source or target has none; repeated rows stay."""
    near = _measured(paths.select("sample_id", "source", "target"), edges, hops, hub)
    return near.select("sample_id", F.col("hops").isNotNull().alias("path_exists"), "hops")
