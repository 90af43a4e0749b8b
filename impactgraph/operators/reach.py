"""Bounded reverse reachability for many targets at once, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize


def reach(edges: DataFrame, targets: DataFrame, max_depth: int = 10, stops: DataFrame | None = None) -> DataFrame:
    """(target, node, depth): what each target(node) reaches along edges(src, dst), with its least depth.

    Nodes among stops(node) are reached but not left, unless they are the target. A level joins the
    frontier to the edges and drops what was seen before; it is written once, so that a lost
    executor costs one level and the plan stays short.
    """
    links = materialize(edges.select("src", "dst").distinct(), "reach-links")
    frontier = materialize(targets.select(F.col("node").alias("target"), "node", F.lit(0).alias("depth")).distinct(), "frontier")
    levels = [frontier]
    for depth in range(1, max_depth + 1):
        seen = levels[0]
        for x in levels[1:]:
            seen = seen.unionByName(x)
        going = frontier
        if stops is not None and depth > 1:
            going = going.join(stops.select("node").distinct(), "node", "left_anti")
        step = going.join(links, going["node"] == links["src"]).select("target", F.col("dst").alias("node")).distinct()
        step = step.join(seen.select("target", "node"), ["target", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = materialize(step, "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def chase(links: DataFrame) -> DataFrame:
    """(key, root) for links(key, next), one a key: the end of each key's chain, by pointer doubling.

    A key on a cycle is its own root; one that leads into a cycle ends where it enters. A round in
    which no chain reaches its end shows that only cycles are left.
    """
    now, before = links.select("key", F.col("next").alias("root")), None
    while not now.join(links.select(F.col("key").alias("root")), "root", "left_semi").isEmpty():
        up = now.select(F.col("key").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(up, "root", "left").select("key", F.coalesce("further", "root").alias("root"), F.col("further").isNull().alias("ended")), "chase")
        left = now.where("not ended").count()
        if left == before:
            break
        before = left
    else:
        return now.select("key", "root")
    stuck = materialize(links.join(now.where("not ended").select("key"), "key", "left_semi").select("key", "next"), "stuck")
    jump, steps = stuck, 1
    while steps < before:
        up = jump.select(F.col("key").alias("next"), F.col("next").alias("further"))
        jump, steps = materialize(jump.join(up, "next").select("key", F.col("further").alias("next")), "jump"), 2 * steps
    ring = materialize(jump.select(F.col("next").alias("key")).distinct(), "ring")
    out = now.where("ended").select("key", "root").unionByName(ring.select("key", F.col("key").alias("root")))
    tails = stuck.join(ring, "key", "left_anti")
    return out if tails.isEmpty() else out.unionByName(chase(tails))
