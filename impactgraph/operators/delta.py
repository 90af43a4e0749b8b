"""Snapshots and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op) of snapshots(path, mtime): added, deleted or modified (any other mtime)."""
    both = old.select("path", F.col("mtime").alias("was")).join(new.select("path", F.col("mtime").alias("now")), "path", "full_outer")
    op = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return both.select("path", op.alias("op")).where("op is not null")


def reusable(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of new whose mtime is as in old: their parsed rows are taken over."""
    return new.join(old.select("path", F.col("mtime").alias("__was")), "path", "left").withColumn("reused", F.coalesce(F.col("__was") == F.col("mtime"), F.lit(False))).drop("__was")


def change_feed(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(entity, op, id, src, dst, relation) between two graphs."""
    none = lambda n: F.lit(None).cast("string").alias(n)

    def side(a: DataFrame, b: DataFrame, op: str, keys: list[str], entity: str) -> DataFrame:
        rows = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")
        cols = [F.col(c) if c in keys else none(c) for c in ("id", "src", "dst", "relation")]
        return rows.select(F.lit(entity).alias("entity"), F.lit(op).alias("op"), *cols)

    edge = ["src", "dst", "relation"]
    return (
        side(new_nodes, old_nodes, "added", ["id"], "node")
        .unionByName(side(old_nodes, new_nodes, "removed", ["id"], "node"))
        .unionByName(side(new_edges, old_edges, "added", edge, "edge"))
        .unionByName(side(old_edges, new_edges, "removed", edge, "edge"))
    )
