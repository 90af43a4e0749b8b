"""Building, flipping, collapsing and pruning property graphs held as nodes and edges tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import prefixes
from ..shared import materialize


def hierarchy(modules: DataFrame, module: str = "module") -> DataFrame:
    """(src, dst): repo to the first package, package to package, last package to module, each once."""
    parts = modules.where(F.length(module) > 0).select(F.split(module, "[.]").alias("parts")).distinct()
    steps = parts.select(F.size("parts").alias("n"), F.posexplode(prefixes(F.col("parts"))).alias("i", "name"), "parts")
    named = F.when(F.col("i") == F.col("n") - 1, F.concat(F.lit("module:"), "name")).otherwise(F.concat(F.lit("pkg:"), "name"))
    above = F.when(F.col("i") == 0, F.lit("repo")).otherwise(F.concat(F.lit("pkg:"), F.array_join(F.slice("parts", F.lit(1), F.col("i")), ".")))
    return steps.select(above.alias("src"), named.alias("dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def is_call(relation: str = "relation") -> Column:
    return F.coalesce(F.col(relation) == "CALLS", F.lit(True))


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """Call edges, one for each (src, dst): least certainty (1 where unknown) and whether any is by inheritance.

    Edges without a relation are calls only where no edge of the pair has one.
    """
    called = F.bool_or(F.coalesce(F.col("relation") == "CALLS", F.lit(False)))
    typed = F.bool_or(F.col("relation").isNotNull())
    sure = F.coalesce("certainty", F.lit(1.0))
    of_call = F.min(F.when(F.col("relation") == "CALLS", sure))
    pair = edges.groupBy("src", "dst").agg(called.alias("called"), typed.alias("typed"), of_call.alias("call"), F.min(sure).alias("any"), F.bool_or(F.coalesce("inheritance", F.lit(False))).alias("inheritance"))
    kept = pair.where("called or not typed")
    return kept.select("src", "dst", F.when(F.col("called"), F.col("call")).otherwise(F.col("any")).alias("certainty"), "inheritance")


def fan_out(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(id, fan_out): call edges that leave each node, parallel ones counted, zero included."""
    out = edges.where(is_call()).groupBy(F.col("src").alias(node)).agg(F.count("*").alias("fan_out"))
    return nodes.select(node).distinct().join(out, node, "left").withColumn("fan_out", F.coalesce("fan_out", F.lit(0)))


def dynamic_calls(sites: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for dynamic call tags 'dynamic:<type>:<line>:<column>' of sites(caller, module, filepath, tag).

    A well-formed tag calls every member(module, id) of its module at 0.30, a malformed one at 0.10.
    """
    parts = F.split("tag", ":")
    line, col = F.try_element_at(parts, F.lit(3)).try_cast("int"), F.try_element_at(parts, F.lit(4)).try_cast("int")
    good = (F.size(parts) == 4) & line.isNotNull() & col.isNotNull()
    node = F.when(good, F.concat_ws(":", "caller", F.lit("dyn"), F.element_at(parts, 2), line, col)).otherwise(F.concat("caller", F.lit(":dyn:fallback")))
    told = sites.where(F.col("tag").startswith("dynamic:")).select("caller", "module", "filepath", node.alias("id"), F.when(good, F.element_at(parts, 2)).otherwise("unknown").alias("type"), line.alias("line_no"), col.alias("col_offset"), F.when(good, 0.30).otherwise(0.10).alias("certainty")).dropDuplicates(["id"])
    nodes = told.select("id", F.lit("dynamic_call").alias("kind"), "type", "filepath", "line_no", "col_offset")
    up = told.select(F.col("caller").alias("src"), F.col("id").alias("dst"), "certainty")
    down = told.join(members.select("module", F.col("id").alias("dst")), "module").select(F.col("id").alias("src"), "dst", "certainty")
    return nodes, up.unionByName(down)


def incident_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges with exactly one end among removed(id)."""
    own = removed.select(F.col("id")).distinct()
    near = edges.join(own.select(F.col("id").alias("src"), F.lit(True).alias("__a")), "src", "left").join(own.select(F.col("id").alias("dst"), F.lit(True).alias("__b")), "dst", "left")
    return near.where(F.coalesce("__a", F.lit(False)) != F.coalesce("__b", F.lit(False))).select(*edges.columns)


def prune_orphans(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops package and module nodes that own nothing, again and again up the hierarchy."""
    while True:
        owners = edges.where("relation = 'OWNS'").select(F.col("src").alias("id")).distinct()
        bare = nodes.where(F.col("id").startswith("pkg:") | F.col("id").startswith("module:")).join(owners, "id", "left_anti").select("id")
        bare = materialize(bare, "orphans")
        if bare.isEmpty():
            return nodes, edges
        nodes = materialize(nodes.join(bare, "id", "left_anti"), "nodes")
        edges = materialize(edges.join(bare.withColumnRenamed("id", "src"), "src", "left_anti").join(bare.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns), "edges")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: import edges, ambiguous edges, dynamic nodes."""
    of_edges = edges.agg(F.count_if(F.col("relation") == "IMPORTS").alias("import_edges"), F.count_if(F.col("certainty") == 0.60).alias("ambiguous_edges"))
    return of_edges.crossJoin(nodes.agg(F.count_if(F.col("kind") == "dynamic_call").alias("dynamic_nodes")))
