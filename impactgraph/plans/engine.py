"""From a source tree to tables, graph and answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import Discovery, last_part
from ..operators import graph, lookup, resolve, search
from ..parse.dispatch import parse_files
from ..shared import materialize
from ..sources import diff_text, files


@dataclass
class Index:
    symbols: DataFrame
    imports: DataFrame
    import_meta: DataFrame
    modules: DataFrame
    snapshot: DataFrame


def index_repository(spark: SparkSession, root: str, exclude: list[str] | None = None, roots: list[str] | None = None) -> Index:
    """The index of a source tree; driver and executors must see it under the same path."""
    listed = files.listing(spark, root, exclude)
    return index_files(files.contents(listed), listed.select(F.col("path").alias("rel_path")), roots, files.snapshot(listed))


def index_files(content: DataFrame, paths: DataFrame | None = None, roots: list[str] | None = None, snapshot: DataFrame | None = None) -> Index:
    """The index of content(rel_path, content), which may be any table of source files."""
    modules = materialize(files.modules(content.select("rel_path") if paths is None else paths, roots), "modules")
    parsed = parse_files(content, roots)
    symbols = materialize(parsed["symbols"], "symbols")
    if snapshot is None:
        snapshot = modules.select(F.col("filepath").alias("path"), F.lit(None).cast("double").alias("mtime"))
    return Index(symbols, parsed["imports"], parsed["import_meta"], materialize(named_modules(modules, symbols), "modules"), snapshot)


def named_modules(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """modules with the names that the files themselves give, where a package clause overrules the path."""
    told = symbols.groupBy("filepath").agg(F.min("module").alias("told"))
    kept = modules.join(told, "filepath", "left").withColumn("own", F.coalesce("told", "module"))
    package = F.when(F.col("own") == F.col("module"), F.col("package")).otherwise(F.regexp_replace("own", r"[.]?[^.]*$", ""))
    return kept.select("filepath", F.col("own").alias("module"), package.alias("package"), *[c for c in modules.columns if c not in ("filepath", "module", "package")])


def summary(index: Index) -> DataFrame:
    count = index.symbols.agg(F.count("*").alias("symbols_count"), F.count_if(F.col("kind") != "class").alias("functions_count"), F.coalesce(F.sum(F.size("calls")), F.lit(0)).alias("calls_count"))
    return count.crossJoin(index.imports.agg(F.count_distinct("file").alias("imports_count"))).withColumn("status", F.lit("ok"))


def build_graph(index: Index, discovery: Discovery | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the repository."""
    discovery = discovery or Discovery()
    symbols, empty = index.symbols, lambda t: F.lit(None).cast(t)
    imports = resolve.close_imports(index.imports, index.import_meta, index.modules, symbols)
    excludes = resolve.star_excludes(index.import_meta, index.modules, symbols, imports)
    calls = resolve.resolve_calls(symbols, imports, excludes=excludes, modules=index.modules)
    of = symbols.select("unique_id", F.concat_ws(".", "module", "class_name").alias("full_class"), "class_name")
    pair = calls.join(of.select(F.col("unique_id").alias("src"), F.col("full_class").alias("a"), F.col("class_name").alias("ac")), "src").join(of.select(F.col("unique_id").alias("dst"), F.col("full_class").alias("b"), F.col("class_name").alias("bc")), "dst")
    crossing = F.col("ac").isNotNull() & F.col("bc").isNotNull() & (F.col("a") != F.col("b"))
    called = pair.select("src", "dst", F.lit("CALLS").alias("relation"), "certainty", crossing.alias("inheritance"))
    sites = symbols.select(F.col("unique_id").alias("caller"), "module", "filepath", F.explode("calls").alias("tag"))
    members = symbols.where("kind != 'class'").select("module", F.col("unique_id").alias("id"))
    dynamic_nodes, dynamic_edges = graph.dynamic_calls(sites, members)
    hidden = dynamic_edges.select("src", "dst", F.lit("CALLS").alias("relation"), "certainty", F.lit(False).alias("inheritance"))
    typed = lambda rows, name: rows.select("src", "dst", F.lit(name).alias("relation"), empty("double").alias("certainty"), empty("boolean").alias("inheritance"))
    tree = graph.hierarchy(index.modules)
    owner = F.when(F.col("parent_id").isNotNull(), F.col("parent_id")).when(F.col("class_name").isNotNull(), F.concat_ws(".", "module", "class_name")).otherwise(F.concat(F.lit("module:"), "module"))
    owned = symbols.select(owner.alias("src"), F.col("unique_id").alias("dst"))
    bases = resolve.base_links(symbols, imports)
    abstract = symbols.where("method_kind = 'abstract'").select(F.concat_ws(".", "module", "class_name").alias("base"), F.lit(True).alias("abstract")).distinct()
    inherits = bases.join(abstract, "base", "left").select(F.col("cls").alias("src"), F.col("base").alias("dst"), F.when(F.col("abstract"), "IMPLEMENTS").otherwise("INHERITS").alias("relation"), empty("double").alias("certainty"), empty("boolean").alias("inheritance"))
    where = index.modules.select(F.col("filepath").alias("file"), F.concat(F.lit("module:"), "module").alias("src"))
    to_module = index.modules.select(F.col("module").alias("fqn"), F.concat(F.lit("module:"), "module").alias("as_module"))
    to_symbol = symbols.select(F.col("unique_id").alias("fqn"), F.col("unique_id").alias("as_symbol"))
    imported = imports.join(where, "file").join(to_module, "fqn", "left").join(to_symbol, "fqn", "left").select("src", F.coalesce("as_module", "as_symbol").alias("dst")).where("dst is not null").distinct()
    edges = called.unionByName(hidden).unionByName(typed(tree.unionByName(owned), "OWNS")).unionByName(inherits).unionByName(typed(imported, "IMPORTS"))
    is_test = discovery.is_test_node(F.col("unique_id"), F.col("kind"), F.col("filepath"), F.col("class_name"), F.col("function_name"))
    nodes = symbols.select(F.col("unique_id").alias("id"), "kind", F.col("filepath").alias("file"), "line_no", (F.size("decorators") > 0).alias("decorated"), is_test.alias("is_test"))
    plain = lambda rows, kind: rows.select("id", kind.alias("kind"), empty("string").alias("file"), empty("int").alias("line_no"), F.lit(False).alias("decorated"), F.lit(False).alias("is_test"))
    places = tree.select(F.col("dst").alias("id")).distinct()
    nodes = nodes.unionByName(plain(places, F.when(F.col("id").startswith("module:"), "module").otherwise("package"))).unionByName(plain(dynamic_nodes.select("id"), F.lit("dynamic_call")))
    nodes = nodes.unionByName(plain(tree.select(F.lit("repo").alias("id")).distinct(), F.lit("repository")))
    return materialize(nodes, "nodes"), materialize(edges, "edges")


def affected_tests(nodes: DataFrame, edges: DataFrame, targets: list[str], max_depth: int = 10) -> DataFrame:
    wanted = nodes.sparkSession.createDataFrame([(t,) for t in targets], "node string")
    known = wanted.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    return search.affected_tests(nodes, edges, known, max_depth)


def explain_test(edges: DataFrame, test: str) -> DataFrame:
    """What a test calls itself: (target, cert, inherited)."""
    return graph.collapse_parallel(edges.where(F.col("src") == test)).select(F.col("dst").alias("target"), F.col("certainty").alias("cert"), F.col("inheritance").alias("inherited"))


def suggest_files(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """(file, priority, kind, reason) to look at after a change: 1 direct callers, 2 transitive ones, 3 tests.

    Callers are walked level by level up to tests, each node by its first way: via is the first
    step of that way, below the last one before the node.
    """
    back = materialize(graph.reverse(graph.collapse_parallel(edges)).select("src", "dst").distinct(), "callers")
    facts = nodes.select("id", "file", "is_test")
    none = F.lit(None).cast("string")
    level = nodes.sparkSession.createDataFrame([(target,)], "id string").select("id", none.alias("via"), none.alias("below"), F.lit(0).alias("depth"))
    levels = [level]
    depth = 0
    while True:
        depth += 1
        going = level if depth == 1 else level.join(facts.where("is_test").select("id"), "id", "left_anti")
        step = going.join(back, going["id"] == back["src"]).select(F.col("dst").alias("id"), F.coalesce("via", "dst").alias("via"), F.col("src").alias("below"), F.lit(depth).alias("depth"))
        for seen in levels:
            step = step.join(seen.select("id"), "id", "left_anti")
        level = materialize(lookup.merge_best(step, ["id"], [F.col("below"), F.col("via")]), "level")
        if level.isEmpty():
            break
        levels.append(level)
    found = levels[0].limit(0)
    for x in levels[1:]:
        found = found.unionByName(x)
    met = found.join(facts, "id").where("file is not null")
    prio = F.when(F.col("is_test"), 3).when(F.col("depth") == 1, 1).otherwise(2)
    goal, direct = F.lit(short_name(target)), F.col("depth") == 1
    tests = F.when(direct, F.concat(F.lit("tests "), goal, F.lit(" directly"))).otherwise(F.concat(F.lit("tests "), last_part(F.col("below")), F.lit(" which calls "), goal))
    calls = F.when(direct, F.concat(F.lit("calls "), goal, F.lit(" directly"))).otherwise(F.concat(F.lit("calls "), goal, F.lit(" via "), last_part(F.col("via"))))
    told = met.withColumn("priority", prio).withColumn("reason", F.when(F.col("is_test"), tests).otherwise(calls))
    named = F.when(F.col("priority") == 1, "direct_caller").when(F.col("priority") == 2, "transitive_caller").otherwise("transitive_test")
    best = lookup.merge_best(told, ["file"], [F.col("priority"), F.col("depth"), F.col("id")])
    return best.select("file", "priority", named.alias("kind"), "reason").orderBy("priority", "file")


def short_name(target: str) -> str:
    return target.rpartition(":")[2] if ":" in target else target.rpartition(".")[2]


def changed_symbols(index: Index, diffs: DataFrame) -> DataFrame:
    lines = diff_text.changed_lines(diffs).select(F.col("path"), "line")
    spans = index.symbols.where("kind != 'class'").select(F.col("filepath").alias("path"), F.col("unique_id").alias("id"), F.col("line_no").alias("start"), F.col("end_line_no").alias("end"))
    return lookup.attribute_lines(lines, spans, ["path"]).select("id").distinct()


def analyze_diff(index: Index, nodes: DataFrame, edges: DataFrame, diffs: DataFrame, max_depth: int = 10) -> DataFrame:
    """Best hit of each test over all changed symbols, by one traversal for all of them."""
    targets = changed_symbols(index, diffs).withColumnRenamed("id", "node")
    hits = search.affected_tests(nodes, edges, targets, max_depth)
    return lookup.merge_best(hits, ["test_function"], [-F.col("score"), F.col("target")]).orderBy(F.col("score").desc(), "test_function")
