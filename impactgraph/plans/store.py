"""A stored index and graph: versions side by side, the current one named by a file that is replaced at once.

An update parses only files whose mtime changed, takes the other files' rows over, and resolves
names anew, as one changed file can move what any other one's names mean. A failed update leaves
the version before it in place.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import Discovery
from ..operators import delta
from ..parse.dispatch import parse_files
from ..sources import files
from . import engine

TABLES = ("symbols", "imports", "import_meta", "modules", "snapshot", "nodes", "edges")
#: Version of the stored layout; a store of another one is built anew.
FORMAT, KEPT = 1, 2


def current(folder: str) -> str | None:
    """The folder of the current version; None where there is none that can be read."""
    try:
        with open(os.path.join(folder, "CURRENT"), encoding="utf-8") as f:
            told = json.load(f)
        path = os.path.join(folder, told["version"])
        return path if told["format"] == FORMAT and os.path.isdir(path) else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def load(spark: SparkSession, folder: str) -> tuple[engine.Index, DataFrame, DataFrame] | None:
    """(index, nodes, edges), or None."""
    path = current(folder)
    if path is None:
        return None
    read = {name: spark.read.parquet(os.path.join(path, name)) for name in TABLES}
    return engine.Index(*(read[x] for x in TABLES[:5])), read["nodes"], read["edges"]


def save(folder: str, index: engine.Index, nodes: DataFrame, edges: DataFrame) -> str:
    """Writes a version whole, then names it current; versions older than the last few go."""
    version = f"v-{uuid.uuid4().hex}"
    path = os.path.join(folder, version)
    try:
        for name, df in zip(TABLES, (index.symbols, index.imports, index.import_meta, index.modules, index.snapshot, nodes, edges)):
            df.write.parquet(os.path.join(path, name))
    except BaseException:
        shutil.rmtree(path, ignore_errors=True)
        raise
    fresh = os.path.join(folder, f"CURRENT.{version}")
    with open(fresh, "w", encoding="utf-8") as f:
        json.dump({"format": FORMAT, "version": version}, f)
    os.replace(fresh, os.path.join(folder, "CURRENT"))
    found = sorted((x for x in os.listdir(folder) if x.startswith("v-") and x != version), key=lambda x: os.path.getmtime(os.path.join(folder, x)))
    for old in found[: max(0, len(found) - KEPT + 1)]:
        shutil.rmtree(os.path.join(folder, old), ignore_errors=True)
    return path


def reindex(spark: SparkSession, root: str, old: engine.Index, exclude: list[str] | None, roots: list[str] | None) -> tuple[engine.Index, DataFrame]:
    """The index of the tree as it is now, and what changed (path, op); files with the mtime of old are not read."""
    listed = files.listing(spark, root, exclude)
    changes = engine.materialize(delta.snapshot_diff(old.snapshot, files.snapshot(listed)), "changes")
    fresh = listed.join(changes.where("op != 'deleted'").select("path"), "path", "left_semi")
    named = engine.materialize(files.modules(listed.select(F.col("path").alias("rel_path")), roots), "modules")
    parsed = parse_files(files.contents(fresh), roots)
    stay = delta.reusable(old.snapshot, files.snapshot(listed)).where("reused").select("path")

    def merged(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
        return before.join(stay.withColumnRenamed("path", key), key, "left_semi").select(*now.columns).unionByName(now)

    symbols = engine.materialize(merged(old.symbols, parsed["symbols"], "filepath"), "symbols")
    imports = merged(old.imports, parsed["imports"], "file")
    meta = merged(old.import_meta, parsed["import_meta"], "file")
    modules = engine.materialize(engine.named_modules(named, symbols), "modules")
    return engine.Index(symbols, imports, meta, modules, files.snapshot(listed)), changes


def update(spark: SparkSession, root: str, folder: str, discovery: Discovery | None = None, exclude: list[str] | None = None, roots: list[str] | None = None) -> tuple[engine.Index, DataFrame, DataFrame, DataFrame]:
    """(index, nodes, edges, feed) after bringing the store up to date; feed holds what came and went.

    Without a store, or with one of another format, everything is built and the feed lists it all
    as added. Where no file changed nothing is written and the feed is empty.
    """
    os.makedirs(folder, exist_ok=True)
    before = load(spark, folder)
    if before is None:
        index = engine.index_repository(spark, root, exclude, roots)
        nodes, edges = engine.build_graph(index, discovery)
        save(folder, index, nodes, edges)
        return index, nodes, edges, delta.change_feed(nodes.limit(0), nodes, edges.limit(0), edges)
    old, old_nodes, old_edges = before
    index, changes = reindex(spark, root, old, exclude, roots)
    if changes.isEmpty():
        return old, old_nodes, old_edges, delta.change_feed(old_nodes.limit(0), old_nodes.limit(0), old_edges.limit(0), old_edges.limit(0))
    nodes, edges = engine.build_graph(index, discovery)
    feed = engine.materialize(delta.change_feed(old_nodes, nodes, old_edges, edges), "feed")
    save(folder, index, nodes, edges)
    return index, nodes, edges, feed
