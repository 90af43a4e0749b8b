"""Answers as plain records, for the command line and the request loop; indexes are kept for each repository."""

from __future__ import annotations

import json
import logging
import os
import resource
import sys
import time
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..output import render
from ..plugins import plugin
from ..sources import layout
from ..sources.files import EXCLUDE
from . import engine, store

log = logging.getLogger("impactgraph")


@dataclass
class Service:
    spark: SparkSession
    #: Folder of the stored indexes; without one they live in the session only.
    index_dir: str | None = None
    metrics: dict = field(default_factory=dict)
    _known: dict = field(default_factory=dict)

    def event(self, name: str, **more) -> None:
        """One JSON line on the log, with the metrics so far."""
        self.metrics |= more
        self.metrics["memory_usage_bytes"] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
        log.info(json.dumps({"event": name, "metrics": self.metrics, "timestamp": time.time()}))

    def graph(self, repo: str, framework: str | None = None) -> tuple[engine.Index, DataFrame, DataFrame]:
        """(index, nodes, edges), as the files are now; what has not changed is not parsed again."""
        if not repo or not os.path.isdir(repo):
            raise ValueError(f"not a folder: {repo}")
        repo, hooks, began = os.path.realpath(repo), plugin(framework), time.time()
        key = (repo, (framework or "").lower())
        exclude, roots, what = hooks.pre_index(EXCLUDE), layout.import_roots(repo), layout.discovery(repo)
        if self.index_dir and not framework:
            index, nodes, edges, _ = store.update(self.spark, repo, os.path.join(self.index_dir, repo.strip("/").replace("/", "-") or "root"), what, exclude, roots)
        elif key in self._known:
            index, changes = store.reindex(self.spark, repo, self._known[key][0], exclude, roots)
            if changes.isEmpty():
                return self._known[key]
            index, nodes, edges = self._built(index, hooks, what)
        else:
            index, nodes, edges = self._built(engine.index_repository(self.spark, repo, exclude, roots), hooks, what)
        self._known[key] = index, nodes, edges
        told = graph.metrics(nodes, edges).first().asDict()
        self.event("repo_indexing_completed", files_indexed=index.snapshot.count(), index_time_sec=round(time.time() - began, 4), **told)
        return self._known[key]

    def _built(self, index: engine.Index, hooks, what) -> tuple[engine.Index, DataFrame, DataFrame]:
        index.symbols = hooks.post_index(index.symbols)
        return index, *hooks.post_graph(*engine.build_graph(index, what))

    def index_repository(self, repo: str, framework: str | None = None) -> dict:
        index, _, _ = self.graph(repo, framework)
        told = engine.summary(index).first()
        return {"status": "success", "symbols_count": told.symbols_count, "imports_count": told.imports_count}

    def hits(self, repo: str, target: str, framework: str | None = None, max_depth: int = 10) -> list[Row]:
        _, nodes, edges = self.graph(repo, framework)
        began = time.time()
        found = engine.affected_tests(nodes, edges, [target], max_depth).orderBy(F.col("score").desc(), "test_function").collect()
        self.event("impact_queried", query_time_sec=round(time.time() - began, 4))
        return found

    def impact(self, repo: str, target: str, framework: str | None = None) -> list[dict]:
        return render.compact(self.hits(repo, target, framework))

    def diff_hits(self, repo: str, diff: str, framework: str | None = None, max_depth: int = 10) -> tuple[list[str], list[Row]]:
        """Changed symbols, and the best hit of each test over all of them."""
        index, nodes, edges = self.graph(repo, framework)
        given = self.spark.createDataFrame([("diff", diff)], "diff_id string, text string")
        changed = sorted(r.id for r in engine.changed_symbols(index, given).collect())
        return changed, engine.analyze_diff(index, nodes, edges, given, max_depth).collect() if changed else []

    def analyze_diff(self, repo: str, diff: str, framework: str | None = None) -> dict:
        changed, found = self.diff_hits(repo, diff, framework)
        return {"changed_symbols": changed, "affected_tests": render.compact(found)}

    def explain_test(self, repo: str, test: str, framework: str | None = None) -> dict:
        _, nodes, edges = self.graph(repo, framework)
        own = nodes.where(F.col("id") == test).select("file").first()
        if own is None:
            return {"error": f"Test {test} not found in dependency graph."}
        calls = engine.explain_test(edges, test).orderBy("target").collect()
        return {"test": test, "file": own.file or "", "depends_on": [r.asDict() for r in calls]}

    def suggest_files_to_update(self, repo: str, target: str, framework: str | None = None) -> dict:
        _, nodes, edges = self.graph(repo, framework)
        rows = engine.suggest_files(nodes, edges, target).collect()
        return {"function": target, "files_to_review": [{"path": r.file, "reason": r.reason, "relationship": r.kind} for r in rows]}

    def health(self) -> dict:
        return {"status": "healthy", "python_version": sys.version, "spark_version": pyspark.__version__, "platform": sys.platform, "pid": os.getpid()}
