"""File changes of a source tree as a stream.

Each poll that finds a change stores the snapshot of the tree under the state folder; an offset is
the number of a snapshot, and a batch is the difference of two of them, so a batch that is run
again after a failure gives the same rows. The built-in file source would not do: it hides names
with a leading underscore and does not tell of edits and deletions.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.files import EXCLUDE, EXTENSIONS

SCHEMA = "path string, op string, mtime double"


def scan(root: str, exclude: list[str]) -> dict[str, float]:
    found = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in exclude]
        for name in names:
            if name.lower().endswith(EXTENSIONS) and name not in exclude:
                full = os.path.join(folder, name)
                try:
                    found[os.path.relpath(full, root).replace(os.sep, "/")] = os.stat(full).st_mtime
                except OSError:  # gone between listing and reading
                    continue
    return found


class ChangeReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["path"], options["state"]
        self.exclude = [x for x in options.get("exclude", ",".join(EXCLUDE)).split(",") if x]

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _snapshot(self, n: int) -> dict[str, float]:
        if n == 0:
            return {}
        with open(os.path.join(self.state, f"{n}.json"), encoding="utf-8") as f:
            return json.load(f)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now, n = self._snapshot(start["n"]), scan(self.root, self.exclude), start["n"]
        if now != before:
            n += 1
            os.makedirs(self.state, exist_ok=True)
            path = os.path.join(self.state, f"{n}.json")
            with open(path + ".new", "w", encoding="utf-8") as f:
                json.dump(now, f)
            os.replace(path + ".new", path)
        return self._rows(before, now), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(self._snapshot(start["n"]), self._snapshot(end["n"]))

    @staticmethod
    def _rows(before: dict[str, float], now: dict[str, float]) -> Iterator[tuple]:
        rows = []
        for path in sorted(before.keys() | now.keys()):
            if before.get(path) != now.get(path):
                rows.append((path, "added" if path not in before else "deleted" if path not in now else "modified", now.get(path)))
        return iter(rows)


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def changes(spark: SparkSession, root: str, state: str, exclude: list[str] | None = None):
    """A streaming DataFrame (path, op, mtime) of the tree's source files; op is added, modified or deleted."""
    spark.dataSource.register(ChangeSource)
    reader = spark.readStream.format("repo_changes").option("path", root).option("state", state)
    return (reader if exclude is None else reader.option("exclude", ",".join(exclude))).load()


def keep_updated(spark: SparkSession, root: str, folder: str, checkpoint: str, **update):
    """A stream writer that brings the stored index up to date once for each batch of changes; call start() on it."""
    from ..plans import store

    def apply(batch, _):
        if not batch.isEmpty():
            store.update(spark, root, folder, **update)

    return changes(spark, root, os.path.join(checkpoint, "snapshots")).writeStream.foreachBatch(apply).option("checkpointLocation", os.path.join(checkpoint, "stream"))
