"""File listing that keeps names with a leading underscore, contents, and snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".java", ".rs")
# Folders left out unless told otherwise.
EXCLUDE = ["venv", ".venv", "node_modules", ".git", "__pycache__", "dist"]


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, full, mtime) of source files; a file that cannot be read is left out."""
    skip = set(EXCLUDE if exclude is None else exclude)
    rows = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip)
        for name in sorted(names):
            if name in skip or not name.lower().endswith(EXTENSIONS):
                continue
            full = os.path.join(folder, name)
            try:
                rows.append((os.path.relpath(full, root).replace(os.sep, "/"), full, os.stat(full).st_mtime))
            except OSError:
                continue
    return spark.createDataFrame(rows, "path string, full string, mtime double")


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("path", "mtime")


def contents(files: DataFrame) -> DataFrame:
    """(rel_path, content): content is null where it is not UTF-8 or cannot be read."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for full in batch["full"]:
                try:
                    with open(full, "rb") as f:
                        out.append(f.read().decode("utf-8"))
                except (OSError, UnicodeDecodeError):
                    out.append(None)
            yield pd.DataFrame({"rel_path": batch["path"], "content": pd.Series(out, dtype=object)})

    return files.select("path", "full").mapInPandas(read, "rel_path string, content string")


def named(paths: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """paths(rel_path, ...) with module, package, import_root and is_package: the longest root that holds a path names it."""
    roots = sorted(["", *(roots or [])], key=len, reverse=True)
    root = F.lit("")
    for r in reversed(roots):
        if r:
            root = F.when(F.col("rel_path").startswith(r + "/"), r).otherwise(root)
    inner = F.when(F.length("import_root") > 0, F.expr("substring(rel_path, length(import_root) + 2)")).otherwise(F.col("rel_path"))
    bare = F.regexp_replace(inner, r"[.][A-Za-z]+$", "")
    whole = F.regexp_replace(bare, r"(^|/)__init__$", "")
    name = F.when(whole == "", "root").otherwise(F.translate(whole, "/", "."))
    is_package = F.col("rel_path").rlike(r"(^|/)__init__[.][a-z]+$")
    told = paths.withColumn("import_root", root).withColumn("module", name).withColumn("is_package", is_package)
    return told.withColumn("package", F.when(F.col("is_package"), F.col("module")).otherwise(F.regexp_replace("module", r"[.]?[^.]*$", "")))


def modules(paths: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """(filepath, module, package, import_root, is_package) of paths(rel_path)."""
    return named(paths.select("rel_path"), roots).select(F.col("rel_path").alias("filepath"), "module", "package", "import_root", "is_package")
