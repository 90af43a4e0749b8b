"""Names, globs and test predicates as Column expressions."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, "[.]"), -1)


def prefixes(parts: Column) -> Column:
    """All dotted prefixes of an array of parts, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def glob(text: Column, patterns: list[str]) -> Column:
    """Case-sensitive shell patterns; none matches nothing."""
    out = F.lit(False)
    for pattern in patterns:
        body = fnmatch.translate(pattern).removeprefix("(?s:")
        body = body[: body.rindex(")")]
        out = out | text.rlike(f"^(?s:{body})$")
    return out


def excluded(path: Column, names: list[str]) -> Column:
    """Any component of the path is one of names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names))) if names else F.lit(False)


def is_test_name(node: Column) -> Column:
    """The name rule alone: file:function ids by file name or function, dotted ids by any part; dynamic nodes never."""
    parts = F.split(node, ":")
    base = F.element_at(F.split(F.element_at(parts, 1), "/"), -1)
    paired = base.startswith("test_") | F.element_at(parts, -1).startswith("test_")
    dotted = F.exists(F.split(node, "[.]"), lambda p: p.startswith("test_"))
    return F.when(node.contains(":dyn:"), False).when(F.size(parts) > 1, paired).otherwise(dotted)


@dataclass
class Discovery:
    """What counts as a test."""

    framework: str = "pytest"
    directories: list[str] = field(default_factory=lambda: ["tests"])
    files: list[str] = field(default_factory=lambda: ["test_*.py"])
    classes: list[str] = field(default_factory=lambda: ["Test*"])
    functions: list[str] = field(default_factory=lambda: ["test_*"])

    def is_test_file(self, path: Column) -> Column:
        parts = F.split(path, "/")
        folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        bare = F.size(parts) == 1
        inside = bare | F.arrays_overlap(folders, F.array(*map(F.lit, self.directories))) if self.directories else F.lit(True)
        return inside & glob(F.element_at(parts, -1), self.files)

    def is_test_node(self, node: Column, kind: Column, path: Column, class_name: Column, function_name: Column) -> Column:
        by_function = F.coalesce(glob(function_name, self.functions), F.lit(False))
        by_class = F.coalesce(glob(last_part(class_name), self.classes), F.lit(False))
        rule = {"pytest": by_function | by_class, "unittest": class_name.isNotNull() & by_function}.get(self.framework, by_function)
        known = kind.isin("function", "method") & self.is_test_file(path) & rule
        return F.when(node.contains(":dyn:"), False).when(kind.isNull(), is_test_name(node)).otherwise(F.coalesce(known, F.lit(False)))
