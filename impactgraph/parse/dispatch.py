"""Files to symbol and import tables: one pass, one row a file, parsers chosen by extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..shared import materialize
from ..sources import files as paths
from . import brace_source, python_source

PARSERS: dict[str, Callable] = {
    ".py": python_source.parse,
    ".ts": brace_source.parse_typescript,
    ".tsx": brace_source.parse_typescript,
    ".js": brace_source.parse_javascript,
    ".jsx": brace_source.parse_javascript,
    ".mjs": brace_source.parse_javascript,
    ".cjs": brace_source.parse_javascript,
    ".go": brace_source.parse_go,
    ".java": brace_source.parse_java,
    ".rs": brace_source.parse_rust,
}

_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_KINDS = {"line_no": pa.int32(), "col_offset": pa.int32(), "end_line_no": pa.int32(), "local_types": pa.map_(_TEXT, _TEXT)}
_KINDS |= dict.fromkeys(("decorators", "bases", "calls", "local_defs", "globals", "nonlocals"), _TEXTS)
_SYMBOL = pa.struct([(x, _KINDS.get(x, _TEXT)) for x in "unique_id module filepath class_name function_name decorators line_no col_offset visibility async_sync kind method_kind bases calls local_types parent_id local_defs globals nonlocals end_line_no".split()])
_IMPORT = pa.struct([("local_name", _TEXT), ("fqn", _TEXT)])
_ROW = pa.schema([("filepath", _TEXT), ("symbols", pa.list_(_SYMBOL)), ("imports", pa.list_(_IMPORT)), ("wildcards", _TEXTS), ("all_names", _TEXTS)])


def register(extension: str, parser: Callable) -> None:
    """A parser takes (path, text, module, is_package) and returns (symbols, imports, wildcards, listed names)."""
    PARSERS[extension] = parser


def unregister(extension: str) -> None:
    PARSERS.pop(extension, None)


def parse_files(files: DataFrame, roots: list[str] | None = None) -> dict[str, DataFrame]:
    """symbols, imports and import_meta of files(rel_path, content); of equal ids the last by (path, order) stays.

    Files are parsed where they lie: a path alone names its module, so no content is moved.
    """
    parsers = dict(PARSERS)

    def parsed(path: str, text: str | None, module: str, package: bool) -> tuple:
        parser = parsers.get(path[path.rfind(".") :].lower())
        if parser is None or text is None:
            return [], [], [], None
        try:
            return parser(path, text, module, package)
        except Exception:  # one file that a parser cannot take must not stop the others
            return [], [], [], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500).to_pylist()
                out = []
                for f in part:
                    symbols, imports, wild, listed = parsed(f["rel_path"], f["content"], f["module"], f["is_package"])
                    symbols = [x | {"local_types": None if x["local_types"] is None else list(x["local_types"].items())} for x in symbols]
                    out.append({"filepath": f["rel_path"], "symbols": symbols, "imports": [{"local_name": a, "fqn": b} for a, b in imports], "wildcards": wild, "all_names": listed})
                yield pa.RecordBatch.from_pylist(out, _ROW)

    given = paths.named(files.select("rel_path", "content"), roots).select("rel_path", "content", "module", "is_package")
    rows = materialize(given.mapInArrow(run, from_arrow_schema(_ROW)), "parsed")
    each = rows.select(F.posexplode("symbols").alias("ord", "s")).select("ord", "s.*")
    last = Window.partitionBy("unique_id").orderBy(F.col("filepath").desc(), F.col("ord").desc())
    symbols = each.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    named = rows.select("filepath", F.posexplode("imports").alias("ord", "i")).select(F.col("filepath").alias("file"), "ord", "i.*")
    newest = Window.partitionBy("file", "local_name").orderBy(F.col("ord").desc())
    imports = named.withColumn("n", F.row_number().over(newest)).where("n = 1").select("file", "local_name", "fqn")
    return {"symbols": symbols, "imports": imports, "import_meta": rows.select(F.col("filepath").alias("file"), "wildcards", "all_names")}
