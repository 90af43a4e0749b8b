"""Schemas of the engine's tables."""

from __future__ import annotations

FILES = "rel_path string, content string"
NESTED = "struct<parent_function:string,parent_id:string,scope_info:struct<globals:array<string>,nonlocals:array<string>,local_defs:array<string>>>"
SYMBOLS = (
    "unique_id string, module string, filepath string, class_name string, function_name string, decorators array<string>, "
    f"line_no int, col_offset int, visibility string, async_sync string, nested_info {NESTED}, kind string, method_kind string, "
    "bases array<string>, calls array<string>, local_types map<string,string>, package string, overload_info map<string,string>, "
    "generic_info map<string,string>, aliases array<string>, imported_names array<string>, exported_names array<string>, end_line_no int"
)
IMPORTS = "file string, local_name string, fqn string"
IMPORT_META = "file string, wildcards array<string>, all_names array<string>, star_excludes array<string>"
MODULES = "filepath string, module string, package string, import_root string, is_package boolean, is_namespace boolean"
NODES = "id string, kind string, name string, type string, filepath string, line_no int, col_offset int, decorators array<string>, function_name string, class_name string"
EDGES = "src string, dst string, relation string, certainty double, inheritance boolean, ord int"
SNAPSHOT = "path string, mtime double"
HITS = (
    "target string, test_function string, test_file string, chain array<string>, depth int, confidence string, score double, "
    "explanation string, reason string, resolution_explanation string"
)
