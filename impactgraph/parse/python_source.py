"""Symbols and imports of one Python file, by the standard library's syntax tree."""

from __future__ import annotations

import ast

# Calls that hide their target, by plain name and by attribute.
HIDING_NAMES = {"getattr", "setattr", "eval", "exec", "__import__", "partial"}
HIDING_ATTRIBUTES = {"import_module", "__getattr__", "__call__"}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST | None) -> str:
    """a.b.c as text, super().x as super.x; an attribute of a result, a literal or an item is its bare name; else empty."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=owner, attr=name):
            return ".".join(x for x in (dotted(owner), name) if x)
        case ast.Call(func=ast.Name(id="super")):
            return "super"
    return ""


def hidden_kind(func: ast.AST, own: set[str]) -> str | None:
    """What hides the target of a call: a builtin, an attribute, a partial, a lambda, or a name that the function binds itself."""
    match func:
        case ast.Name(id=name):
            return name if name in HIDING_NAMES else "runtime_dispatch" if name in own else None
        case ast.Attribute(attr=name):
            return name if name in HIDING_ATTRIBUTES else "partial" if dotted(func) == "functools.partial" else None
        case ast.Lambda():
            return "lambda"
    return None


def inside(node: ast.AST):
    """All nodes below, without entering nested functions and classes."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (*FUNCTIONS, ast.ClassDef)):
            yield child
            yield from inside(child)


def simple_targets(body_of: ast.AST) -> set[str]:
    found = set()
    for n in inside(body_of):
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
        found |= {x.id for x in targets if isinstance(x, ast.Name)}
    return found


def parameters(fn) -> list[ast.arg]:
    a = fn.args
    return [*a.args, *a.kwonlyargs, *(x for x in (a.vararg, a.kwarg) if x)]


def calls_of(fn) -> list[str]:
    own = simple_targets(fn) | {a.arg for a in parameters(fn)}
    found = []
    nodes = [n for d in fn.decorator_list for n in (d, *ast.walk(d))] + [n for part in fn.body for n in ([] if isinstance(part, (*FUNCTIONS, ast.ClassDef)) else [part, *inside(part)])]
    for n in dict.fromkeys(nodes):
        if isinstance(n, ast.Call):
            kind = hidden_kind(n.func, own)
            name = f"dynamic:{kind}:{n.lineno}:{n.col_offset}" if kind else dotted(n.func)
            if name:
                found.append(((n.lineno, n.col_offset), name))
    return [name for _, name in sorted(found, key=lambda x: x[0])]


def local_types(fn, class_name: str | None) -> dict[str, str]:
    types = {"self": class_name, "cls": class_name} if class_name else {}
    for a in parameters(fn):
        if a.annotation is not None and dotted(a.annotation):
            types[a.arg] = dotted(a.annotation)
    for n in inside(fn):
        if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and dotted(n.annotation):
            types[n.target.id] = dotted(n.annotation)
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and dotted(n.value.func):
            types |= {x.id: dotted(n.value.func) for x in n.targets if isinstance(x, ast.Name)}
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            for item in n.items:
                if isinstance(item.context_expr, ast.Call) and isinstance(item.optional_vars, ast.Name) and dotted(item.context_expr.func):
                    types[item.optional_vars.id] = dotted(item.context_expr.func)
    return types


def method_kind(tags: list[str]) -> str:
    last = {t.rpartition(".")[2] for t in tags}
    for tag, kind in (("staticmethod", "static"), ("classmethod", "class"), ("property", "property"), ("setter", "property"), ("getter", "property"), ("abstractmethod", "abstract")):
        if tag in last:
            return kind
    return "instance"


def visible(name: str) -> str:
    return "private" if name.startswith("_") and not (name.startswith("__") and name.endswith("__")) else "public"


def imports_of(tree: ast.AST, module: str, is_package: bool) -> tuple[list[tuple[str, str]], list[str], list[str] | None]:
    names, wild, listed = [], [], None
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            names += [(a.asname, a.name) if a.asname else (a.name.partition(".")[0],) * 2 for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            base = n.module or ""
            if n.level:
                parts = module.split(".")
                parts = parts[: max(0, len(parts) - n.level + (1 if is_package else 0))]
                base = ".".join([*parts, *([n.module] if n.module else [])])
            for a in n.names:
                if a.name == "*":
                    wild.append(base)
                else:
                    names.append((a.asname or a.name, f"{base}.{a.name}" if base else a.name))
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            if any(isinstance(x, ast.Name) and x.id == "__all__" for x in targets) and isinstance(n.value, (ast.List, ast.Tuple)):
                told = [x.value if isinstance(x, ast.Constant) else None for x in n.value.elts]
                listed = told if all(isinstance(x, str) for x in told) else listed
    return names, wild, listed


def parse(path: str, text: str, module: str, is_package: bool) -> tuple[list[dict], list[tuple[str, str]], list[str], list[str] | None]:
    """(symbols, imports, wildcards, listed names); a syntax error gives nothing."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], [], [], None
    out: list[dict] = []

    def visit(node: ast.AST, class_name: str | None, parent: dict | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                name = f"{class_name}.{child.name}" if class_name else child.name
                out.append({"unique_id": f"{module}.{name}", "module": module, "filepath": path, "class_name": class_name, "function_name": None, "decorators": [], "line_no": child.lineno, "col_offset": child.col_offset, "visibility": visible(child.name), "async_sync": None, "kind": "class", "method_kind": None, "bases": [b for b in map(dotted, child.bases) if b], "calls": None, "local_types": None, "parent_id": None, "local_defs": None, "globals": None, "nonlocals": None, "end_line_no": child.end_lineno})
                visit(child, name, None)
            elif isinstance(child, FUNCTIONS):
                tags = [t for t in (dotted(d.func if isinstance(d, ast.Call) else d) for d in child.decorator_list) if t]
                owner = parent["unique_id"] if parent else f"{module}.{class_name}" if class_name else module
                body = [n for part in child.body for n in ([part] if isinstance(part, (*FUNCTIONS, ast.ClassDef)) else [part, *inside(part)])]
                nested = [n.name for n in ast.walk(child) if n is not child and isinstance(n, (*FUNCTIONS, ast.ClassDef)) and n in list(_direct(child))]
                row = {"unique_id": f"{owner}.{child.name}", "module": module, "filepath": path, "class_name": class_name, "function_name": child.name, "decorators": tags, "line_no": child.lineno, "col_offset": child.col_offset, "visibility": visible(child.name), "async_sync": "async" if isinstance(child, ast.AsyncFunctionDef) else "sync", "kind": "method" if class_name else "function", "method_kind": method_kind(tags) if class_name else None, "bases": None, "calls": calls_of(child), "local_types": local_types(child, class_name), "parent_id": parent["unique_id"] if parent else None, "local_defs": nested, "globals": [x for n in body if isinstance(n, ast.Global) for x in n.names], "nonlocals": [x for n in body if isinstance(n, ast.Nonlocal) for x in n.names], "end_line_no": child.end_lineno}
                out.append(row)
                visit(child, class_name, row)
            else:
                visit(child, class_name, parent)

    visit(tree, None, None)
    return out, *imports_of(tree, module, is_package)


def _direct(fn):
    """Functions and classes defined in fn's own body, whatever blocks they stand in."""
    for child in ast.iter_child_nodes(fn):
        if isinstance(child, (*FUNCTIONS, ast.ClassDef)):
            yield child
        else:
            yield from _direct(child)
