"""Symbols and imports of TypeScript, JavaScript, Go, Java and Rust files.

A file is read as tokens, without comments and strings. Each statement's head is walked token by
token: its leading words, what it declares, its name, its bases. The brace block that holds a
declaration places it: functions count at file level, methods directly in a class body. Calls are
the dotted names that a body puts before an opening bracket; what is called on a result or an item
counts by its bare name. JavaScript and Rust rows have no calls (null), as no edge is drawn from
those languages.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable

from .blocks import Source

# The keywords of each language's grammar, which are neither methods nor calls.
SCRIPT_KEYWORDS = {
    "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for",
    "function", "if", "implements", "import", "in", "instanceof", "interface", "let", "new", "null", "package", "private", "protected", "public", "return", "static", "super",
    "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield",
}
GO_KEYWORDS = {
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range",
    "return", "select", "struct", "switch", "type", "var",
}
JAVA_KEYWORDS = {
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double", "else", "enum", "extends", "false", "final",
    "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "null", "package", "private", "protected", "public",
    "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "true", "try", "void", "volatile", "while",
}
# Words that may stand before a declaration.
SCRIPT_LEADS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "override", "readonly", "accessor", "get", "set"}
JAVA_LEADS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "sealed", "transient", "volatile"}
RUST_LEADS = {"const", "async", "unsafe", "extern", "default"}

Parsed = tuple[list[dict], list[tuple[str, str]], list[str], None]


def row(src: Source, at: int, path: str, module: str, owner: str | None, name: str, kind: str, **more) -> dict:
    """A symbol row; classes carry the class around them, members the class they belong to."""
    whole = ".".join(x for x in (module, owner, name) if x)
    base = {"unique_id": whole, "module": module, "filepath": path, "class_name": owner, "function_name": None if kind == "class" else name, "decorators": [], "line_no": src.line(at), "col_offset": 0}
    base |= {"visibility": "public", "async_sync": None if kind == "class" else "sync", "kind": kind, "method_kind": "instance" if kind == "method" else None, "bases": None, "calls": None}
    base |= {"local_types": None, "parent_id": None, "local_defs": None, "globals": None, "nonlocals": None, "end_line_no": src.ends(at)}
    return base | more


def dotted(src: Source, i: int, joint: str = ".") -> tuple[str, int]:
    """The dotted name that starts at token i, and the place after it; empty where none does."""
    if i >= len(src.tokens) or not src.tokens[i].is_name:
        return "", i
    parts, i = [src.tokens[i].text], i + 1
    while src.token(i) == joint and i + 1 < len(src.tokens) and src.tokens[i + 1].is_name:
        parts.append(src.tokens[i + 1].text)
        i += 2
    return joint.join(parts), i


def leads(src: Source, i: int, words: set[str]) -> tuple[set[str], int]:
    """The leading words at token i and the place after them; a word that is itself the declared name is not one."""
    found = set()
    while src.token(i) in words and (i + 1 < len(src.tokens)) and (src.tokens[i + 1].is_name or src.token(i + 1) in "@*<"):
        found.add(src.token(i))
        i += 1
    return found, i


def calls(src: Source, at: int, keywords: set[str]) -> list[str]:
    """What a declaration's body calls, in order; an arrow without braces is read to the end of its line."""
    block = src.body(at)
    if block is not None:
        low, high = src.blocks[block].start, src.blocks[block].end
    else:
        high = src.shown.find("\n", at)
        high = high if high >= 0 else len(src.shown)
        low = src.shown.find("=>", at, high)
        if low < 0:
            return []
    found = []
    i = src.index_at(low)
    while i < len(src.tokens) and src.tokens[i].at < high:
        name, after = dotted(src, i)
        if not name:
            i += 1
            continue
        if src.token(after) == "(" and name.rpartition(".")[2] not in keywords and src.token(i - 1) not in ("function", "func"):
            found.append(name)
        i = after
    return found


def bases_after(src: Source, i: int, words: set[str]) -> tuple[list[str], int]:
    """Names listed after any of words up to the body, type arguments left out; and the place of the body's brace, or -1."""
    found, listing = [], False
    while i < len(src.tokens):
        text = src.token(i)
        if text == "{":
            return found, i
        if text in ";}":
            break
        if text in words:
            listing, i = True, i + 1
        elif text in ("<", "("):
            i = max(src.past(i), i + 1)
        elif src.tokens[i].is_name:
            name, i = dotted(src, i)
            if name == "permits":
                listing = False
            elif listing:
                found.append(name)
        else:
            i += 1
    return found, -1


class Classes:
    """Class bodies met so far by their block, and the class that holds a place."""

    def __init__(self, src: Source):
        self.src, self.by_block = src, {}

    def add(self, brace: int, name: str) -> None:
        self.by_block[self.src.block_at(self.src.tokens[brace].at + 1)] = name

    def around(self, at: int) -> str | None:
        return self.by_block.get(self.src.block_at(at))


def script_module(target: str, module: str, is_package: bool) -> str:
    """A relative path from the importing module's folder; other paths become dotted names."""
    if not target.startswith("."):
        return target.replace("/", ".")
    folder = "/".join(module.split(".") if is_package else module.split(".")[:-1])
    whole = posixpath.normpath(posixpath.join("/" + folder, re.sub(r"\.(?:tsx?|jsx?|mjs|cjs)$", "", target)))
    return whole.strip("/").replace("/", ".") or "root"


def script_import(src: Source, i: int, where: Callable[[str], str]) -> list[tuple[str, str]]:
    """Names that the import statement at token i binds: default, namespace, and listed ones with their aliases."""
    i += 1
    if src.token(i) == "type" and src.token(i + 1) not in ("from", ","):
        i += 1
    whole, listed, inside = [], [], False
    while i < len(src.tokens) and (inside or src.token(i) != "from" or not (whole or listed or src.token(i - 1) == "}")):
        text = src.token(i)
        if text in ("(", ";") or text == "import":
            return []
        if text in "{}":
            inside = text == "{"
        elif text == "*" and src.token(i + 1) == "as":
            whole.append(src.token(i + 2))
            i += 2
        elif src.tokens[i].is_name and inside:
            if text == "type" and src.tokens[i + 1].is_name and src.token(i + 1) != "as":
                i += 1
            name, local = src.token(i), src.token(i)
            if src.token(i + 1) == "as":
                local = src.token(i + 2)
                i += 2
            listed.append((local, name))
        elif src.tokens[i].is_name:
            whole.append(text)
        i += 1
    if i >= len(src.tokens):
        return []
    path = src.literal_after(src.tokens[i].at)
    if path is None:
        return []
    return [(local, f"{where(path)}.{name}") for local, name in listed] + [(name, where(path)) for name in whole]


def arrow_at(src: Source, i: int) -> int:
    """For 'name [: type] = ...' with name at token i: the place of what is assigned, if that is an arrow function, else -1."""
    i += 1
    if src.token(i) == ":":
        while i < len(src.tokens) and src.token(i) not in ("=", ";"):
            i = max(src.past(i), i + 1)
    if src.token(i) != "=":
        return -1
    first = i = i + 1
    if src.token(i) == "async" and src.token(i + 1) != "=>":
        i += 1
    i = src.past(i) if src.token(i) == "<" else i
    if src.token(i) == "(":
        i = src.past(i)
        if src.token(i) == ":":
            while i < len(src.tokens) and src.token(i) not in ("=>", ";", "="):
                i = max(src.past(i), i + 1) if src.token(i) != "{" else src.past(i)
    elif i < len(src.tokens) and src.tokens[i].is_name:
        i += 1
    return first if src.token(i) == "=>" else -1


def _script(path: str, text: str, module: str, is_package: bool, with_calls: bool) -> Parsed:
    src = Source(text, "script")
    classes, out, names = Classes(src), [], []
    where = lambda target: script_module(target, module, is_package)
    hidden = lambda name, lead: "private" if name[0] in "_#" or "private" in lead else "public"

    def put(at: int, owner: str | None, name: str, kind: str, **more) -> None:
        made = calls(src, at, SCRIPT_KEYWORDS) if with_calls and kind != "class" else None
        out.append(row(src, at, path, module, owner, name, kind, **{"calls": made} | more))

    for start in range(len(src.tokens)):
        if src.token(start) in ("const", "let", "var") and src.token(start + 2) == "=" and src.token(start + 3) == "require" and src.token(start + 4) == "(":
            target = src.literal_after(src.tokens[start + 4].at)
            if target is not None and src.tokens[start + 1].is_name and src.shown[src.tokens[start + 4].at + 1 :].lstrip()[:1] == ")":
                names.append((src.token(start + 1), where(target)))
        if not src.opens_statement(start):
            continue
        if src.token(start) == "import":
            names += script_import(src, start, where)
            continue
        lead, i = leads(src, start, SCRIPT_LEADS)
        word, at_file = src.token(i), src.block_at(src.tokens[i].at) < 0
        owner = classes.around(src.tokens[i].at)
        named = i + 1 < len(src.tokens) and src.tokens[i + 1].is_name
        if word == "class" and named:
            bases, brace = bases_after(src, i + 2, {"extends", "implements"})
            if brace >= 0:
                put(src.tokens[i + 1].at, owner, src.token(i + 1), "class", bases=bases or None)
                classes.add(brace, src.token(i + 1))
        elif word == "function":
            i += 2 if src.token(i + 1) == "*" else 1
            if at_file and src.token(i + 1) in ("(", "<") and src.tokens[i].is_name:
                put(src.tokens[i].at, None, src.token(i), "function", visibility=hidden(src.token(i), ()), async_sync="async" if "async" in lead else "sync")
        elif word in ("const", "let", "var") and named:
            value = arrow_at(src, i + 1)
            if at_file and value >= 0:
                put(src.tokens[i + 1].at, None, src.token(i + 1), "function", visibility=hidden(src.token(i + 1), ()), async_sync="async" if src.token(value) == "async" else "sync")
        elif owner:
            i += word == "*"
            name = src.token(i)
            if src.token(i + 1) in ("(", "<") and src.tokens[i].is_name and name not in SCRIPT_KEYWORDS and name != "constructor":
                put(src.tokens[i].at, owner, name, "method", visibility=hidden(name, lead), async_sync="async" if "async" in lead else "sync", method_kind="static" if "static" in lead else "instance")
    return sorted(out, key=lambda r: r["line_no"]), names, [], None


def parse_typescript(path: str, text: str, module: str, is_package: bool) -> Parsed:
    return _script(path, text, module, is_package, True)


def parse_javascript(path: str, text: str, module: str, is_package: bool) -> Parsed:
    return _script(path, text, module, is_package, False)


def go_imports(src: Source, i: int) -> list[tuple[str, str]]:
    """(local name, path) of the import at token i: one string, or a bracketed list, each with an alias before it or none."""
    if src.token(i + 1) == "(":
        low, high = src.tokens[i + 1].at + 1, src.tokens[src.past(i + 1) - 1].at
    else:
        low, high = src.tokens[i].at + len("import"), src.shown.find("\n", src.tokens[i].at)
        high = high if high >= 0 else len(src.shown)
    found = []
    for at, target in src.literals:
        if low <= at < high and target:
            before = src.shown[max(low, src.shown.rfind("\n", 0, at) + 1) : at].split()
            found.append((before[-1] if before else target.rpartition("/")[2], target))
    return found


def embedded(src: Source, brace: int) -> list[str]:
    """Fields of a struct that are a type name alone, by their names."""
    lines: dict[int, list[str]] = {}
    home = src.block_at(src.tokens[brace].at + 1)
    for token in src.tokens[brace + 1 : src.past(brace) - 1]:
        if src.block_at(token.at) == home:
            lines.setdefault(src.line(token.at), []).append(token.text)
    found = []
    for texts in lines.values():
        name = texts[1:] if texts[0] == "*" else texts
        if name and all((x == ".") == bool(k % 2) for k, x in enumerate(name)) and len(name) in (1, 3) and re.match(r"\w", name[0]):
            found.append("".join(name))
    return found


def parse_go(path: str, text: str, module: str, is_package: bool) -> Parsed:
    """The package clause names the module, a capital makes a name public, single fields of a struct are its bases."""
    src = Source(text, "go")
    out, names = [], []
    heads = [i for i in range(len(src.tokens)) if src.opens_statement(i) and src.block_at(src.tokens[i].at) < 0]
    clause = next((i for i in heads if src.token(i) == "package" and src.token(i + 1)), None)
    module = posixpath.splitext(posixpath.basename(path))[0] if clause is None else src.token(clause + 1)
    seen = lambda name: "public" if name[0].isupper() else "private"
    for i in heads:
        word = src.token(i)
        if word == "import":
            names += go_imports(src, i)
        elif word == "type" and i + 1 < len(src.tokens) and src.tokens[i + 1].is_name:
            after = src.past(i + 2) if src.token(i + 2) == "[" else i + 2
            if src.token(after) in ("struct", "interface") and src.token(after + 1) == "{":
                bases = embedded(src, after + 1) if src.token(after) == "struct" else None
                out.append(row(src, src.tokens[i + 1].at, path, module, None, src.token(i + 1), "class", visibility=seen(src.token(i + 1)), bases=bases))
        elif word == "func":
            owner, i = None, i + 1
            if src.token(i) == "(":
                inside = [x.text for x in src.tokens[i + 1 : src.past(i) - 1]]
                plain = inside[: inside.index("[")] if "[" in inside else inside
                owner = next((x for x in reversed(plain) if re.match(r"\w", x)), None)
                i = src.past(i)
            if i < len(src.tokens) and src.tokens[i].is_name and src.token(i + 1) in ("(", "["):
                at, name = src.tokens[i].at, src.token(i)
                out.append(row(src, at, path, module, owner, name, "method" if owner else "function", visibility=seen(name), calls=calls(src, at, GO_KEYWORDS)))
    return sorted(out, key=lambda r: r["line_no"]), names, [], None


def java_type(src: Source, i: int) -> int:
    """The place after the type at token i: a dotted name, its arguments, and brackets of arrays; i where none stands."""
    name, after = dotted(src, i)
    if not name:
        return i
    if src.token(after) == "<":
        after = src.past(after)
    while src.token(after) == "[" and src.token(after + 1) == "]":
        after += 2
    return after


def parse_java(path: str, text: str, module: str, is_package: bool) -> Parsed:
    """The package clause names the module (without one, the path does); protected counts as private."""
    src = Source(text, "java")
    classes, out, names = Classes(src), [], []
    for start in range(len(src.tokens)):
        if not (src.opens_statement(start) and (start == 0 or src.token(start - 1) in "{};" or src.block_at(src.tokens[start].at) < 0 or src.token(start - 1) == ")")):
            continue
        i = start
        while src.token(i).startswith("@") and src.token(i) != "@interface":
            i = dotted(src, i + 2)[1] if src.token(i + 1) == "." else i + 1
            i = src.past(i)
        lead, i = leads(src, i, JAVA_LEADS)
        if i >= len(src.tokens):
            break
        word, owner = src.token(i), classes.around(src.tokens[i].at)
        visibility = "private" if lead & {"private", "protected"} else "public"
        if word == "package":
            module = dotted(src, i + 1)[0] or module
        elif word == "import":
            whole, after = dotted(src, i + 1 + (src.token(i + 1) == "static"))
            if src.token(after) == ";" and whole:
                names.append((whole.rpartition(".")[2], whole))
        elif word in ("class", "interface", "enum", "record", "@interface") and i + 1 < len(src.tokens) and src.tokens[i + 1].is_name and src.token(i + 2) != "=":
            bases, brace = bases_after(src, i + 2, {"extends", "implements"})
            if brace >= 0:
                name = src.token(i + 1)
                out.append(row(src, src.tokens[i + 1].at, path, module, owner, name, "class", visibility=visibility, bases=bases or None))
                classes.add(brace, name)
        elif owner:
            i = src.past(i) if word == "<" else i
            after = java_type(src, i)
            if after > i and after < len(src.tokens) and src.tokens[after].is_name and src.token(after + 1) == "(" and src.token(after) not in JAVA_KEYWORDS and src.token(i) not in ("new", "return", "throw", "else"):
                at = src.tokens[after].at
                kind = "abstract" if "abstract" in lead else "static" if "static" in lead else "instance"
                out.append(row(src, at, path, module, owner, src.token(after), "method", visibility=visibility, method_kind=kind, calls=calls(src, at, JAVA_KEYWORDS)))
    return sorted(out, key=lambda r: r["line_no"]), names, [], None


def rust_uses(src: Source, i: int, above: str = "") -> tuple[list[tuple[str, str]], int]:
    """(local name, path) of the use tree at token i, and the place after it; a glob binds nothing."""
    path, i = dotted(src, i + (src.token(i) == "::"), "::")
    whole = "::".join(x for x in (above, path) if x)
    if src.token(i) == "::" and src.token(i + 1) == "{":
        found, i = [], i + 2
        while i < len(src.tokens) and src.token(i) != "}":
            more, after = rust_uses(src, i, whole)
            found += more
            i = max(after, i + 1) if src.token(after) != "," else after + 1
        return found, i + 1
    if src.token(i) == "::":
        return [], i + 2
    if path == "self" and above:
        whole = above
    local = whole.rpartition("::")[2]
    if src.token(i) == "as":
        local, i = src.token(i + 1), i + 2
    return ([(local, whole)] if path else []), i


def rust_owner(src: Source, i: int) -> tuple[str, int]:
    """The concrete type of the impl at token i, and the place of its brace, or -1."""
    i = src.past(i + 1) if src.token(i + 1) == "<" else i + 1
    name = ""
    while i < len(src.tokens) and src.token(i) not in ("{", ";", "where"):
        if src.token(i) == "for":
            name, i = "", i + 1
        elif src.token(i) == "<":
            i = src.past(i)
        elif src.token(i) == "'":
            i += 2
        elif src.tokens[i].is_name and src.token(i) not in ("dyn", "mut"):
            found, i = dotted(src, i, "::")
            name = name or found.rpartition("::")[2]
        else:
            i += 1
    while i < len(src.tokens) and src.token(i) not in "{;":
        i += 1
    return name, i if src.token(i) == "{" else -1


def parse_rust(path: str, text: str, module: str, is_package: bool) -> Parsed:
    """Functions in an impl block are methods of its concrete type; what is not pub is private."""
    src = Source(text, "rust")
    classes, out, names = Classes(src), [], []
    for start in range(len(src.tokens)):
        if not src.opens_statement(start):
            continue
        i, public = start, src.token(start) == "pub"
        if public:
            i = src.past(i + 1) if src.token(i + 1) == "(" else i + 1
        lead, i = leads(src, i, RUST_LEADS)
        if i >= len(src.tokens):
            break
        word, at = src.token(i), src.tokens[i].at
        home, owner = src.block_at(at), classes.around(at)
        named = i + 1 < len(src.tokens) and src.tokens[i + 1].is_name
        told = {"visibility": "public" if public else "private"}
        if word == "use" and named or word == "use" and src.token(i + 1) == "::":
            names += rust_uses(src, i + 1)[0]
        elif word in ("impl",) and (home < 0 or owner is None):
            name, brace = rust_owner(src, i)
            if name and brace >= 0:
                classes.add(brace, name)
        elif word in ("struct", "enum", "trait") and named and home < 0:
            out.append(row(src, src.tokens[i + 1].at, path, module, None, src.token(i + 1), "class", **told))
        elif word == "fn" and named and (home < 0 or owner):
            out.append(row(src, src.tokens[i + 1].at, path, module, owner, src.token(i + 1), "method" if owner else "function", async_sync="async" if "async" in lead else "sync", **told))
    return sorted(out, key=lambda r: r["line_no"]), names, [], None
