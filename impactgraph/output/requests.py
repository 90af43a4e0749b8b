"""JSON requests, one a line, answered one by one; a bad request never ends the loop."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from typing import Any, TextIO

# Protocol and its error codes.
PROTOCOL = "2024-11-05"
PARSE, UNKNOWN, FAILED = -32700, -32601, -32603


def _tool(description: str, required: list[str], **fields: str) -> dict:
    return {"description": description, "inputSchema": {"type": "object", "properties": {k: {"type": "string", "description": v} for k, v in fields.items()}, **({"required": required} if required else {})}}


_REPO, _NAME = "Path of the repository", "Full name of the changed function or method"
TOOLS = {
    "index_repository": _tool("Index a repository.", ["repo"], repo=_REPO),
    "impact": _tool("Tests that a change of a symbol can reach.", [], repo=_REPO, target=_NAME, function=_NAME),
    "suggest_files_to_update": _tool("Files to look at after a change of a symbol.", [], repo=_REPO, target=_NAME, function=_NAME),
    "analyze_diff": _tool("Symbols that a diff changes and the tests they can reach.", ["repo", "diff"], repo=_REPO, diff="A unified diff"),
    "explain_test": _tool("What a test calls.", ["repo", "test"], repo=_REPO, test="Full name of the test"),
    "health": _tool("State of the server.", []),
}


class Unknown(Exception):
    pass


def call(service, name: str, given: dict) -> Any:
    repo = given.get("repo") or os.environ.get("IMPACTGRAPH_REPO") or "."
    target = given.get("target") or given.get("function")
    if name in ("impact", "suggest_files_to_update") and not target:
        raise ValueError("either 'target' or 'function' must be given")
    does: dict[str, Callable[[], Any]] = {
        "index_repository": lambda: service.index_repository(repo),
        "impact": lambda: service.impact(repo, target),
        "suggest_files_to_update": lambda: service.suggest_files_to_update(repo, target),
        "analyze_diff": lambda: service.analyze_diff(repo, given.get("diff") or ""),
        "explain_test": lambda: service.explain_test(repo, given.get("test") or ""),
        "health": service.health,
    }
    if name not in does:
        raise Unknown(f"Tool {name} not found.")
    return does[name]()


def answer(service, line: str) -> dict:
    """The response to one line."""
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": None}
    try:
        asked = json.loads(line)
    except ValueError as e:
        return reply | {"error": {"code": PARSE, "message": f"Parse error: {e}"}}
    try:
        reply["id"] = asked.get("id")
        method, given = asked.get("method"), asked.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "impactgraph", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": [{"name": name, **told} for name, told in TOOLS.items()]}
        elif method == "tools/call":
            found = call(service, given.get("name"), given.get("arguments") or {})
            result = {"content": [{"type": "text", "text": json.dumps(found, separators=(",", ":"))}], "diagnostics": service.metrics}
        else:
            raise Unknown(f"Method {method} not found.")
        return reply | {"result": result}
    except Unknown as e:
        return reply | {"error": {"code": UNKNOWN, "message": str(e)}}
    except Exception as e:  # a request that fails is answered, and the next one is read
        return reply | {"error": {"code": FAILED, "message": str(e)}}


def serve(service, lines: Iterable[str], out: TextIO) -> None:
    """Answers every line that is not blank."""
    for line in lines:
        if line.strip():
            out.write(json.dumps(answer(service, line)) + "\n")
            out.flush()
