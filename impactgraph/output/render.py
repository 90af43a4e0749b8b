"""Hits as terminal text, JSON, Markdown and tool content; hits are few by then, so this runs on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Row


def short(node: str) -> str:
    return node.rpartition(":")[2] if ":" in node else node.rpartition(".")[2]


def chain_names(chain: Iterable[str]) -> list[str]:
    """Last name parts as calls, without module and repository nodes."""
    return [f"{short(n)}()" for n in chain if not n.startswith("module:") and n != "repo"]


def as_json(hits: list[Row]) -> str:
    rows = [
        {
            "test_function": h.test_function,
            "test_file": h.test_file,
            "reason": h.reason,
            "confidence": h.confidence,
            "score": h.score,
            "call_chain": chain_names(h.chain),
            "explanation": h.resolution_explanation,
        }
        for h in hits
    ]
    return json.dumps(rows, indent=2)


def as_markdown(hits: list[Row], target: str) -> str:
    out = [f"# Change impact of `{target}`", ""]
    if not hits:
        return "\n".join([*out, "> [!NOTE]", "> No affected tests found."])
    out += [f"Found **{len(hits)}** affected tests:", ""]
    for h in hits:
        chain = "\n> &darr;  \n> ".join(f"`{name}`" for name in chain_names(h.chain))
        out += [f"### Affected Test: `{h.test_file}::{short(h.test_function)}`", f"- **Reason**: {h.reason}", f"- **Confidence**: `{h.confidence}` (score: `{h.score:.4f}`)"]
        out += ["- **Call Chain**:", f"> {chain}", f"- **Explanation**: {h.resolution_explanation}", "", "---", ""]
    return "\n".join(out)


def as_text(hits: list[Row], target: str, chains: bool = True) -> str:
    if not hits:
        return f"No affected tests found for: {target}"
    out = [f"{len(hits)} affected tests for a change in {target}", ""]
    for h in hits:
        out += [f"{h.test_file}::{short(h.test_function)}  {h.confidence} ({h.score:.4f})", f"  {h.reason}"]
        if chains:
            out.append("  " + " -> ".join(chain_names(h.chain)))
        out += [f"  {h.resolution_explanation}", ""]
    return "\n".join(out)


def as_tool_content(hits: list[Row], target: str) -> dict:
    return {"content": [{"type": "text", "text": as_markdown(hits, target)}]}


def compact(hits: list[Row]) -> list[dict]:
    """Short keys, for answers to requests."""
    return [{"func": h.test_function, "file": h.test_file, "reason": h.reason, "conf": h.confidence, "score": h.score, "chain": chain_names(h.chain), "exp": h.resolution_explanation} for h in hits]
