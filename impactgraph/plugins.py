"""Framework plug-ins: what to leave out, and hooks on the index and the graph, as DataFrame transforms."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Plugin:
    """Subclass and register to change rows; each hook returns what the engine goes on with."""

    name: str = "base"
    leave_out: list[str] = field(default_factory=list)

    def pre_index(self, exclude: list[str]) -> list[str]:
        return sorted({*exclude, *self.leave_out})

    def post_index(self, symbols: DataFrame) -> DataFrame:
        return symbols

    def post_graph(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        return nodes, edges


class CountingSymbols(Plugin):
    def post_index(self, symbols: DataFrame) -> DataFrame:
        print(f"[{self.name}] definitions: {symbols.count()}", file=sys.stderr)
        return symbols


class CountingGraph(Plugin):
    def post_graph(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        print(f"[{self.name}] nodes: {nodes.count()}, edges: {edges.count()}", file=sys.stderr)
        return nodes, edges


# What each framework leaves out.
PLUGINS: dict[str, Plugin] = {
    "django": CountingSymbols("django", ["docs", "build", "dist"]),
    "flask": CountingGraph("flask", ["tests", "docs", "examples"]),
    "requests": Plugin("requests", ["tests", "docs", "build", "dist"]),
}


def register(plugin: Plugin) -> None:
    PLUGINS[plugin.name.lower()] = plugin


def plugin(name: str | None) -> Plugin:
    """The plug-in of a name in any case; none changes nothing, an unknown one raises ValueError."""
    if not name:
        return Plugin()
    if name.lower() not in PLUGINS:
        raise ValueError(f"unknown framework plug-in: {name}")
    return PLUGINS[name.lower()]
