"""Exact best-first search for affected tests, one target a group, on the subgraph that it reaches.

Path state folds along a path (any, least, most, mean), so a node is settled by the first, best
path that pops; ties go to the smaller depth, then node, then chain.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score as S
from ..schemas import HITS
from . import graph, reach


def told_state(depth: int, state: dict) -> tuple:
    """A path's state as the score takes it."""
    mean = state["sum"] / state["count"] if state["count"] else 1.0
    return depth, state["dynamic"], state["inherited"], mean, state["ambiguous"], state["least"], state["decorated"], state["fan_out"]


def path_score(depth: int, state: dict) -> float:
    """The rounded product of all factors."""
    return max(0.0, min(1.0, round(S.confidence(*told_state(depth, state), pick=S.plain), 4)))


def told(depth: int, state: dict) -> tuple[str, str, str]:
    """(summary, reason, details) of a path; symbol certainties are only spoken of where they are weak."""
    bears = {name: factor for name, factor in S.factors(*told_state(depth, state), pick=S.plain) if factor < (S.WEAK_SYMBOLS if name == "symbols" else 1)}
    if depth < 2:
        bears = {"direct": 1.0} | bears
    level = next((text for least, text in sorted(S.FAN_OUT_LEVELS.items(), reverse=True) if state["fan_out"] >= least), "")
    values = {"depth": depth, "percent": int(state["least"] * 100), "level": level, "fan_out": state["fan_out"]}
    reason = ", ".join(S.TEXTS[name][0].format(factor=factor, **values) for name, factor in bears.items())
    details = " ".join(S.TEXTS[name][1].format(factor=factor, **values) for name, factor in bears.items())
    return S.SUMMARIES[depth >= 2].format(depth=depth, reason=reason), reason, details


def best_first(target: str, edges: dict[str, list[tuple[str, float, bool]]], nodes: dict[str, dict], max_depth: int) -> list[dict]:
    """Hits of one target over reverse call edges; tests are recorded and not passed."""

    def at(node: str) -> dict:
        return nodes.get(node, {"dynamic": ":dyn:" in node, "decorated": False, "fan_out": 0, "is_test": False, "file": None})

    own = at(target)
    state = {"dynamic": own["dynamic"], "inherited": False, "sum": 0.0, "count": 0, "ambiguous": False, "least": 1.0, "decorated": own["decorated"], "fan_out": own["fan_out"]}
    heap = [(-1.0, 0, target, (target,), 0)]
    states = [state]
    best: dict[str, float] = {target: 1.0}
    settled: set[str] = set()
    hits = []
    while heap:
        minus, depth, node, chain, key = heapq.heappop(heap)
        if node in settled:
            continue
        settled.add(node)
        if depth > max_depth:
            continue
        state = states[key]
        if node != target and at(node)["is_test"]:
            value = path_score(depth, state)
            summary, reason, details = told(depth, state)
            hits.append({"target": target, "test_function": node, "test_file": at(node)["file"], "chain": list(chain), "depth": depth, "confidence": S.label(value, S.plain), "score": value, "explanation": summary, "reason": reason, "resolution_explanation": details})
            continue
        for after, sure, inherited in edges.get(node, ()):
            if after in settled:
                continue
            x = at(after)
            known = sure in S.SYMBOL_CERTAINTIES
            new = {
                "dynamic": state["dynamic"] or x["dynamic"],
                "inherited": state["inherited"] or inherited,
                "sum": state["sum"] + sure * known,
                "count": state["count"] + known,
                "ambiguous": state["ambiguous"] or sure == S.AMBIGUOUS_CERTAINTY,
                "least": min(state["least"], sure),
                "decorated": state["decorated"] or x["decorated"],
                "fan_out": max(state["fan_out"], x["fan_out"]),
            }
            value = path_score(depth + 1, new)
            if value >= best.get(after, -1.0):
                best[after] = value
                states.append(new)
                heapq.heappush(heap, (-value, depth + 1, after, (*chain, after), len(states) - 1))
    return sorted(hits, key=lambda h: (-h["score"], h["test_function"]))


def affected_tests(nodes: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """Hits of each target(node). nodes(id, decorated, is_test, file); edges forward, with relation and certainty.

    Reachability is found level by level over all targets; only edges inside a target's reach go to
    its search, which is one group (its size is the reach of one symbol).
    """
    calls = graph.collapse_parallel(edges)
    back = graph.reverse(calls)
    tests = nodes.where("is_test").select(F.col("id").alias("node"))
    near = reach.reach(back, targets, max_depth + 1, tests).select("target", "node")
    info = nodes.select("id", "decorated", "is_test", "file").join(graph.fan_out(nodes, edges), "id")
    rows = near.join(back.withColumnRenamed("src", "node"), "node", "left").join(info.withColumnRenamed("id", "node"), "node", "left")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        target = group["target"].iloc[0]
        links: dict[str, list] = {}
        known: dict[str, dict] = {}
        for r in group.itertuples(index=False):
            known[r.node] = {"dynamic": ":dyn:" in r.node, "decorated": r.decorated is True, "fan_out": 0 if pd.isna(r.fan_out) else int(r.fan_out), "is_test": r.is_test is True, "file": r.file}
            if isinstance(r.dst, str):
                links.setdefault(r.node, []).append((r.dst, float(r.certainty), bool(r.inheritance)))
        for out in links.values():
            out.sort()
        columns = [c.split()[0] for c in HITS.split(", ")]
        return pd.DataFrame(best_first(target, links, known, max_depth), columns=columns)

    return rows.groupBy("target").applyInPandas(search, HITS)
