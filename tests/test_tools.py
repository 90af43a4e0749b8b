"""Layout, settings, plug-ins, store, service, rendering, requests, command line and change stream."""

import io
import json
import os
import subprocess

import pytest
from pyspark.sql import Row

from impactgraph import plugins
from impactgraph.output import cli, render, requests
from impactgraph.plans import engine, store
from impactgraph.plans.service import Service
from impactgraph.sources import layout
from impactgraph.sources.settings import Settings
from impactgraph.streaming import changes


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


DEGREES = {
    "degrees.py": "def to_kelvin(c):\n    return c + 273.15\n\n\ndef to_rankine(c):\n    return to_kelvin(c) * 1.8\n",
    "test_degrees.py": "import degrees\n\n\ndef test_kelvin():\n    assert degrees.to_kelvin(0) > 273\n\n\ndef test_rankine():\n    assert degrees.to_rankine(1) > 400\n",
}
HIT = Row(target="a.f", test_function="tests.t.test_f", test_file="tests/t.py", chain=["module:a", "a.f", "tests.t.test_f"], depth=1, confidence="HIGH", score=1.0, explanation="e", reason="direct call", resolution_explanation="x")


def test_layout(tmp_path):
    for name in ("src", "lib/python", "other", "linked", "tests"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "pyproject.toml").write_text('[[tool.poetry.packages]]\ninclude = "a"\nfrom = "lib/python"\n[tool.setuptools.packages.find]\nwhere = ["other", "missing"]\n')
    (tmp_path / "x.pth").write_text("import os\n# no\nlinked\n/tmp\n")
    roots = layout.import_roots(str(tmp_path), {"PYTHONPATH": "/usr"})
    assert roots == ["lib/python", "lib", "linked", "other", "src"]
    assert layout.test_roots(str(tmp_path)) == ["tests"]
    found = layout.discovery(str(tmp_path))
    assert found.directories == ["tests", "test", "t", "spec"] and found.files == ["test_*.py", "*_test.py"]
    (tmp_path / "pyproject.toml").write_text("[broken")
    assert layout.project_roots(str(tmp_path)) == []


def test_settings(tmp_path):
    (tmp_path / ".impactgraph.toml").write_text('[general]\nmax_depth = 4\n[test_discovery]\nframework = "unittest"\nclass_patterns = ["Check*"]\n')
    found = Settings(str(tmp_path), {"IMPACTGRAPH_GENERAL_STRICT": "true", "IMPACTGRAPH_GENERAL_THRESHOLD": "x", "IMPACTGRAPH_A_B": "p, q"})
    assert found.value("general", "max_depth", 10) == 4 and found.value("general", "strict", False) is True
    assert found.value("general", "threshold", 7) == 7 and found.value("a", "b", []) == ["p", "q"] and found.value("no", "x", "y") == "y"
    own = layout.discovery(str(tmp_path), found)
    assert own.framework == "unittest" and own.classes == ["Check*"] and own.directories == ["tests"]
    (tmp_path / ".impactgraph.toml").write_text("[[[")
    assert Settings(str(tmp_path), {}).value("general", "max_depth", 10) == 10


def test_plugins():
    assert plugins.plugin("Django").pre_index(["venv"]) == ["build", "dist", "docs", "venv"]
    assert plugins.plugin(None).pre_index(["b", "a"]) == ["a", "b"]
    with pytest.raises(ValueError):
        plugins.plugin("nope")
    plugins.register(plugins.Plugin("mine", ["x"]))
    assert plugins.plugin("MINE").pre_index([]) == ["x"]
    del plugins.PLUGINS["mine"]


def test_rendering():
    told = json.loads(render.as_json([HIT]))[0]
    assert list(told) == ["test_function", "test_file", "reason", "confidence", "score", "call_chain", "explanation"]
    assert told["call_chain"] == ["f()", "test_f()"]
    text = render.as_markdown([HIT], "a.f")
    assert "`a.f`" in text and "- **Reason**: direct call" in text and "`f()`" in text and "- **Explanation**: x" in text
    assert "No affected tests" in render.as_markdown([], "a.f") and "No affected tests" in render.as_text([], "a.f")
    assert render.as_tool_content([HIT], "a.f")["content"][0]["type"] == "text"
    assert "f() -> test_f()" in render.as_text([HIT], "a.f") and "->" not in render.as_text([HIT], "a.f", chains=False)


def test_requests_and_command_line(spark, tmp_path, capsys):
    root = write(tmp_path / "degrees", DEGREES)
    service = Service(spark)
    ask = lambda method, **params: requests.answer(service, json.dumps({"id": 1, "method": method, "params": params}))
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == set(requests.TOOLS)
    assert ask("initialize")["result"]["capabilities"] == {"tools": {}}
    bad = requests.answer(service, "{no")
    assert bad["error"]["code"] == -32700 and bad["id"] is None
    assert ask("what")["error"]["code"] == -32601 and ask("tools/call", name="what")["error"]["code"] == -32601
    assert ask("tools/call", name="impact", arguments={"repo": root})["error"]["code"] == -32603
    found = ask("tools/call", name="impact", arguments={"repo": root, "function": "degrees.to_rankine"})
    told = json.loads(found["result"]["content"][0]["text"])
    assert [h["func"] for h in told] == ["test_degrees.test_rankine"] and found["result"]["diagnostics"]["files_indexed"] == 2
    told = service.suggest_files_to_update(root, "degrees.to_rankine")["files_to_review"]
    assert told == [{"path": "test_degrees.py", "reason": "tests to_rankine directly", "relationship": "transitive_test"}]
    told = service.explain_test(root, "test_degrees.test_kelvin")
    assert {d["target"] for d in told["depends_on"]} == {"degrees.to_kelvin"} and told["file"] == "test_degrees.py"
    assert "error" in service.explain_test(root, "no.such")
    told = service.analyze_diff(root, "+++ b/degrees.py\n@@ -6,1 +6,1 @@\n")
    assert told["changed_symbols"] == ["degrees.to_rankine"] and [h["func"] for h in told["affected_tests"]] == ["test_degrees.test_rankine"]
    assert service.analyze_diff(root, "") == {"changed_symbols": [], "affected_tests": []}
    out = io.StringIO()
    requests.serve(service, ["\n", '{"id": 2, "method": "tools/call", "params": {"name": "health"}}\n'], out)
    assert json.loads(json.loads(out.getvalue())["result"]["content"][0]["text"])["status"] == "healthy"
    capsys.readouterr()
    assert cli.main(["analyze", "degrees.to_rankine", "-r", root, "--format", "json", "--threshold", "0", "--strict"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["test_function"] == "test_degrees.test_rankine"
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    assert cli.main(["diff", "-r", root], spark) == 0 and "No modified symbols" in capsys.readouterr().out
    (tmp_path / "degrees" / "degrees.py").write_text(DEGREES["degrees.py"].replace("* 1.8", "/ 5 * 9"))
    assert cli.main(["diff", "-r", root, "--format", "markdown"], spark) == 0 and "test_rankine" in capsys.readouterr().out


def test_store_follows_the_tree(spark, tmp_path):
    root, folder = write(tmp_path / "tree", {"a.py": "def f():\n    pass\n", "b.py": "from a import f\n\n\ndef g():\n    f()\n"}), str(tmp_path / "index")
    _, nodes, edges, feed = store.update(spark, root, folder)
    assert feed.where("op = 'added' and id = 'a.f'").count() == 1
    assert store.update(spark, root, folder)[3].count() == 0
    before = store.current(folder)
    (tmp_path / "tree" / "a.py").write_text("def h():\n    pass\n")
    os.utime(tmp_path / "tree" / "a.py", (1, 1))
    (tmp_path / "tree" / "c.py").write_text("from b import g\n\n\ndef k():\n    g()\n")
    index, nodes, edges, feed = store.update(spark, root, folder)
    told = {(r.op, r.id or (r.src, r.dst)) for r in feed.collect()}
    assert {("removed", "a.f"), ("added", "a.h"), ("removed", ("b.g", "a.f")), ("added", ("c.k", "b.g"))} <= told
    fresh = engine.build_graph(engine.index_repository(spark, root))
    assert {tuple(r) for r in fresh[1].collect()} == {tuple(r) for r in edges.collect()}
    assert store.current(folder) != before
    (tmp_path / "tree" / "a.py").unlink()
    _, nodes, edges, feed = store.update(spark, root, folder)
    ids = {r.id for r in nodes.collect()}
    assert "a.h" not in ids and "module:a" not in ids and all(r.src in ids and r.dst in ids for r in edges.collect())
    (tmp_path / "index" / "CURRENT").write_text("{}")
    assert store.load(spark, folder) is None


def test_change_stream(spark, tmp_path):
    root, state, point, out = write(tmp_path / "tree", {"a.py": "", "pkg/__init__.py": ""}), str(tmp_path / "state"), str(tmp_path / "point"), str(tmp_path / "out")

    def run():
        query = changes.changes(spark, root, state).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.path, r.op) for r in spark.read.parquet(out).collect())

    assert run() == [("a.py", "added"), ("pkg/__init__.py", "added")]
    (tmp_path / "tree" / "a.py").unlink()
    os.utime(tmp_path / "tree" / "pkg" / "__init__.py", (5, 5))
    assert run()[-3:] == [("a.py", "deleted"), ("pkg/__init__.py", "added"), ("pkg/__init__.py", "modified")]
    reader = changes.ChangeReader({"path": root, "state": state})
    assert sorted(r[:2] for r in reader.readBetweenOffsets({"n": 1}, {"n": 2})) == [("a.py", "deleted"), ("pkg/__init__.py", "modified")]
