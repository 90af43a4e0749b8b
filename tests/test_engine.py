import random

import pytest
from pyspark.sql import functions as F

from impactgraph.operators import lookup, search
from impactgraph.plans import engine


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = write(
        tmp_path_factory.mktemp("shop"),
        {
            "money/__init__.py": "from money.parse import amount as read_amount\n",
            "money/parse.py": "def amount(text):\n    return int(text)\n\n\nclass Base:\n    def total(self):\n        return amount('1')\n",
            "bill.py": "from money import read_amount\nfrom money.parse import Base\n\n\nclass Bill(Base):\n    def run(self):\n        return self.total()\n\n\ndef make(text):\n    def inner():\n        return read_amount(text)\n    return inner()\n",
            "tests/test_bill.py": "from bill import make, Bill\n\n\ndef test_make():\n    assert make('3')\n\n\ndef test_run():\n    b = Bill()\n    b.run()\n",
            "broken.py": "def x(:\n",
        },
    )
    index = engine.index_repository(spark, root)
    return index, *engine.build_graph(index)


def test_index_has_symbols_and_init_files(shop):
    index, nodes, edges = shop
    ids = {r.unique_id for r in index.symbols.collect()}
    assert {"money.parse.amount", "money.parse.Base.total", "bill.Bill.run", "bill.make", "bill.make.inner"} <= ids
    assert index.modules.where("filepath = 'money/__init__.py'").first().module == "money"
    assert engine.summary(index).first().symbols_count == len(ids)


def test_calls_resolve_through_aliases_scopes_and_ancestors(shop):
    _, _, edges = shop
    got = {(r.src, r.dst): r.certainty for r in edges.where("relation = 'CALLS'").collect()}
    assert got["bill.make.inner", "money.parse.amount"] == 1.0
    assert ("bill.make", "bill.make.inner") in got
    assert got["bill.Bill.run", "money.parse.Base.total"] == 0.85
    assert got["tests.test_bill.test_run", "bill.Bill.run"] == 0.85
    assert edges.where("relation = 'INHERITS' and src = 'bill.Bill' and dst = 'money.parse.Base'").count() == 1
    assert edges.where("src = 'repo' and dst = 'pkg:money' and relation = 'OWNS'").count() == 1


def test_affected_tests_explain_suggest_and_diff(spark, shop):
    index, nodes, edges = shop
    hits = engine.affected_tests(nodes, edges, ["money.parse.amount", "no.such"]).collect()
    assert {h.test_function for h in hits} == {"tests.test_bill.test_make", "tests.test_bill.test_run"}
    chain = next(h for h in hits if h.test_function.endswith("test_make")).chain
    assert chain == ["money.parse.amount", "bill.make.inner", "bill.make", "tests.test_bill.test_make"]
    assert {r.target for r in engine.explain_test(edges, "tests.test_bill.test_run").collect()} == {"bill.Bill", "bill.Bill.run"}
    files = {r.file: r.priority for r in engine.suggest_files(nodes, edges, "money.parse.amount").collect()}
    assert files == {"bill.py": 1, "money/parse.py": 1, "tests/test_bill.py": 3}
    diff = spark.createDataFrame([("d", "+++ b/bill.py\n@@ -7 +7 @@\n")], "diff_id string, text string")
    assert [h.test_function for h in engine.analyze_diff(index, nodes, edges, diff).collect()] == ["tests.test_bill.test_run"]


def bare(spark, edges, tests):
    names = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(n, False, n in tests, None) for n in names], "id string, decorated boolean, is_test boolean, file string")
    forward = spark.createDataFrame([(b, a, None, None, None) for a, b in edges], "src string, dst string, relation string, certainty double, inheritance boolean")
    return nodes, forward


@pytest.mark.parametrize(
    "edges, depth, want",
    [
        ([("t", "helper"), ("helper", "test_f")], 10, {"test_f": (2, 0.9, "HIGH")}),
        ([("t", "test_f")], 10, {"test_f": (1, 1.0, "HIGH")}),
        ([("t", "a"), ("a", "b"), ("b", "test_f")], 10, {"test_f": (3, 0.81, "MEDIUM")}),
        ([("t", "a"), ("a", "b"), ("b", "test_f")], 2, {}),
        ([("t", "a"), ("a", "b"), ("b", "t"), ("b", "test_f")], 10, {"test_f": (3, 0.81, "MEDIUM")}),
        ([("t", "test_h"), ("test_h", "test_f")], 10, {"test_h": (1, 1.0, "HIGH")}),
    ],
)
def test_reverse_graphs(spark, edges, depth, want):
    nodes, forward = bare(spark, edges, {"test_f", "test_h"})
    target = spark.createDataFrame([("t",)], "node string")
    got = {h.test_function: (h.depth, h.score, h.confidence) for h in search.affected_tests(nodes, forward, target, depth).collect()}
    assert got == want


def test_search_reaches_what_plain_reachability_does():
    r = random.Random(1)
    for _ in range(100):
        names = [f"n{i}" for i in range(10)]
        edges = {n: sorted({(r.choice(names), r.choice([1.0, 0.9, 0.6]), r.random() < 0.2) for _ in range(r.randrange(4))}) for n in names}
        tests = set(r.sample(names[1:], 3))
        nodes = {n: {"dynamic": False, "decorated": False, "fan_out": 0, "is_test": n in tests, "file": None} for n in names}
        seen, queue = {"n0"}, ["n0"]
        while queue:
            n = queue.pop()
            for to, _, _ in edges[n] if n == "n0" or n not in tests else ():
                if to not in seen:
                    seen.add(to)
                    queue.append(to)
        assert {h["test_function"] for h in search.best_first("n0", edges, nodes, 20)} == (seen & tests) - {"n0"}


def test_scopes_tasks_and_star_excludes(spark, tmp_path):
    files = {
        "jobs.py": "from app import task\n\n\n@task\ndef send(x):\n    pass\n\n\ndef plain(x):\n    pass\n",
        "app.py": "def task(f):\n    return f\n",
        "run.py": "import jobs\nfrom jobs import send\n\n\ndef go():\n    send.delay(1)\n    jobs.plain.apply_async()\n",
        "scope.py": "def outer():\n    def helper():\n        pass\n    def inner():\n        helper()\n    helper()\n    inner()\n\n\ndef helper():\n    pass\n\n\ndef other():\n    def helper():\n        pass\n    def use():\n        global helper\n        helper()\n    use()\n",
        "wide.py": "__all__ = ['seen']\n\n\ndef seen():\n    pass\n\n\ndef hidden():\n    pass\n",
        "star.py": "from wide import *\n\n\ndef f():\n    seen()\n    hidden()\n",
    }
    index = engine.index_repository(spark, write(tmp_path, files))
    _, edges = engine.build_graph(index)
    got = {(r.src, r.dst): r.certainty for r in edges.where("relation = 'CALLS'").collect()}
    assert got["run.go", "jobs.send"] == 0.95 and got["run.go", "jobs.plain"] == 0.90
    assert got["scope.outer", "scope.outer.helper"] == 0.98 and got["scope.outer.inner", "scope.outer.helper"] == 0.95
    assert got["scope.other.use", "scope.helper"] == 0.95 and ("scope.other.use", "scope.other.helper") not in got
    assert got["star.f", "wide.seen"] == 1.0 and ("star.f", "wide.hidden") not in got


def test_chains_of_stars_scopes_types_and_rings(spark, tmp_path):
    files = {f"s{i}.py": f"from s{i + 1} import *\n" for i in range(13)} | {"s13.py": "def deep():\n    pass\n", "user.py": "from s0 import *\n\n\ndef go():\n    deep()\n"}
    files["two.py"] = "def pick():\n    pass\n"
    files["one.py"] = "def pick():\n    pass\n"
    files["both.py"] = "from two import *\nfrom one import *\n\n\ndef f():\n    pick()\n"
    nest = "def top():\n    pass\n"
    pad = ""
    for i in range(8):
        nest += f"{pad}def n{i}():\n"
        pad += "    "
        nest += f"{pad}def near{i}():\n{pad}    pass\n"
    files["nest.py"] = nest + f"{pad}near0()\n"
    files["ring_a.py"] = "from ring_b import x\n\n\ndef f():\n    x()\n"
    files["ring_b.py"] = "from ring_a import x\n"
    files["types.py"] = "class Inner:\n    def act(self):\n        pass\n\n\nclass Outer:\n    class Part:\n        def act(self):\n            pass\n\n\ndef f(o: Outer):\n    p = o.Part()\n    p.act()\n\n\ndef g(s):\n    s = s.strip()\n    s.act()\n"
    files["hub/__init__.py"] = "from hub.impl import work as labour\n"
    files["hub/impl.py"] = "def work():\n    pass\n"
    files["far.py"] = "import hub\n\n\ndef f():\n    hub.labour()\n"
    index = engine.index_repository(spark, write(tmp_path, files))
    _, edges = engine.build_graph(index)
    got = {(r.src, r.dst): r.certainty for r in edges.where("relation = 'CALLS' and not contains(src, ':dyn:')").collect()}
    assert got["user.go", "s13.deep"] == 1.0
    assert got["both.f", "two.pick"] == 1.0 and ("both.f", "one.pick") not in got
    assert got["nest.n0.n1.n2.n3.n4.n5.n6.n7", "nest.n0.near0"] == 0.95
    assert not [k for k in got if k[0] == "ring_a.f"]
    assert got["types.f", "types.Outer.Part.act"] == 0.85 and not [k for k in got if k[0] == "types.g"]
    assert got["far.f", "hub.impl.work"] == 1.0


def test_chase_ends_cycles(spark):
    from impactgraph.operators.reach import chase

    links = {"a": "b", "b": "c", "c": "a", "t": "u", "u": "a", "x": "y", "y": "x", "l": "m", "m": "n", "s": "s"}
    got = {r.key: r.root for r in chase(spark.createDataFrame(list(links.items()), "key string, next string")).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "t": "a", "u": "a", "x": "x", "y": "y", "l": "n", "m": "n", "s": "s"}


def test_names_of_calls():
    from impactgraph.parse import python_source

    text = "import importlib\n\n\ndef f(cb):\n    make().save(); 'x'.join(a); rows[0].load(); super().go(); cb(); importlib.import_module('x'); (lambda: 1)(); functools.partial(f)\n"
    calls = python_source.parse("m.py", text, "m", False)[0][0]["calls"]
    kinds = [c if not c.startswith("dynamic:") else c.split(":")[1] for c in calls]
    assert kinds == ["save", "make", "join", "load", "super.go", "super", "runtime_dispatch", "import_module", "lambda", "partial"]
    assert python_source.parse("m.py", "__all__ = ['a', b]\n", "m", False)[3] is None


def test_bare_names_find_keys_of_files(spark):
    keys = spark.createDataFrame([("utils/dates.py:Clock.now",), ("app/time.py:now",), ("app/time.py:now",), ("now",), ("a:b/c.py:later",), ("app/time.py:nower",), (None,)], "key string")
    names = spark.createDataFrame([("now",), ("now",), ("later",), ("missing",), (None,)], "name string")
    found = sorted(map(tuple, lookup.bare_keys(names, keys).collect()))
    assert found == [("later", "a:b/c.py:later"), ("now", "app/time.py:now"), ("now", "utils/dates.py:Clock.now")]
    assert lookup.bare_keys(names, keys.limit(0)).isEmpty()
