"""The engine run over generated source files, one set of files a part, with the rows that are due listed by hand.

@K stands for a part's key and @G for its size modulo 5, in the files as in the due rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ONCE = {
    "shop/base.py": "".join(f"class Root{g}:\n    def shared(self):\n        pass\n\n\n" for g in range(5)),
    "shop/tools.py": "def fix():\n    pass\n\n\ndef save():\n    pass\n",
    "shop/listed.py": "__all__ = ['seen']\n\n\ndef seen():\n    pass\n\n\ndef hidden():\n    pass\n",
}
EACH = {
    "shop/p@K.py": """import shop.tools as tools
from shop.base import Root@G


def leaf@K():
    pass


class Item@K(Root@G):
    def own(self):
        return make().save()

    @staticmethod
    def _quiet():
        "".join([]); rows[0].load()

    async def run(self):
        self.own()
        self.shared()

    def up(self):
        super().shared()
        tools.fix()
        leaf@K()


def outer():
    def inner():
        leaf@K()
    def other():
        inner()
    inner()
    other()


def typed(x: Item@K):
    x.own()
    y = x.own()
    leaf@K.delay()
    getattr(x, "a")


def direct():
    Item@K.own(None)
    rare@K()
""",
    "shop/rare/r@K.py": "def rare@K():\n    pass\n",
    "shop/s@K.py": "from shop.listed import *\n\n\ndef use():\n    seen()\n    hidden()\n",
    "tests/test_p@K.py": "from shop.p@K import direct\n\n\ndef test_it():\n    direct()\n",
}
BRACES = {
    "web/t@K.ts": """import { fix as mend } from './tools';

export abstract class Sub@K extends Base@G implements Shape {
  private static async load(x: number): Promise<void> { this.run(); mend(x); }
  run() { return super.base().next(); } // no()
}
const arrow@K = (x: number): void => { inner@K("no()"); };
export async function go@K<T>(x: T) { new Sub@K().run(); }
""",
    "srv/g@K.go": """package g@K
import str "strings"
type Outer struct {
    *Inner
    Name string
}
func (s *Outer) Handle(w int) { str.Trim(make(w)) }
func quiet() {}
""",
    "jv/J@K.java": """package com.j@K;
import com.util.Parser;
public class Dog extends Animal<String> implements Pet {
    @Override
    public static Map<String, X> format(String s) { return Parser.parse(s).trim(); }
    protected abstract void help();
}
""",
    "rs/r@K.rs": """use crate::io::{Read, Write as W};
pub struct Server { port: u16 }
impl<'a, T> Handler for Server {
    pub async fn listen(&self) { go(); }
}
fn helper() {}
""",
}

# (unique_id, kind, visibility, async_sync, method_kind, class_name, parent_id, bases, calls, line_no, end_line_no)
PYTHON_SYMBOLS = [
    ("shop.p@K.leaf@K", "function", "public", "sync", None, None, None, None, "", 5, 6),
    ("shop.p@K.Item@K", "class", "public", None, None, None, None, "Root@G", None, 9, 24),
    ("shop.p@K.Item@K.own", "method", "public", "sync", "instance", "Item@K", None, None, "save,make", 10, 11),
    ("shop.p@K.Item@K._quiet", "method", "private", "sync", "static", "Item@K", None, None, "join,load", 14, 15),
    ("shop.p@K.Item@K.run", "method", "public", "async", "instance", "Item@K", None, None, "self.own,self.shared", 17, 19),
    ("shop.p@K.Item@K.up", "method", "public", "sync", "instance", "Item@K", None, None, "super.shared,super,tools.fix,leaf@K", 21, 24),
    ("shop.p@K.outer", "function", "public", "sync", None, None, None, None, "inner,other", 27, 33),
    ("shop.p@K.outer.inner", "function", "public", "sync", None, None, "shop.p@K.outer", None, "leaf@K", 28, 29),
    ("shop.p@K.outer.other", "function", "public", "sync", None, None, "shop.p@K.outer", None, "inner", 30, 31),
    ("shop.p@K.typed", "function", "public", "sync", None, None, None, None, "x.own,x.own,leaf@K.delay,dynamic:getattr:40:4", 36, 40),
    ("shop.p@K.direct", "function", "public", "sync", None, None, None, None, "Item@K.own,rare@K", 43, 45),
]
BRACE_SYMBOLS = [
    ("web.t@K.Sub@K", "class", "public", None, None, None, None, "Base@G,Shape", None, 3, 6),
    ("web.t@K.Sub@K.load", "method", "private", "async", "static", "Sub@K", None, None, "this.run,mend", 4, 4),
    ("web.t@K.Sub@K.run", "method", "public", "sync", "instance", "Sub@K", None, None, "super.base,next", 5, 5),
    ("web.t@K.arrow@K", "function", "public", "sync", None, None, None, None, "inner@K", 7, 7),
    ("web.t@K.go@K", "function", "public", "async", None, None, None, None, "Sub@K,run", 8, 8),
    ("g@K.Outer", "class", "public", None, None, None, None, "Inner", None, 3, 6),
    ("g@K.Outer.Handle", "method", "public", "sync", "instance", "Outer", None, None, "str.Trim,make", 7, 7),
    ("g@K.quiet", "function", "private", "sync", None, None, None, None, "", 8, 8),
    ("com.j@K.Dog", "class", "public", None, None, None, None, "Animal,Pet", None, 3, 7),
    ("com.j@K.Dog.format", "method", "public", "sync", "static", "Dog", None, None, "Parser.parse,trim", 5, 5),
    ("com.j@K.Dog.help", "method", "private", "sync", "abstract", "Dog", None, None, "", 6, 6),
    ("rs.r@K.Server", "class", "public", None, None, None, None, None, None, 2, 2),
    ("rs.r@K.Server.listen", "method", "public", "async", "instance", "Server", None, None, None, 4, 4),
    ("rs.r@K.helper", "function", "private", "sync", None, None, None, None, None, 6, 6),
]
SYMBOL_COLUMNS = ["unique_id", "kind", "visibility", "async_sync", "method_kind", "class_name", "parent_id", "bases", "calls", "line_no", "end_line_no"]
# (file, local_name, fqn)
IMPORT_ROWS = [
    ("shop/p@K.py", "tools", "shop.tools"), ("shop/p@K.py", "Root@G", "shop.base.Root@G"), ("tests/test_p@K.py", "direct", "shop.p@K.direct"),
    ("web/t@K.ts", "mend", "web.tools.fix"), ("srv/g@K.go", "str", "strings"), ("jv/J@K.java", "Parser", "com.util.Parser"),
    ("rs/r@K.rs", "Read", "crate::io::Read"), ("rs/r@K.rs", "W", "crate::io::Write"),
]
# (src, dst, relation, certainty, inheritance); every rule by which a call finds its target is among them.
EDGE_ROWS = [
    ("shop.p@K.Item@K.own", "shop.tools.save", "CALLS", 0.60, False),
    ("shop.p@K.Item@K.run", "shop.p@K.Item@K.own", "CALLS", 0.85, False),
    ("shop.p@K.Item@K.run", "shop.base.Root@G.shared", "CALLS", 0.85, True),
    ("shop.p@K.Item@K.up", "shop.base.Root@G.shared", "CALLS", 0.95, True),
    ("shop.p@K.Item@K.up", "shop.tools.fix", "CALLS", 1.0, False),
    ("shop.p@K.Item@K.up", "shop.p@K.leaf@K", "CALLS", 0.90, False),
    ("shop.p@K.outer", "shop.p@K.outer.inner", "CALLS", 0.98, False),
    ("shop.p@K.outer", "shop.p@K.outer.other", "CALLS", 0.98, False),
    ("shop.p@K.outer.other", "shop.p@K.outer.inner", "CALLS", 0.95, False),
    ("shop.p@K.outer.inner", "shop.p@K.leaf@K", "CALLS", 0.90, False),
    ("shop.p@K.typed", "shop.p@K.Item@K.own", "CALLS", 0.85, False),
    ("shop.p@K.typed", "shop.p@K.leaf@K", "CALLS", 0.90, False),
    ("shop.p@K.direct", "shop.p@K.Item@K.own", "CALLS", 0.90, False),
    ("shop.p@K.direct", "shop.rare.r@K.rare@K", "CALLS", 0.60, False),
    ("shop.s@K.use", "shop.listed.seen", "CALLS", 1.0, False),
    ("tests.test_p@K.test_it", "shop.p@K.direct", "CALLS", 1.0, False),
    ("shop.p@K.typed", "shop.p@K.typed:dyn:getattr:40:4", "CALLS", 0.30, False),
    *[("shop.p@K.typed:dyn:getattr:40:4", s[0], "CALLS", 0.30, False) for s in PYTHON_SYMBOLS if s[1] != "class"],
    ("shop.p@K.Item@K", "shop.base.Root@G", "INHERITS", None, None),
    ("module:shop.p@K", "module:shop.tools", "IMPORTS", None, None),
    ("module:shop.p@K", "shop.base.Root@G", "IMPORTS", None, None),
    ("module:shop.s@K", "shop.listed.seen", "IMPORTS", None, None),
    ("module:tests.test_p@K", "shop.p@K.direct", "IMPORTS", None, None),
    *[("pkg:shop", f"module:shop.{m}@K", "OWNS", None, None) for m in "ps"],
    ("pkg:shop.rare", "module:shop.rare.r@K", "OWNS", None, None),
    ("pkg:tests", "module:tests.test_p@K", "OWNS", None, None),
    ("module:shop.rare.r@K", "shop.rare.r@K.rare@K", "OWNS", None, None),
    ("module:shop.s@K", "shop.s@K.use", "OWNS", None, None),
    ("module:tests.test_p@K", "tests.test_p@K.test_it", "OWNS", None, None),
    *[(s[6] or (f"shop.p@K.{s[5]}" if s[5] else "module:shop.p@K"), s[0], "OWNS", None, None) for s in PYTHON_SYMBOLS],
]
FIXED_EDGES = [
    ("repo", "pkg:shop", "OWNS"), ("repo", "pkg:tests", "OWNS"), ("pkg:shop", "pkg:shop.rare", "OWNS"),
    *[("pkg:shop", f"module:shop.{m}", "OWNS") for m in ("base", "tools", "listed")],
    *[(f"module:shop.{m}", f"shop.{m}.{f}", "OWNS") for m, f in (("tools", "fix"), ("tools", "save"), ("listed", "seen"), ("listed", "hidden"))],
    *[("module:shop.base", f"shop.base.Root{g}", "OWNS") for g in range(5)], *[(f"shop.base.Root{g}", f"shop.base.Root{g}.shared", "OWNS") for g in range(5)],
]


def filled(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("@K"), F.col("p_partkey").cast("string")), F.lit("@G"), (F.col("p_size") % 5).cast("string"))


def sources(spark: SparkSession, d: str, each: dict[str, str], once: dict[str, str] | None = None) -> DataFrame:
    """(rel_path, content): every file of each for every part, and those of once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(x).alias("text")) for p, x in each.items()])).alias("f")
    out = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", pairs).select(filled(F.col("f.path")).alias("rel_path"), filled(F.col("f.text")).alias("content"))
    return out.unionByName(spark.createDataFrame(list(once.items()), "rel_path string, content string")) if once else out


def quoted(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else f"{value}::DOUBLE" if isinstance(value, float) else f"{value}::BOOLEAN" if isinstance(value, bool) else f"{value}::INTEGER"


def due(rows: list[tuple], columns: list[str], texts: int) -> str:
    """SQL for rows with the placeholders of their first texts columns filled in for every part."""
    values = ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)
    fill = [f"replace(replace({c}, '@K', CAST(p_partkey AS VARCHAR)), '@G', CAST(p_size % 5 AS VARCHAR)) AS {c}" if i < texts else c for i, c in enumerate(columns)]
    return f"SELECT {', '.join(fill)} FROM part, (VALUES {values}) AS v({', '.join(columns)})"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def symbol_rows(index: engine.Index) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return index.symbols.select(*[joined(c) if c in ("bases", "calls") else F.col(c) for c in SYMBOL_COLUMNS])


@query(due(PYTHON_SYMBOLS, SYMBOL_COLUMNS, 9))
def parse_python_symbols(spark, d):
    return symbol_rows(engine.index_files(sources(spark, d, {"shop/p@K.py": EACH["shop/p@K.py"]})))


@query(due(BRACE_SYMBOLS, SYMBOL_COLUMNS, 9))
def parse_brace_symbols(spark, d):
    return symbol_rows(engine.index_files(sources(spark, d, BRACES)))


@query(due(IMPORT_ROWS, ["file", "local_name", "fqn"], 3))
def parse_imports(spark, d):
    return engine.index_files(sources(spark, d, EACH | BRACES)).imports.select("file", "local_name", "fqn")


@query("SELECT n * 14 + 14 AS symbols_count, n * 13 + 9 AS functions_count, n * 23 AS calls_count, n * 2 AS imports_count, 'ok' AS status FROM (SELECT count(*) AS n FROM part)")
def index_summary(spark, d):
    return engine.summary(engine.index_files(sources(spark, d, EACH, ONCE)))


_EDGES = ["src", "dst", "relation", "certainty", "inheritance"]


@query(due(EDGE_ROWS, _EDGES, 2) + " UNION ALL SELECT src, dst, relation, NULL, NULL FROM (VALUES " + ", ".join(f"({', '.join(map(quoted, r))})" for r in FIXED_EDGES) + ") AS v(src, dst, relation)")
def graph_edges(spark, d):
    return engine.build_graph(engine.index_files(sources(spark, d, EACH, ONCE)))[1].select(*_EDGES)


@query(due([("shop.rare.r@K.rare@K", "tests.test_p@K.test_it", "shop.rare.r@K.rare@K shop.p@K.direct tests.test_p@K.test_it", 2, 0.324, "LOW")], ["target", "test_function", "chain", "depth", "score", "confidence"], 3))
def impact_sources(spark, d):
    """The whole way, from files to the tests that a change of each part's rare function can reach."""
    nodes, edges = engine.build_graph(engine.index_files(sources(spark, d, EACH, ONCE)))
    targets = nodes.where(F.col("id").startswith("shop.rare.") & (F.col("kind") == "function")).select(F.col("id").alias("node"))
    found = engine.search.affected_tests(nodes, edges, targets)
    return found.select("target", "test_function", F.array_join("chain", " ").alias("chain"), "depth", "score", "confidence")
