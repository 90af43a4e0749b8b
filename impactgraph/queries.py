"""The engine's operators applied to the driver's tables read as a property graph, with the same in SQL.

part <- order (through lineitem) <- customer <- nation <- region; customers of the BUILDING segment
stand for tests; l_returnflag gives an edge's certainty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import source_queries
from .functions import names, score
from .operators import delta, graph, lookup, reach, resolve, search
from .plans import engine
from .sources.diff_text import changed_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def certainty() -> Column:
    return F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "A", 0.90).otherwise(0.60)


def call_edges(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """Order calls part, parallel edges kept; more are further columns."""
    return t(spark, d, "lineitem").select(node_id("order", "l_orderkey").alias("src"), node_id("part", "l_partkey").alias("dst"), F.lit("CALLS").alias("relation"), certainty().alias("certainty"), (F.col("l_linestatus") == "O").alias("inheritance"), F.col("l_linenumber").alias("ord"), *more)


def reverse_links(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst) from part to all that depend on it."""
    pairs = [
        t(spark, d, "lineitem").select(node_id("part", "l_partkey").alias("src"), node_id("order", "l_orderkey").alias("dst")).distinct(),
        t(spark, d, "orders").select(node_id("order", "o_orderkey").alias("src"), node_id("customer", "o_custkey").alias("dst")),
        t(spark, d, "customer").select(node_id("customer", "c_custkey").alias("src"), node_id("nation", "c_nationkey").alias("dst")),
        t(spark, d, "nation").select(node_id("nation", "n_nationkey").alias("src"), node_id("region", "n_regionkey").alias("dst")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


LINKS_SQL = """links AS (
    SELECT DISTINCT 'part:' || l_partkey AS src, 'order:' || l_orderkey AS dst FROM lineitem
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""
CALLS_SQL = """calls AS (
    SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst,
           CASE l_returnflag WHEN 'N' THEN 1.0::DOUBLE WHEN 'A' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS certainty,
           l_linestatus = 'O' AS inheritance, l_linenumber AS ord FROM lineitem)"""


@query("SELECT doc_id, source, lang FROM documents WHERE source NOT IN ('src0', 'src3') AND NOT list_has_any(string_split(source || '/' || lang, '/'), ['de'])")
def scan_filter_exclude(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.where(~names.excluded(F.concat_ws("/", "source", "lang"), ["src0", "src3", "de"]))


HOST = r"^[a-z]+://([^/?#]+)"


@query("""WITH h AS (SELECT DISTINCT string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.') AS p FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) <> ''),
    s AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM h)
    SELECT DISTINCT CASE WHEN i = 1 THEN 'repo' ELSE 'pkg:' || array_to_string(p[1:i-1], '.') END AS src,
      CASE WHEN i = len(p) THEN 'module:' ELSE 'pkg:' END || array_to_string(p[1:i], '.') AS dst FROM s""")
def prefix_explode(spark, d):
    return graph.hierarchy(t(spark, d, "pages").select(F.regexp_extract("url", HOST, 1).alias("module")))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS name FROM pages),
    k AS (SELECT DISTINCT array_to_string(string_split(name, '.')[1:2], '.') AS prefix FROM h WHERE page_id % 3 = 0),
    m AS (SELECT page_id, max_by(prefix, length(prefix)) AS prefix FROM h JOIN k ON name = prefix OR starts_with(name, prefix || '.') GROUP BY page_id)
    SELECT h.page_id, name, m.prefix, CASE WHEN length(name) > length(m.prefix) THEN substring(name, length(m.prefix) + 2) END AS rest FROM h LEFT JOIN m USING (page_id)""")
def longest_prefix_match(spark, d):
    hosts = t(spark, d, "pages").select("page_id", F.regexp_extract("url", HOST, 1).alias("name"))
    known = hosts.where("page_id % 3 = 0").select(F.array_join(F.slice(F.split("name", "[.]"), 1, 2), ".").alias("prefix"))
    return lookup.longest_prefix(hosts, known)


@query(f"WITH {CALLS_SQL} SELECT src, dst, certainty FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS n FROM calls) WHERE n = 1")
def calls_edges_dedup(spark, d):
    """Of calls with the same line number, which the SQL leaves open, the one that stands first in the table; without a number last."""
    calls = call_edges(spark, d, F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    ranked = calls.select("src", "dst", "ord", "place", "certainty")  # columns count in this order
    return lookup.merge_best(ranked, ["src", "dst"], [F.col("ord").isNull()]).select("src", "dst", "certainty")


@query("""SELECT 'order:' || l_orderkey AS src, 'supplier:' || l_suppkey AS dst,
    min(CASE l_returnflag WHEN 'N' THEN 1.0::DOUBLE WHEN 'A' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END) AS certainty, bool_or(l_linestatus = 'O') AS inheritance
    FROM lineitem GROUP BY ALL""")
def parallel_edge_collapse(spark, d):
    edges = t(spark, d, "lineitem").select(node_id("order", "l_orderkey").alias("src"), node_id("supplier", "l_suppkey").alias("dst"), F.lit("CALLS").alias("relation"), certainty().alias("certainty"), (F.col("l_linestatus") == "O").alias("inheritance"))
    return graph.collapse_parallel(edges)


@query(f"WITH {CALLS_SQL} SELECT dst AS src, src AS dst, certainty FROM calls")
def reverse_edges(spark, d):
    return graph.reverse(call_edges(spark, d)).select("src", "dst", "certainty")


@query("SELECT 'order:' || o_orderkey AS id, count(l_orderkey) AS fan_out FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def fan_out(spark, d):
    return graph.fan_out(t(spark, d, "orders").select(node_id("order", "o_orderkey").alias("id")), call_edges(spark, d))


@query("""WITH f AS (SELECT 'order:' || o_orderkey AS id, count(l_orderkey) AS fan_out FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT id, CASE WHEN fan_out >= 10 THEN 0.65::DOUBLE WHEN fan_out >= 6 THEN 0.8::DOUBLE WHEN fan_out >= 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM f""")
def fan_out_bucket(spark, d):
    return fan_out(spark, d).select("id", score.fan_out_factor(F.col("fan_out")).alias("factor"))


@query("""WITH e AS (SELECT *, user_id || '/' || strftime(ts, '%Y-%m-%d') AS module FROM events),
    n AS (SELECT DISTINCT module, module || ':dyn:' || event_type || ':' || event_id || ':0' AS id FROM e WHERE event_type = 'error')
    SELECT n.id AS src, 'event:' || e.event_id AS dst, 0.3::DOUBLE AS certainty FROM n JOIN e USING (module) WHERE event_type <> 'error'""")
def dynamic_fanout(spark, d):
    events = t(spark, d, "events").withColumn("module", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    sites = events.where("event_type = 'error'").select(F.col("module").alias("caller"), "module", F.lit("f").alias("filepath"), F.concat_ws(":", F.lit("dynamic"), "event_type", F.col("event_id").cast("string"), F.lit("0")).alias("tag"))
    members = events.where("event_type <> 'error'").select("module", node_id("event", "event_id").alias("id"))
    return graph.dynamic_calls(sites, members)[1].where(F.col("src").contains(":dyn:"))


def _reach_sql(targets: str, depth: int, stop: str = "") -> str:
    return f"""WITH RECURSIVE {LINKS_SQL}, r AS (
        SELECT node AS target, node, 0 AS depth FROM ({targets})
        UNION SELECT r.target, links.dst, r.depth + 1 FROM r JOIN links ON r.node = links.src WHERE r.depth < {depth} {stop})
        SELECT target, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL"""


@query(_reach_sql("SELECT 'part:1' AS node", 10))
def reach_single(spark, d):
    return reach.reach(reverse_links(spark, d), spark.createDataFrame([("part:1",)], "node string"))


@query(_reach_sql("SELECT 'part:' || p_partkey AS node FROM part WHERE p_size = 7", 10))
def reach_multi(spark, d):
    return reach.reach(reverse_links(spark, d), t(spark, d, "part").where("p_size = 7").select(node_id("part", "p_partkey").alias("node")))


@query(_reach_sql("SELECT 'part:' || p_partkey AS node FROM part WHERE p_size = 7", 2))
def reach_depth_limit(spark, d):
    return reach.reach(reverse_links(spark, d), t(spark, d, "part").where("p_size = 7").select(node_id("part", "p_partkey").alias("node")), 2)


CYCLE_SQL = """links AS (SELECT DISTINCT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events QUALIFY dst IS NOT NULL)"""


@query(f"""WITH RECURSIVE {CYCLE_SQL}, r AS (SELECT 'view' AS target, 'view' AS node, 0 AS depth
    UNION SELECT target, dst, depth + 1 FROM r JOIN links ON node = src WHERE depth < 10)
    SELECT target, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL""")
def reach_cycle(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    links = t(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null").distinct()
    return reach.reach(links, spark.createDataFrame([("view",)], "node string"))


_HITS_SQL = f"""WITH {CALLS_SQL}, pair AS (SELECT src, dst, min(certainty) AS certainty, bool_or(inheritance) AS inheritance FROM calls GROUP BY ALL),
    fan AS (SELECT src, count(*) AS n FROM calls GROUP BY 1),
    path AS (SELECT pair.dst AS target, 'customer:' || o_custkey AS test, certainty, inheritance, fan.n AS fan_out
        FROM pair JOIN fan USING (src) JOIN orders ON pair.src = 'order:' || o_orderkey JOIN customer ON c_custkey = o_custkey
        WHERE c_mktsegment = 'BUILDING'),
    scored AS (SELECT target, test, 0.9::DOUBLE * CASE WHEN inheritance THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END
        * CASE WHEN certainty = 0.9::DOUBLE THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN certainty = 0.6::DOUBLE THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * certainty
        * CASE WHEN fan_out >= 10 THEN 0.65::DOUBLE WHEN fan_out >= 6 THEN 0.8::DOUBLE WHEN fan_out >= 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS score FROM path)"""


def scored_paths(spark: SparkSession, d: str) -> DataFrame:
    """Part <- order <- test customer: every path with its unrounded score; the last edge is certain."""
    pair = graph.collapse_parallel(call_edges(spark, d))
    out = call_edges(spark, d).groupBy("src").agg(F.count("*").alias("fan_out"))
    orders = t(spark, d, "orders").select(node_id("order", "o_orderkey").alias("src"), "o_custkey")
    tests = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    path = pair.join(out, "src").join(orders.join(tests, "o_custkey", "left_semi"), "src")
    sure = F.col("certainty")
    value = score.confidence(F.lit(2), F.lit(False), F.col("inheritance"), F.when(sure.isin(*score.SYMBOL_CERTAINTIES), sure).otherwise(1.0), sure == score.AMBIGUOUS_CERTAINTY, sure, F.lit(False), F.col("fan_out"))
    return path.select(F.col("dst").alias("target"), node_id("customer", "o_custkey").alias("test"), value.alias("score"))


def bucket(value: Column) -> Column:
    """A score in millionths, so that the last bit of a product does not decide a comparison."""
    return F.floor(value * 1_000_000 + F.lit(0.5)).cast("long")


@query(_HITS_SQL + """ SELECT target, test, CAST(floor(max(score) * 1000000 + 0.5) AS BIGINT) AS score_millionths FROM scored GROUP BY ALL""")
def impact_hits(spark, d):
    return scored_paths(spark, d).groupBy("target", "test").agg(bucket(F.max("score")).alias("score_millionths"))


@query(_HITS_SQL + """, best AS (SELECT target, test, max(score) AS score FROM scored GROUP BY ALL)
    SELECT CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, count(*) AS n FROM best GROUP BY 1""")
def confidence_label_counts(spark, d):
    best = scored_paths(spark, d).groupBy("target", "test").agg(F.max("score").alias("score"))
    return best.groupBy(score.label(F.col("score")).alias("confidence")).agg(F.count("*").alias("n"))


@query(_HITS_SQL + """ SELECT test, target, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_millionths FROM
    (SELECT *, row_number() OVER (PARTITION BY test ORDER BY floor(score * 1000000 + 0.5) DESC, target) AS n FROM scored) WHERE n = 1""")
def merge_best_hit(spark, d):
    hits = scored_paths(spark, d).withColumn("score_millionths", bucket(F.col("score")))
    return lookup.merge_best(hits, ["test"], [-F.col("score_millionths"), F.col("target")]).select("test", "target", "score_millionths")


@query("""SELECT l_orderkey, l_linenumber, CAST(floor((CASE WHEN l_linenumber >= 2 THEN pow(0.9, l_linenumber - 1) ELSE 1 END * CASE WHEN l_returnflag = 'R' THEN 0.4 ELSE 1 END
    * CASE WHEN l_linestatus = 'O' THEN 0.95 ELSE 1 END * CASE WHEN l_discount > 0.05 THEN 0.9 ELSE 1 END
    * CASE WHEN l_quantity >= 10 THEN 0.65 WHEN l_quantity >= 6 THEN 0.8 WHEN l_quantity >= 3 THEN 0.9 ELSE 1 END)::DOUBLE * 1000000 + 0.5) AS BIGINT) AS score_millionths FROM lineitem""")
def confidence_score(spark, d):
    one = F.lit(1.0)
    value = score.confidence(F.col("l_linenumber"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", one, F.lit(False), one, F.col("l_discount") > 0.05, F.col("l_quantity"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", bucket(value).alias("score_millionths"))


@query("""WITH p AS (SELECT c_nationkey, 1 AS priority, 'direct_caller' AS reason, c_custkey FROM customer WHERE c_acctbal > 9000
    UNION ALL SELECT c_nationkey, 2, 'transitive_caller', c_custkey FROM customer WHERE c_acctbal > 8000
    UNION ALL SELECT c_nationkey, 3, 'transitive_test', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT c_nationkey, CAST(priority AS INTEGER) AS priority, reason, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY priority, c_custkey) AS n FROM p) WHERE n = 1""")
def suggest_priority(spark, d):
    c = t(spark, d, "customer")
    rule = lambda cond, p, reason: c.where(cond).select("c_nationkey", F.lit(p).alias("priority"), F.lit(reason).alias("reason"), "c_custkey")
    rows = rule("c_acctbal > 9000", 1, "direct_caller").unionByName(rule("c_acctbal > 8000", 2, "transitive_caller")).unionByName(rule("c_mktsegment = 'BUILDING'", 3, "transitive_test"))
    return lookup.merge_best(rows, ["c_nationkey"], [F.col("priority"), F.col("c_custkey")])


@query(f"WITH {CALLS_SQL} SELECT dst AS target, min(certainty) AS cert, bool_or(inheritance) AS inherited FROM calls WHERE src = 'order:1' GROUP BY dst")
def explain_one_hop(spark, d):
    return graph.collapse_parallel(call_edges(spark, d).where("src = 'order:1'")).select(F.col("dst").alias("target"), F.col("certainty").alias("cert"), F.col("inheritance").alias("inherited"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n <= 8")
def name_fallback_cap(spark, d):
    return lookup.capped(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"])


@query("""WITH k AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN p_name ELSE 'm' || p_size || '/part.py:' || replace(p_name, ' ', '.') END AS key FROM part),
    n AS (SELECT DISTINCT regexp_extract(p_name, '[^ ]*$') AS name FROM part WHERE p_size % 2 = 0 UNION SELECT n_name FROM nation)
    SELECT DISTINCT name, key FROM k JOIN n ON position(':' IN key) > 0 AND name = regexp_extract(regexp_extract(key, '[^:]*$'), '[^.]*$')""")
def bare_name_keys(spark, d):
    part = t(spark, d, "part")
    key = F.when(F.col("p_partkey") % 11 == 0, F.col("p_name")).otherwise(F.concat(F.lit("m"), F.col("p_size"), F.lit("/part.py:"), F.translate("p_name", " ", ".")))
    last = part.where("p_size % 2 = 0").select(F.substring_index("p_name", " ", -1).alias("name"))
    return lookup.bare_keys(last.unionByName(t(spark, d, "nation").select(F.col("n_name").alias("name"))), part.select(key.alias("key")))


@query("""WITH s AS (SELECT p_partkey, p_brand, p_size FROM part),
    c AS (SELECT p_partkey, 1 AS prio, n_name AS target FROM s JOIN nation ON n_nationkey = p_size
    UNION ALL SELECT p_partkey, 2, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand END FROM s WHERE p_size > 40
    UNION ALL SELECT p_partkey, 3, r_name FROM s JOIN region ON r_regionkey = p_size % 7
    UNION ALL SELECT p_partkey, 4, 'fallback' FROM s)
    SELECT p_partkey, CAST(prio AS INTEGER) AS prio, target FROM (SELECT *, rank() OVER (PARTITION BY p_partkey ORDER BY prio) AS r FROM c) WHERE r = 1 AND target IS NOT NULL""")
def resolve_cascade(spark, d):
    s = t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    hit = lambda rows, prio, target: rows.select("p_partkey", F.lit(prio).alias("prio"), target.alias("target"))
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    rows = hit(s.join(nation, F.col("n_nationkey") == F.col("p_size")), 1, F.col("n_name"))
    rows = rows.unionByName(hit(s.where("p_size > 40"), 2, F.when(F.col("p_size") % 2 != 0, F.col("p_brand"))))
    rows = rows.unionByName(hit(s.join(region, F.col("r_regionkey") == F.col("p_size") % 7), 3, F.col("r_name")))
    return lookup.first_rule(rows.unionByName(hit(s, 4, F.lit("fallback"))), ["p_partkey"])


@query("""WITH o AS (SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root FROM orders)
    SELECT o_orderkey AS key, root FROM o WHERE o_orderkey <> root""")
def alias_chase(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lag("o_orderkey").over(w).alias("next")).where("next is not null")
    return reach.chase(links)


@query("""WITH p AS (SELECT 'f' || c_nationkey AS file, 'r' || c_nationkey % 5 || '.m' AS module, 'r' || c_custkey % 5 || '.x' || c_custkey AS target FROM customer),
    i AS (SELECT 'f' || s_nationkey AS file, 'a' || s_suppkey AS local_name, 'r' || s_suppkey % 5 || '.y' AS fqn FROM supplier WHERE s_nationkey < 20)
    SELECT * FROM p WHERE file NOT IN (SELECT file FROM i) OR string_split(target, '.')[1] = string_split(module, '.')[1]
      OR EXISTS (SELECT 1 FROM i WHERE i.file = p.file AND (i.local_name = string_split(target, '.')[1] OR string_split(i.fqn, '.')[1] = string_split(target, '.')[1]))""")
def accessibility_semi(spark, d):
    s = lambda c: F.col(c).cast("string")
    pairs = t(spark, d, "customer").select(F.concat(F.lit("f"), s("c_nationkey")).alias("file"), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string"), F.lit(".m")).alias("module"), F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string"), F.lit(".x"), s("c_custkey")).alias("target"))
    imports = t(spark, d, "supplier").where("s_nationkey < 20").select(F.concat(F.lit("f"), s("s_nationkey")).alias("file"), F.concat(F.lit("a"), s("s_suppkey")).alias("local_name"), F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string"), F.lit(".y")).alias("fqn"))
    return lookup.accessible(pairs, imports)


@query("""WITH own AS (SELECT 'm' || n_regionkey AS module, n_name AS name, 'own:' || n_name AS target FROM nation),
    imp AS (SELECT 'm' || n_regionkey AS module, n_name AS name, 'imp:' || n_name AS target FROM nation WHERE n_nationkey % 2 = 0),
    listed AS (SELECT 'm' || n_regionkey AS module, n_name AS name FROM nation WHERE n_regionkey < 2 AND n_nationkey % 3 <> 0),
    r AS (SELECT *, 0 AS i FROM own UNION ALL SELECT *, 1 FROM imp),
    c AS (SELECT *, module IN (SELECT module FROM listed) AS explicit FROM r)
    SELECT module, name, target FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY CASE WHEN explicit THEN 1 - i ELSE i END) AS n FROM c
      WHERE NOT explicit OR (module, name) IN (SELECT module, name FROM listed)) WHERE n = 1""")
def module_exports_priority(spark, d):
    n = t(spark, d, "nation")
    row = lambda cond, tag: n.where(cond).select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("module"), F.col("n_name").alias("name"), F.concat(F.lit(tag), "n_name").alias("target"))
    return lookup.exports(row("true", "own:"), row("n_nationkey % 2 = 0", "imp:"), row("n_regionkey < 2 and n_nationkey % 3 <> 0", ""))


@query("""WITH f AS (SELECT 'c' || c_custkey AS cls, 'c' || c_custkey AS owner FROM customer WHERE c_acctbal > 5000
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_nationkey % 2 = 0
    UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT cls, owner, cls || owner AS target FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.cls = a.cls AND CASE left(b.owner, 1) WHEN 'c' THEN 0 WHEN 'n' THEN 1 ELSE 2 END < CASE left(a.owner, 1) WHEN 'c' THEN 0 WHEN 'n' THEN 1 ELSE 2 END)""")
def override_anti_join(spark, d):
    up = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    c, n, r = (F.concat(F.lit(k), F.col(x).cast("string")) for k, x in (("c", "c_custkey"), ("n", "c_nationkey"), ("r", "n_regionkey")))
    rows = up.where("c_acctbal > 5000").select(c.alias("cls"), c.alias("owner")).unionByName(up.where("c_nationkey % 2 = 0").select(c.alias("cls"), n.alias("owner"))).unionByName(up.select(c.alias("cls"), r.alias("owner")))
    ancestors = up.select(c.alias("cls"), F.explode(F.array(n, r)).alias("ancestor")).unionByName(up.select(n.alias("cls"), r.alias("ancestor")).distinct())
    return lookup.without_overridden(rows.withColumn("target", F.concat("cls", "owner")), ancestors)


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = t(spark, d, "orders").select("o_orderkey", node_id("f", "o_orderkey").alias("path"))
    key = F.col("o_orderkey")
    old = o.where(key % 11 != 0).select("path", (key * 1.0).alias("mtime"))
    return old, o.where(key % 7 != 0).select("path", (key * 1.0 + F.when(key % 5 == 0, 1.0).otherwise(0.0)).alias("mtime"))


SNAPSHOT_SQL = """old AS (SELECT 'f:' || o_orderkey AS path, o_orderkey::DOUBLE AS mtime FROM orders WHERE o_orderkey % 11 <> 0),
    new AS (SELECT 'f:' || o_orderkey AS path, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0 END AS mtime FROM orders WHERE o_orderkey % 7 <> 0)"""


@query(f"""WITH {SNAPSHOT_SQL} SELECT * FROM (SELECT coalesce(old.path, new.path) AS path,
    CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' WHEN old.mtime <> new.mtime THEN 'modified' END AS op
    FROM old FULL JOIN new ON old.path = new.path) WHERE op IS NOT NULL""")
def snapshot_diff(spark, d):
    return delta.snapshot_diff(*snapshots(spark, d))


@query(f"WITH {SNAPSHOT_SQL} SELECT coalesce(old.mtime = new.mtime, false) AS reused, count(*) AS n FROM new LEFT JOIN old USING (path) GROUP BY 1")
def snapshot_reuse(spark, d):
    return delta.reusable(*snapshots(spark, d)).groupBy("reused").agg(F.count("*").alias("n"))


@query(f"""WITH {LINKS_SQL}, gone AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1)
    SELECT src, dst FROM links WHERE (src IN (SELECT id FROM gone)) <> (dst IN (SELECT id FROM gone))""")
def incident_edges_xor(spark, d):
    gone = t(spark, d, "customer").where("c_acctbal < 0").select(node_id("customer", "c_custkey").alias("id")).unionByName(t(spark, d, "nation").where("n_regionkey = 1").select(node_id("nation", "n_nationkey").alias("id")))
    return graph.incident_edges(reverse_links(spark, d), gone)


@query("""WITH n AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900))
    SELECT 'module:' || n_nationkey AS id FROM n UNION ALL SELECT 'pkg:' || r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)""")
def orphan_prune(spark, d):
    nation = t(spark, d, "nation")
    nodes = nation.select(node_id("module", "n_nationkey").alias("id")).unionByName(t(spark, d, "region").select(node_id("pkg", "r_regionkey").alias("id")))
    owns = F.lit("OWNS").alias("relation")
    edges = nation.select(node_id("pkg", "n_regionkey").alias("src"), node_id("module", "n_nationkey").alias("dst"), owns)
    edges = edges.unionByName(t(spark, d, "customer").where("c_acctbal > 9900").select(node_id("module", "c_nationkey").alias("src"), node_id("customer", "c_custkey").alias("dst"), owns))
    return graph.prune_orphans(nodes, edges)[0]


@query(f"""WITH {SNAPSHOT_SQL}, a AS (SELECT path AS id, 'd' || mtime::BIGINT % 10 AS dst FROM old), b AS (SELECT path AS id, 'd' || mtime::BIGINT % 10 AS dst FROM new)
    SELECT 'node' AS entity, 'added' AS op, id, NULL AS src, NULL AS dst, NULL AS relation FROM b WHERE id NOT IN (SELECT id FROM a)
    UNION ALL SELECT 'node', 'removed', id, NULL, NULL, NULL FROM a WHERE id NOT IN (SELECT id FROM b)
    UNION ALL SELECT 'edge', 'added', NULL, id, dst, 'CALLS' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'edge', 'removed', NULL, id, dst, 'CALLS' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def delta_feed(spark, d):
    sides = [x.select(F.col("path").alias("id"), F.concat(F.lit("d"), (F.col("mtime").cast("long") % 10).cast("string")).alias("dst")) for x in snapshots(spark, d)]
    edges = [x.select(F.col("id").alias("src"), "dst", F.lit("CALLS").alias("relation")) for x in sides]
    return delta.change_feed(*[x.select("id") for x in sides], *edges)


DIFF = "+++ b/a.py\n@@ -1,2 +3,2 @@\n x\n+++ b/c.py\n@@ -0,0 +7 @@\n@@ -9 +9,0 @@\n@@ -20,3 +21,3 @@ def f\n+++ /dev/null\n@@ -1 +40 @@\n+++ b/a.py\n@@ -5 +6,2 @@"


@query("SELECT * FROM (VALUES ('1', 'a.py', 6), ('1', 'a.py', 7), ('1', 'c.py', 7), ('1', 'c.py', 21), ('1', 'c.py', 22), ('1', 'c.py', 23), ('1', 'c.py', 40)) AS v(diff_id, path, line)")
def diff_hunk_parse(spark, d):
    return changed_lines(spark.createDataFrame([("1", DIFF)], "diff_id string, text string"))


@query("""WITH e AS (SELECT *, CAST(date_part('hour', ts) * 60 + date_part('minute', ts) AS INTEGER) AS line, strftime(ts, '%Y-%m-%d') AS day FROM events),
    s AS (SELECT user_id, day, 's' || event_id AS id, line AS start, line + 120 AS "end" FROM e WHERE event_type = 'signup'),
    m AS (SELECT DISTINCT e.user_id, e.day, e.line, s.id, s.start FROM e JOIN s ON e.user_id = s.user_id AND e.day = s.day AND e.line BETWEEN s.start AND s."end" WHERE event_type = 'error')
    SELECT user_id, day, line, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, line ORDER BY start, id) AS n FROM m) WHERE n = 1""")
def line_to_symbol_range(spark, d):
    e = t(spark, d, "events").withColumn("line", F.hour("ts") * 60 + F.minute("ts")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    spans = e.where("event_type = 'signup'").select("user_id", "day", F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"), F.col("line").alias("start"), (F.col("line") + 120).alias("end"))
    return lookup.attribute_lines(e.where("event_type = 'error'").select("user_id", "day", "line").distinct(), spans, ["user_id", "day"])


@query("""SELECT a.event_id, max(b.ts) AS last_seen FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts <= a.ts
    WHERE a.event_type = 'error' GROUP BY 1""")
def nearest_preceding_asof(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("ts").alias("seen"))
    return lookup.nearest_preceding(e.where("event_type = 'error'").drop("event_type"), views, ["user_id"], "ts", "seen").select("event_id", "last_seen")


@query("SELECT p_partkey, (p_name GLOB '*a*' OR p_name GLOB '?[e-o]*') AS matched FROM part")
def glob_match(spark, d):
    return t(spark, d, "part").select("p_partkey", names.glob(F.col("p_name"), ["*a*", "?[e-o]*"]).alias("matched"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'tests/test_' || page_id || '.py' WHEN page_id % 3 = 1 THEN 'src/test_' || page_id || '.py' ELSE 'tests/other.py' END AS path,
    CASE WHEN page_id % 2 = 0 THEN 'TestA' END AS cls, CASE WHEN page_id % 5 < 3 THEN 'test_x' ELSE 'helper' END AS fn FROM pages)
    SELECT page_id, page_id % 3 = 0 AND (fn = 'test_x' OR cls IS NOT NULL) AS pytest, page_id % 3 = 0 AND fn = 'test_x' AND cls IS NOT NULL AS unittest, page_id % 3 = 0 AND fn = 'test_x' AS other FROM p""")
def test_discovery(spark, d):
    key = F.col("page_id")
    number = key.cast("string")
    path = F.when(key % 3 == 0, F.concat(F.lit("tests/test_"), number, F.lit(".py"))).when(key % 3 == 1, F.concat(F.lit("src/test_"), number, F.lit(".py"))).otherwise("tests/other.py")
    rows = t(spark, d, "pages").select("page_id", path.alias("path"), F.when(key % 2 == 0, "TestA").alias("cls"), F.when(key % 5 < 3, "test_x").otherwise("helper").alias("fn"))
    rule = lambda f: names.Discovery(framework=f).is_test_node(F.lit("a.b"), F.lit("function"), F.col("path"), F.col("cls"), F.col("fn")).alias(f)
    return rows.select("page_id", rule("pytest"), rule("unittest"), rule("other"))


@query(f"WITH {CALLS_SQL} SELECT 0::BIGINT AS import_edges, (SELECT count(*) FROM calls WHERE certainty = 0.6::DOUBLE) AS ambiguous_edges, (SELECT count(*) FROM events WHERE event_type = 'error') AS dynamic_nodes")
def graph_metrics(spark, d):
    nodes = t(spark, d, "events").select(F.when(F.col("event_type") == "error", "dynamic_call").otherwise("function").alias("kind"))
    return graph.metrics(nodes, call_edges(spark, d))


# Class lattices: (class, bases in order), and the order that is due.
LATTICES = {
    "Base": ([], ["Base"]),
    "Left": (["Base"], ["Left", "Base"]),
    "Right": (["Base"], ["Right", "Base"]),
    "Joint": (["Left", "Right"], ["Joint", "Left", "Right", "Base"]),
    "Leaf": (["Joint", "Right"], ["Leaf", "Joint", "Left", "Right", "Base"]),
    "Clash": (["Base", "Left"], ["Clash", "Base", "Left"]),
    "Ring": (["Ring"], ["Ring"]),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}', {i}::INTEGER)" for c, (_, due) in LATTICES.items() for i, a in enumerate(due)) + ") AS v(cls, ancestor, pos)")
def c3_mro(spark, d):
    classes = spark.createDataFrame([(c, "class") for c in LATTICES], "unique_id string, kind string")
    bases = spark.createDataFrame([(c, b, i) for c, (above, _) in LATTICES.items() for i, b in enumerate(above)], "cls string, base string, pos int")
    return resolve.linearize(bases, classes)


_EXACT_SQL = f"""WITH {CALLS_SQL}, pair AS (SELECT src, dst, min(certainty) AS certainty, bool_or(inheritance) AS inheritance FROM calls GROUP BY ALL),
    fan AS (SELECT src, count(*) AS n FROM calls GROUP BY 1), own AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
    path AS (SELECT pair.dst AS target, pair.src AS via, 'customer:' || o_custkey AS test_function, certainty, inheritance, greatest(fan.n, own.n) AS fan_out
        FROM pair JOIN fan USING (src) JOIN orders ON pair.src = 'order:' || o_orderkey JOIN own USING (o_custkey) JOIN customer ON c_custkey = o_custkey
        WHERE c_mktsegment = 'BUILDING' AND dst IN (SELECT 'part:' || p_partkey FROM part)),
    scored AS (SELECT target, via, test_function, CAST(format('{{:.4f}}', 0.9::DOUBLE * CASE WHEN inheritance THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END
        * CASE WHEN certainty = 0.9::DOUBLE THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN certainty = 0.6::DOUBLE THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * certainty
        * CASE WHEN fan_out >= 10 THEN 0.65::DOUBLE WHEN fan_out >= 6 THEN 0.8::DOUBLE WHEN fan_out >= 3 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) AS DOUBLE) AS score FROM path),
    best AS (SELECT *, row_number() OVER (PARTITION BY target, test_function ORDER BY score DESC, via) AS n FROM scored)
    SELECT target, test_function, 2::INTEGER AS depth, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, score,
        target || ' ' || via || ' ' || test_function AS chain FROM best WHERE n = 1"""


def exact_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the call graph order -> part, customer -> order; BUILDING customers are the tests."""
    orders = t(spark, d, "orders").select(node_id("customer", "o_custkey").alias("src"), node_id("order", "o_orderkey").alias("dst"), F.lit("CALLS").alias("relation"), F.lit(1.0).alias("certainty"), F.lit(False).alias("inheritance"), F.lit(0).alias("ord"))
    test = t(spark, d, "customer").select(node_id("customer", "c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("is_test"))
    plain = [t(spark, d, name).select(node_id(kind, key).alias("id"), F.lit(False).alias("is_test")) for name, kind, key in (("orders", "order", "o_orderkey"), ("part", "part", "p_partkey"))]
    nodes = test.unionByName(plain[0]).unionByName(plain[1]).select("id", F.lit(False).alias("decorated"), "is_test", F.lit(None).cast("string").alias("file"))
    return nodes, call_edges(spark, d).unionByName(orders)


@query(_EXACT_SQL)
def impact_exact(spark, d):
    """Best-first search from every part, with the chain that was taken."""
    targets = t(spark, d, "part").select(node_id("part", "p_partkey").alias("node"))
    found = search.affected_tests(*exact_graph(spark, d), targets)
    return found.select("target", "test_function", "depth", "confidence", "score", F.array_join("chain", " ").alias("chain"))


@query(f"SELECT * FROM ({_EXACT_SQL}) WHERE target = 'part:1'")
def impact_one(spark, d):
    """Best-first search from one part."""
    found = search.affected_tests(*exact_graph(spark, d), spark.createDataFrame([("part:1",)], "node string"))
    return found.select("target", "test_function", "depth", "confidence", "score", F.array_join("chain", " ").alias("chain"))


@query("""WITH RECURSIVE links AS (SELECT n_nationkey AS key, (n_nationkey * n_nationkey + 3) % 25 AS next FROM nation),
    w AS (SELECT key, key AS here, [key] AS path, false AS met FROM links
      UNION ALL SELECT w.key, links.next, list_append(path, links.next), list_contains(path, links.next) FROM w JOIN links ON w.here = links.key WHERE NOT met)
    SELECT key, CAST(here AS BIGINT) AS root FROM w WHERE met""")
def alias_cycles(spark, d):
    """Every chain of these links runs into a cycle; a key ends where its chain meets itself."""
    links = t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), ((F.col("n_nationkey") * F.col("n_nationkey") + 3) % 25).alias("next"))
    return reach.chase(links).select("key", F.col("root").cast("long").alias("root"))


@query("""SELECT DISTINCT 'orders.o' || l_orderkey || '.run' AS src, 'parts.m' || (l_partkey // 100) || '.p' || l_partkey AS dst, 1.0::DOUBLE AS certainty
    FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)""")
def file_index_e2e(spark, d):
    """Orders as source files that import and call their parts' functions: parsed, resolved, and drawn as edges."""
    part = F.col("l_partkey").cast("string")
    pair = t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey"), F.concat(F.lit("from parts.m"), F.floor(F.col("l_partkey") / 100).cast("string"), F.lit(" import p"), part).alias("line"), F.concat(F.lit("    p"), part, F.lit("()")).alias("call"))
    text = F.concat(F.array_join(F.collect_set("line"), "\n"), F.lit("\n\n\ndef run():\n"), F.array_join(F.collect_list("call"), "\n"), F.lit("\n"))
    callers = pair.groupBy("l_orderkey").agg(text.alias("content")).select(F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("rel_path"), "content")
    key = F.col("p_partkey").cast("string")
    defs = t(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("m"), F.concat(F.lit("def p"), key, F.lit("():\n    pass\n")).alias("text"))
    called = defs.groupBy("m").agg(F.array_join(F.collect_list("text"), "\n\n").alias("content")).select(F.concat(F.lit("parts/m"), F.col("m").cast("string"), F.lit(".py")).alias("rel_path"), "content")
    index = engine.index_files(callers.unionByName(called))
    imports = resolve.close_imports(index.imports, index.import_meta, index.modules, index.symbols)
    return resolve.resolve_calls(index.symbols, imports).select("src", "dst", "certainty")


QUERIES |= source_queries.QUERIES
ORACLE_SQL |= source_queries.ORACLE_SQL
