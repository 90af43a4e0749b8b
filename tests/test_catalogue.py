"""Every query of the catalogue with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from impactgraph.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    fold = lambda v: round(v, 9) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    return sorted(repr([fold(v) for v in row]) for row in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    due = duck.sql(ORACLE_SQL[name])
    assert sorted(due.columns) == columns
    assert plain(rows) == plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())


def test_first_call_of_a_pair_counts_where_line_numbers_tie(spark, tmp_path):
    first = [(1, 1, 2, "N", "O"), (1, 2, 1, "A", "O"), (2, 1, None, "N", "F"), (3, 1, 4, "N", "F"), (4, None, None, "A", "F")]
    second = [(1, 1, 2, "R", "F"), (1, 2, 1, "R", "F"), (2, 1, 7, "R", "O"), (3, 1, 3, "R", "O"), (4, None, None, None, None), (1, 1, 2, "A", "F")]
    kind = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_returnflag", pa.string()), ("l_linestatus", pa.string())])
    tables = [pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind) for rows in (first, second)]
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    (parts / "lineitem.parquet").mkdir(parents=True)
    whole.mkdir()
    pq.write_table(pa.concat_tables(tables), whole / "lineitem.parquet", row_group_size=4)
    for i, table in enumerate(tables):
        pq.write_table(table, parts / "lineitem.parquet" / f"part-{i}.parquet")
    due = [("order:1", "part:1", 1.0), ("order:1", "part:2", 0.9), ("order:2", "part:1", 0.6), ("order:3", "part:1", 0.6), ("order:4", None, 0.9)]
    for d in (whole, parts):
        assert plain(QUERIES["calls_edges_dedup"](spark, str(d)).collect()) == plain(due)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT * FROM '{whole}/lineitem.parquet'")
    assert plain(con.sql(ORACLE_SQL["calls_edges_dedup"]).fetchall()) == plain(due)
