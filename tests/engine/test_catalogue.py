import duckdb
import pytest

from graphloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted(str(tuple(r)) for r in got.select(*[f"`{c}`" for c in cols]).collect())
    if name in queries.SQL:
        quoted = ", ".join(f'"{c}"' for c in cols)
        assert rows == sorted(map(str, duck.sql(f"SELECT {quoted} FROM ({queries.SQL[name]})").fetchall()))


def test_filters_reach_the_scan(spark, sf):
    plan = queries.QUERIES["lift_prop_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan
    plan = queries.QUERIES["count"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in plan or "l_extendedprice" not in plan


def test_no_python_or_cross_joins_in_plans(spark, sf):
    for name in ("flagship", "filter_subq_count", "pivot_multi_hop", "edge_walk_n1", "scrape", "html_text", "fork_resolve", "interval_join"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_interval_join_joins_all_rows(spark, sf, duck):
    rows = duck.sql("SELECT o_orderkey, epoch_ms(o_orderdate) FROM orders WHERE o_orderstatus = 'P'").fetchall()
    near = 3 * 86_400_000
    want = sorted((a, b) for a, x in rows for b, y in rows if abs(x - y) < near)
    assert len({a for a, _ in want}) == len(rows) > 400
    assert sorted(map(tuple, queries.QUERIES["interval_join"](spark, sf).collect())) == want


def test_graph_edges_past_100_000_nodes(spark, sf, duck, tmp_path):
    many = spark.read.parquet(f"{sf}/orders.parquet").crossJoin(spark.range(90)).selectExpr("o_orderkey * 90 + id AS o_orderkey", "o_custkey", "o_orderstatus", "450001.0D AS o_totalprice", "o_orderdate", "o_orderpriority")
    many.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["graph_edges"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    ((want,),) = con.sql(f"SELECT count(*) FROM ({queries.SQL['graph_edges']})").fetchall()
    assert got.count() == got.distinct().count() == want > 100_000
