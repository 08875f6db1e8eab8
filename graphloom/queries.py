"""The query catalogue over the driver's tables: each operator once, with its SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import binary, extract, text, times
from graphloom.graph import Graph, Stream, q
from graphloom.model import driver_model
from graphloom.operators import commands as cmd
from graphloom.operators import control, edits, lifts, pivots, subgraph, walks
from graphloom.operators.filters import ArrayHas, IsForm, Prop, Subq, Tag, TagProp, where
from graphloom.plans import joins, layers
from graphloom.plans.language import run_text
from graphloom.sources import feeds
from graphloom.streaming import editlog, queues, triggers
from graphloom.types import Int

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of_parquet(spark, sf_dir, driver_model())


def query(sql: str | None = None):
    """Registers ``fn(graph) -> DataFrame | Stream`` under its name."""
    def register(fn):
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(graph(spark, sf_dir))
            return out.df() if isinstance(out, Stream) else out

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


FLAGSHIP = "customer:mktsegment=BUILDING -> orders +:totalprice>100000 | stats.countby :orderpriority"
_C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

# lifts


@query("SELECT * FROM customer")
def lift_form(g):
    return lifts.lift(g, "customer")


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def lift_prop_eq(g):
    return lifts.lift(g, "orders:status", "=", "F")


@query("SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
def lift_prop_range(g):
    return lifts.lift(g, "part:size", "range=", (10, 20))


@query("SELECT * FROM part WHERE p_brand IN ('Brand#13', 'Brand#22', 'Brand#35')")
def lift_prop_in(g):
    return lifts.lift(g, "part:brand", "in=", ["Brand#13", "Brand#22", "Brand#35"])


@query("SELECT * FROM part WHERE regexp_matches(p_name, '(?i)WIDG')")
def lift_prop_regex(g):
    return lifts.lift(g, "part:name", "~=", "WIDG")


@query("SELECT * FROM part WHERE starts_with(p_type, 'ECO')")
def lift_prop_prefix(g):
    return lifts.lift(g, "part:type", "^=", "ECO")


@query("SELECT * FROM orders WHERE o_totalprice >= 400000")
def lift_prop_order(g):
    return lifts.lift(g, "orders:totalprice", ">=", 400000)


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def lift_time_wild(g):
    return lifts.lift(g, "orders:date", "=", "1995*")


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
def lift_time_ival(g):
    return lifts.lift(g, "orders:date", "@=", ("1995", "1996/07/01"))


@query("SELECT * FROM labels WHERE quality IS NOT NULL")
def lift_has_prop(g):
    return lifts.lift(g, "label:quality")


@query("SELECT 'customer' AS form, c_custkey::VARCHAR AS valu FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 5000")
def lift_iface(g):
    return lifts.lift(g, "party:acctbal", ">", 5000).ndefs()


@query("SELECT vec_id, label FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings) WHERE x > 0.25")
def lift_array(g):
    return lifts.lift_array(g, "embedding:vector", ">", 0.25).df().select("vec_id", "label")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def lift_tag(g):
    return lifts.lift_tag(g, "priority.urgent").df("orders").select("o_orderkey")


@query("SELECT 'orders' AS form, o_orderkey::VARCHAR AS valu FROM orders WHERE o_orderstatus IN ('F') OR o_orderpriority = '1-URGENT'")
def lift_tags(g):
    return lifts.lift_tags(g, ["priority.urgent", "status.f"]).ndefs()


@query("SELECT o.* FROM orders o JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def lift_embed(g):
    return lifts.lift(g, "orders:custkey::mktsegment", "=", "BUILDING")


@query("SELECT 'part' AS form, p_partkey::VARCHAR AS valu FROM part WHERE p_size = 7 UNION ALL SELECT 'region', r_regionkey::VARCHAR FROM region")
def lift_append(g):
    return lifts.lift(g, "part:size", "=", 7).union(lifts.lift(g, "region")).ndefs()


@query("SELECT s2.s_suppkey, s2.s_name FROM supplier s1 JOIN supplier s2 ON s2.s_nationkey = s1.s_nationkey WHERE s1.s_acctbal > 8000 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 8000")
def lift_by_row(g):
    rich = lifts.lift(g, "supplier:acctbal", ">", 8000)
    return lifts.lift_by_row(rich, "supplier", "nationkey", "=", F.col("s_nationkey")).df().select("s_suppkey", "s_name")


@query("SELECT DISTINCT p_brand AS valu FROM part")
def prop_values(g):
    return lifts.prop_values(g, "part:brand")


@query("SELECT DISTINCT 'priority.' || trim(BOTH '_' FROM regexp_replace(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')), '[^a-z0-9]+', '_', 'g')) AS tag FROM orders UNION SELECT 'priority'")
def tags_by_prefix(g):
    return lifts.tags_by_prefix(g, "priority", 1)


@query("WITH RECURSIVE e(tag, onto) AS (SELECT 'r.' || r_regionkey, 'n.' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n.' || n_nationkey, 's.' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey), t(tag) AS (SELECT 'r.1' UNION SELECT onto FROM e JOIN t ON e.tag = t.tag) SELECT tag FROM t")
def lift_tag_tag(g):
    n, s = g.tables("nation"), g.tables("supplier")
    up = n.select(F.concat(F.lit("r."), "n_regionkey").alias("tag"), F.concat(F.lit("n."), "n_nationkey").alias("on"))
    down = s.select(F.concat(F.lit("n."), "s_nationkey").alias("tag"), F.concat(F.lit("s."), "s_suppkey").alias("on"))
    return lifts.lift_tag_tag(up.union(down), "r.1")


# filters


@query("SELECT * FROM part WHERE coalesce(p_size > 40, false) OR (p_brand = 'Brand#13' AND NOT p_size < 10)")
def filter_and_or_not(g):
    return where(lifts.lift(g, "part"), Prop("size", ">", 40) | Prop("brand", "=", "Brand#13") & ~Prop("size", "<", 10))


@query("SELECT doc_id FROM documents WHERE NOT coalesce(lang = 'en', false)")
def filter_not_null(g):
    return where(lifts.lift(g, "document"), Prop("lang", "=", "en"), keep=False).df().select("doc_id")


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def filter_subq_exists(g):
    return where(lifts.lift(g, "customer"), Subq(lambda s: where(pivots.pivot(s, "orders"), Prop("totalprice", ">", 400000))))


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def filter_subq_not(g):
    return where(lifts.lift(g, "customer"), Subq(lambda s: pivots.pivot(s, "orders")), keep=False)


@query("SELECT * FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 14")
def filter_subq_count(g):
    return where(lifts.lift(g, "customer"), Subq(lambda s: pivots.pivot(s, "orders"), ">=", 14))


@query("SELECT * FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) < 7 OR c_acctbal < 0")
def filter_subq_or(g):
    return where(lifts.lift(g, "customer"), Subq(lambda s: pivots.pivot(s, "orders"), "<", 7) | Prop("acctbal", "<", 0))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_tag(g):
    s = where(lifts.lift(g, "orders"), Tag("priority.*"))
    s = where(s, Tag("priority.urgent") | Tag("priority.high"))
    return where(s, Tag("status.f"), keep=False).df().select("o_orderkey")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x < -0.3)) > 0")
def filter_array(g):
    return where(lifts.lift(g, "embedding"), ArrayHas("vector", "<", -0.3)).df().select("vec_id")


@query("SELECT o.* FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def filter_embed(g):
    return where(lifts.lift(g, "orders"), Prop("custkey::nationkey::regionkey", "=", 2))


@query("SELECT 'supplier' AS form, s_suppkey::VARCHAR AS valu FROM supplier WHERE s_acctbal < 0")
def filter_form(g):
    return where(where(lifts.lift(g, "party"), IsForm("supplier")), Prop("acctbal", "<", 0)).ndefs()


# pivots and walks


@query(f"SELECT c.* FROM orders JOIN customer c ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")  # noqa: F541
def pivot_prop_out(g):
    return pivots.prop_pivot(lifts.lift(g, "orders:status", "=", "P"), "custkey", "customer")


@query("SELECT o.* FROM customer JOIN orders o ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def pivot_form_in(g):
    return pivots.pivot(lifts.lift(g, "customer:mktsegment", "=", "MACHINERY"), "orders")


@query("WITH l AS (SELECT * FROM lineitem WHERE l_quantity = 50) SELECT form, valu, count(*) AS n FROM (SELECT 'orders' AS form, o_orderkey::VARCHAR AS valu FROM l JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'part', p_partkey::VARCHAR FROM l JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM l JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL")
def pivot_out_all(g):
    return pivots.pivot_out(lifts.lift(g, "lineitem:quantity", "=", 50)).ndefs().groupBy("form", "valu").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS form, count(*) AS n FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey < 5")
def pivot_in_all(g):
    return pivots.pivot_in(lifts.lift(g, "nation:name", "in=", [f"NATION_{i}" for i in range(5)])).ndefs().groupBy("form").agg(F.count("*").alias("n"))


@query("SELECT 'nation' AS form, n_nationkey::VARCHAR AS valu FROM nation UNION ALL SELECT 'region', n_regionkey::VARCHAR FROM nation")
def pivot_join(g):
    return pivots.pivot(lifts.lift(g, "nation"), "region", join=True).ndefs()


@query(f"SELECT {_O} FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA'")
def pivot_multi_hop(g):
    return lifts.lift(g, "region:name", "=", "ASIA").pipe(pivots.pivot, "nation").pipe(pivots.pivot, "customer").pipe(pivots.pivot, "orders")


@query("SELECT s.* FROM customer JOIN supplier s ON s_nationkey = c_nationkey WHERE c_acctbal < -900")
def pivot_props(g):
    return pivots.prop_pivot(lifts.lift(g, "customer:acctbal", "<", -900), "nationkey", "supplier:nationkey")


@query("SELECT tag, count(*) AS n FROM (SELECT 'status.' || lower(o_orderstatus) AS tag FROM orders UNION ALL SELECT 'priority.' || trim(BOTH '_' FROM regexp_replace(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')), '[^a-z0-9]+', '_', 'g')) FROM orders) GROUP BY tag")
def pivot_tags(g):
    return pivots.to_tags(lifts.lift(g, "orders")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_nationkey AS nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def embed_prop(g):
    f = g.model.form("orders")
    df, _ = lifts.embed(g, f, g.frame(f), ["custkey", "nationkey"], "nationkey")
    return df.select("o_orderkey", "nationkey")


_EDGES = "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"


@query(f"SELECT p.* FROM supplier JOIN {_EDGES} ON s_suppkey = l_suppkey JOIN part p ON p_partkey = l_partkey WHERE s_acctbal > 9000")
def edge_walk_n1(g):
    return walks.walk(lifts.lift(g, "supplier:acctbal", ">", 9000), ["supplies"], "part")


@query(f"SELECT s.* FROM part JOIN {_EDGES} ON p_partkey = l_partkey JOIN supplier s ON s_suppkey = l_suppkey WHERE p_size = 50")
def edge_walk_n2(g):
    return walks.walk(lifts.lift(g, "part:size", "=", 50), ["supplies"], "supplier", reverse=True)


@query(f"SELECT p.* FROM supplier JOIN {_EDGES} ON s_suppkey = l_suppkey JOIN part p ON p_partkey = l_partkey WHERE p_size > 45")
def edge_walk_filter(g):
    return walks.walk(lifts.lift(g, "supplier"), ["supplies"], "part:size", ">", 45)


@query("SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def lift_byverb(g):
    return walks.lift_byverb(g, "supplies", n2=True)


# commands


@query("SELECT DISTINCT c.* FROM customer c JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def uniq(g):
    return cmd.uniq(pivots.prop_pivot(lifts.lift(g, "orders:totalprice", ">", 300000), "custkey", "customer"))


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def uniq_by(g):
    return cmd.uniq(lifts.lift(g, "part"), "brand").df().select("p_brand", "p_partkey")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def limit(g):
    return cmd.limit(lifts.lift(g, "orders"), 10)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def max_n(g):
    return cmd.top(lifts.lift(g, "orders"), ":totalprice", 10)


@query("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def min_n(g):
    return cmd.top(lifts.lift(g, "orders"), ":totalprice", 10, largest=False)


@query("SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R'")
def count(g):
    return cmd.count(lifts.lift(g, "lineitem:returnflag", "=", "R"))


@query("SELECT c_mktsegment AS valu, count(*) AS count FROM customer GROUP BY c_mktsegment")
def countby(g):
    return cmd.countby(lifts.lift(g, "customer"), ":mktsegment")


@query("SELECT l_returnflag AS valu, count(*) AS count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM lineitem GROUP BY l_returnflag")
def countby_percent(g):
    return cmd.countby(lifts.lift(g, "lineitem"), ":returnflag", percent=True)


@query("SELECT l_returnflag AS name, sum(l_quantity) AS total FROM lineitem GROUP BY l_returnflag")
def tally(g):
    return cmd.tally(lifts.lift(g, "lineitem"), "returnflag", "quantity")


@query("SELECT p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_suppkey IN (0, 1) GROUP BY p_partkey HAVING count(DISTINCT l_suppkey) = 2")
def intersect(g):
    two = where(lifts.lift(g, "supplier"), Prop("name", "in=", ["Supplier#000000000", "Supplier#000000001"]))
    return cmd.intersect(two, lambda s: walks.walk(s, ["supplies"], "part")).df().select("p_partkey")


@query("SELECT 'orders' AS form, o_orderkey::VARCHAR AS valu FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9900 UNION ALL SELECT 'nation', c_nationkey::VARCHAR FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'customer', c_custkey::VARCHAR FROM customer WHERE c_acctbal > 9900")
def tee(g):
    rich = lifts.lift(g, "customer:acctbal", ">", 9900)
    return cmd.tee(rich, [lambda s: pivots.pivot(s, "orders"), lambda s: pivots.pivot(s, "nation")], join=True).ndefs()


_TREE = "WITH RECURSIVE t(form, valu, key) AS (SELECT 'region', r_regionkey::VARCHAR, r_regionkey::BIGINT FROM region WHERE r_regionkey = 3 UNION ALL SELECT e.form, e.valu, e.key FROM t JOIN (SELECT 'region' AS pform, n_regionkey::BIGINT AS pkey, 'nation' AS form, n_nationkey::VARCHAR AS valu, n_nationkey::BIGINT AS key FROM nation UNION ALL SELECT 'nation', s_nationkey, 'supplier', s_suppkey::VARCHAR, s_suppkey FROM supplier) e ON t.form = e.pform AND t.key = e.pkey) SELECT form, valu FROM t"


@query(_TREE)
def tree(g):
    def down(s: Stream) -> Stream:
        s = Stream(g, {k: v for k, v in s.frames.items() if k != "supplier"})
        return where(pivots.pivot_in(s), IsForm("nation") | IsForm("supplier")) if s.frames else s

    return cmd.tree(lifts.lift(g, "region", "=", 3), lambda s: _only(down(s), "nation", "supplier")).ndefs()


def _only(s: Stream, *forms: str) -> Stream:
    return Stream(s.graph, {k: v for k, v in s.frames.items() if k in forms})


@query("SELECT 0 AS degree, 'orders' AS form, o_orderkey::VARCHAR AS valu FROM orders WHERE o_totalprice > 450000 UNION SELECT 1, 'customer', o_custkey::VARCHAR FROM orders WHERE o_totalprice > 450000 UNION SELECT 2, 'nation', c_nationkey::VARCHAR FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000")
def graph_project(g):
    nodes, _ = subgraph.project(lifts.lift(g, "orders:totalprice", ">", 450000), subgraph.Rules(degrees=2, edges=False))
    return nodes.ndefs("$degree").withColumnRenamed("$degree", "degree")


@query("SELECT DISTINCT 'orders' AS n1form, o_orderkey::VARCHAR AS n1, 'custkey' AS verb, 'customer' AS n2form, o_custkey::VARCHAR AS n2 FROM orders WHERE o_totalprice > 450000")
def graph_edges(g):
    _, e = subgraph.project(lifts.lift(g, "orders:totalprice", ">", 450000), subgraph.Rules(degrees=1, edges=False))
    return e


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def switch(g):
    mark = lambda t: lambda s: s.let(state=F.lit(t))
    out = control.switch(lifts.lift(g, "orders"), "status", {"F": mark("done"), "O": mark("open")}, mark("other"))
    return out.df().select("o_orderkey", q("$state").alias("state"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS state FROM customer")
def if_else(g):
    mark = lambda t: lambda s: s.let(state=F.lit(t))
    out = control.if_(lifts.lift(g, "customer"), [(Prop("acctbal", "<", 0), mark("debt")), (Prop("acctbal", ">", 5000), mark("rich"))], mark("plain"))
    return out.df().select("c_custkey", q("$state").alias("state"))


@query("SELECT n_nationkey, i AS item FROM nation, (SELECT unnest(['a', 'b', 'c']) AS i) WHERE n_regionkey = 0")
def for_rows(g):
    s = lifts.lift(g, "nation:regionkey", "=", 0)
    out = control.for_rows(s, ["item"], lambda f: F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda s: s)
    return out.df().select("n_nationkey", q("$item").alias("item"))


@query("SELECT c_custkey, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def subquery_value(g):
    s = lifts.lift(g, "customer")
    out = control.subquery_value(s, lambda x: pivots.pivot(x, "nation"), "nation").df()
    return out.join(g.tables("nation"), q("$nation") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def once(g):
    s = lifts.lift(g, "customer")
    before = s.map(lambda f, df: df.where("c_custkey % 3 = 0")).idens()
    state = before.select(F.lit("seen").alias("name"), "iden", F.lit(1).cast("bigint").alias("ts"))
    return cmd.once(s, "seen", state, 2)[0].df().select("c_custkey")


@query("SELECT 'BUILDING' AS valu, 1 AS one, count(*) AS count FROM customer WHERE c_mktsegment = 'BUILDING'")
def query_text(g):
    return run_text(g, "customer:mktsegment=BUILDING | stats.countby :mktsegment").withColumn("one", F.lit(1))


@query("SELECT o_orderpriority AS valu, count(*) AS count FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000 GROUP BY o_orderpriority")
def flagship(g):
    return run_text(g, FLAGSHIP.replace(":orderpriority", ":priority"))


# expressions and functions


@query("SELECT l_orderkey, l_linenumber, CAST(floor(-l_orderkey / 7.0) AS BIGINT) AS div, ((-l_orderkey % 7) + 7) % 7 AS mod, pow(l_linenumber, 2) AS sq FROM lineitem")
def expr_arith(g):
    n = -F.col("l_orderkey")
    return g.tables("lineitem").select("l_orderkey", "l_linenumber", text.floordiv(n, F.lit(7)).alias("div"), text.pymod(n, F.lit(7)).alias("mod"), F.pow("l_linenumber", F.lit(2)).alias("sq"))


@query("SELECT p_partkey, upper(p_name) AS up, reverse(p_name) AS rev, length(p_name) AS size, p_name[2:4] AS part, nullif(instr(p_name, 'wid'), 0) - 1 AS at, split_part(p_name, ' ', 1) AS head, lpad(p_partkey::VARCHAR, 12, '0') AS pad, replace(p_name, 'w', 'W') AS repl FROM part")
def str_functions(g):
    n = F.col("p_name")
    return g.tables("part").select(
        "p_partkey", F.upper(n).alias("up"), F.reverse(n).alias("rev"), F.length(n).alias("size"), text.slice_(n, 1, 4).alias("part"),
        text.find(n, "wid").alias("at"), text.split(n, " ", 1)[0].alias("head"), text.rjust(F.col("p_partkey").cast("string"), 12, "0").alias("pad"), text.replace(n, "w", "W").alias("repl"),
    )


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, (isodow(o_orderdate) - 1) AS dow, (dayofyear(o_orderdate) - 1) AS doy, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_ms(o_orderdate) AS ms FROM orders")
def time_functions(g):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return g.tables("orders").select(
        "o_orderkey", times.year(ms).alias("y"), times.month(ms).alias("m"), times.dayofweek(ms).alias("dow"), times.dayofyear(ms).alias("doy"),
        times.format_(ms, times.ISO8601).alias("iso"), ms.alias("ms"),
    )


@query("SELECT p_partkey, regexp_extract(p_brand, '([A-Z])[a-z]+#([0-9]+)', 2) AS num, regexp_matches(p_brand, '^(?:Bran)') AS hit, regexp_replace(p_brand, '([0-9])([0-9])', '\\2\\1', 'g') AS swap FROM part")
def regex_functions(g):
    b = F.col("p_brand")
    return g.tables("part").select(
        "p_partkey", text.regex_search(r"([A-Z])[a-z]+#([0-9]+)", b)[1].alias("num"), text.regex_matches("Bran", b).alias("hit"), text.regex_replace("([0-9])([0-9])", r"\2\1", b).alias("swap")
    )


@query("SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha256, lower(hex(p_name)) AS hex, base64(p_name::BLOB) AS b64 FROM part")
def hash_functions(g):
    n = F.col("p_name")
    return g.tables("part").select("p_partkey", binary.md5(n).alias("md5"), binary.sha256(n).alias("sha256"), binary.hex_encode(n).alias("hex"), binary.base64_encode(n, urlsafe=False).alias("b64"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_get(g):
    return g.tables("events").select("event_id", text.json_get(F.col("props"), "$.k", "bigint").alias("k"))


@query("SELECT vec_id, list_contains(embedding, 2.0::FLOAT) AS has, embedding[1]::DOUBLE AS head, embedding[-1]::DOUBLE AS tail, len(embedding[3:6]) AS n FROM embeddings")
def array_functions(g):
    e = F.col("embedding")
    return g.tables("embeddings").select("vec_id", text.list_has(e, F.lit(2.0).cast("float")).alias("has"), text.list_index(e, 0).cast("double").alias("head"), text.list_index(e, -1).cast("double").alias("tail"), F.size(text.list_slice(e, 2, 6)).alias("n"))


@query(r"SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS proto, lower(regexp_extract(url, '://([^:/?#]*)', 1)) AS host FROM pages WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]*([/?#]|$)')")
def url_parts(g):
    from graphloom.types import Url

    u = Url()
    rows = g.tables("pages").withColumn("_u", u.norm_col(F.col("url"))).where(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#@]*([/?#]|$)"))
    subs = u.subs(F.col("_u"))
    return rows.select("page_id", subs["proto"].alias("proto"), F.coalesce(subs["host"], F.lit("")).alias("host"))


@query("SELECT page_id, unnest(regexp_extract_all(url, '(?i)(?:https?|ftp|tcp)://[^\\s<>\"''\\]\\[]+[^\\s<>\"''\\]\\[.,;:!?)]')) AS url FROM pages")
def scrape_urls(g):
    rx = r"(?i)(?:https?|ftp|tcp)://[^\s<>\"'\]\[]+[^\s<>\"'\]\[.,;:!?)]"
    return g.tables("pages").select("page_id", F.explode(extract.gen_matches(F.col("url"), rx.removeprefix("(?i)"))).alias("url"))


@query()
def scrape(g):
    return extract.scrape(g.tables("documents"), "doc_id", "text")


@query()
def html_text(g):
    return g.tables("pages").select("page_id", extract.html_text(F.col("html")).alias("text"))


@query("SELECT DISTINCT x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_orderdate < y.o_orderdate + INTERVAL 3 DAY AND y.o_orderdate < x.o_orderdate + INTERVAL 3 DAY WHERE x.o_orderstatus = 'P' AND y.o_orderstatus = 'P'")
def interval_join(g):
    day = 86_400_000
    o = g.tables("orders").where("o_orderstatus = 'P'").withColumn("lo", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    a = o.select(F.col("o_orderkey").alias("a"), F.col("lo").alias("alo"), (F.col("lo") + 3 * day).alias("ahi"))
    b = o.select(F.col("o_orderkey").alias("b"), F.col("lo").alias("blo"), (F.col("lo") + 3 * day).alias("bhi"))
    return joins.interval_join(a, b, "alo", "ahi", "blo", "bhi", 3 * day).select("a", "b")


# layers, edits, log


def _fork(g: Graph) -> layers.View:
    """Nations below; on top renamed, tagged and new ones."""
    f = g.model.form("nation")
    base = edits.storage(g, f, g.frame(f))
    over = g.frame(f).where("n_nationkey % 5 = 0").withColumn("n_name", F.concat("n_name", F.lit("_NEW")))
    top = edits.storage(g, f, over).withColumn("props", F.map_filter("props", lambda k, _: k == "name")).withColumn("has_valu", F.lit(False))
    new = edits.storage(g, f, g.frame(f).where("n_nationkey < 3").withColumn("n_nationkey", F.col("n_nationkey") + 100)).withColumn("has_valu", F.lit(True))
    return layers.View((layers.Layer.of("top", top.unionByName(new)), layers.Layer.of("base", base)))


def _flat(df: DataFrame) -> DataFrame:
    p = lambda k: F.try_element_at("props", F.lit(k)).alias(k)
    return df.select("valu", p("name"), p("regionkey"))


_FORKED = "SELECT n_nationkey::VARCHAR AS valu, CASE WHEN n_nationkey % 5 = 0 THEN n_name || '_NEW' ELSE n_name END AS name, n_regionkey::VARCHAR AS regionkey FROM nation UNION ALL SELECT (n_nationkey + 100)::VARCHAR, n_name, n_regionkey::VARCHAR FROM nation WHERE n_nationkey < 3"


@query(_FORKED)
def fork_resolve(g):
    return _flat(_fork(g).nodes())


@query("SELECT valu FROM (" + _FORKED + ") WHERE name LIKE '%NEW' OR valu::INT >= 100")
def diff(g):
    return _fork(g).diff().select("valu")


@query(_FORKED)
def merge(g):
    merged = _fork(g).merge(apply=True)
    return _flat(layers.View(merged.layers[1:]).nodes())


@query("SELECT n_nationkey::VARCHAR AS valu, n_name AS name, n_regionkey::VARCHAR AS regionkey FROM nation")
def log_replay(g):
    f = g.model.form("nation")
    layer = layers.Layer.of("base", edits.storage(g, f, g.frame(f)))
    return _flat(layers.View((editlog.replay(editlog.to_edits(layer)),)).nodes())


@query("SELECT 'named' AS trigger, count(*) AS n FROM nation UNION ALL SELECT 'new', count(*) FROM nation")
def trigger_replay(g):
    f = g.model.form("nation")
    log = editlog.to_edits(layers.Layer.of("base", edits.storage(g, f, g.frame(f))))
    rules = [triggers.Trigger("named", "prop:set", "nation", prop="name"), triggers.Trigger("new", "node:add", "nation"), triggers.Trigger("tagged", "tag:add", tag="a.*")]
    return triggers.fired(log, rules).groupBy("trigger").agg(F.count("*").alias("n"))


@query("SELECT event_id AS offs, event_type AS item FROM events WHERE event_id BETWEEN 100 AND 199")
def queue_slice(g):
    return g.tables("events").select(F.col("event_id").alias("offs"), F.col("event_type").alias("item")).where("offs >= 100").orderBy("offs").limit(100)


@query("SELECT o_orderkey, 'hot' AS tag FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'hot.top' FROM orders WHERE o_totalprice > 400000")
def tag_add(g):
    s = edits.add_tag(lifts.lift(g, "orders:totalprice", ">", 400000), "hot.top", ("1995", "1996"))
    return s.df().select("o_orderkey", F.explode(F.filter(F.map_keys("tags"), lambda t: t.startswith("hot"))).alias("tag"))


@query("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_orderkey")
def tag_del(g):
    s = edits.del_tag(lifts.lift(g, "orders"), "priority")
    return s.df().select("o_orderkey", (F.size("tags") - 1).cast("bigint").alias("n"))  # status and status.x are left


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN NULL ELSE p_size END, 99) AS p_size FROM part")
def prop_set(g):
    s = lifts.lift(g, "part").map(lambda f, df: df.withColumn("p_size", F.when(F.col("p_size") <= 25, F.col("p_size"))))
    return edits.set_prop(s, "size", 99, mode="unset").df().select("p_partkey", "p_size")


@query("SELECT c_custkey AS n1, n_nationkey AS n2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def edge_add(g):
    e = edits.edges_between(lifts.lift(g, "customer:acctbal", ">", 9000), "lives", lambda s: pivots.pivot(s, "nation"))
    return e.select(F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("int").alias("n2"))


@query("SELECT s_suppkey::VARCHAR AS valu FROM supplier WHERE s_acctbal >= 0 OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def delnode(g):
    f = g.model.form("supplier")
    base = edits.storage(g, f, g.frame(f))
    links = g.tables("lineitem").where("l_quantity > 49").select(F.lit("x").alias("n1form"), F.lit("x").alias("n1"), F.lit("v").alias("verb"), F.lit("supplier").alias("n2form"), F.col("l_suppkey").cast("string").alias("n2"))
    gone = edits.storage(g, f, lifts.lift(g, "supplier:acctbal", "<", 0).df())
    return edits.delete_nodes(base, links, gone)[0].select("valu")


@query("SELECT c_custkey AS a, s_suppkey AS b FROM customer JOIN supplier ON s_acctbal BETWEEN c_acctbal - 1 AND c_acctbal + 1")
def range_join(g):
    c = g.tables("customer").select(F.col("c_custkey").alias("a"), (F.col("c_acctbal") - 1).alias("lo"), (F.col("c_acctbal") + 1).alias("hi"))
    s = g.tables("supplier").select(F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("x"))
    return joins.range_join(s, c, "x", "lo", "hi", 2).select("a", "b")


# the language's expressions, library calls and statements


def _lang(text: str, key: str, *names: str):
    """A query in text; its result is the key and the named variables of each row."""
    def run(g):
        df = run_text(g, text).df()
        return df.select(key, *[F.col(f"`${n}`").alias(n) for n in names])

    return run


def _register(name: str, text: str, key: str, sql: str, *names: str) -> None:
    fn = _lang(text, key, *names)
    fn.__name__ = name
    query(sql)(fn)


_register("lang_arith", "part $a=$(:size / 7) $b=$(-:size % 7) $c=$((:size + 1) * 2 - 3) $d=$(:retailprice / 2) $e=$(:size ** 2)", "p_partkey",
    "SELECT p_partkey, p_size // 7 AS a, ((-p_size % 7) + 7) % 7 AS b, (p_size + 1) * 2 - 3 AS c, p_retailprice / 2 AS d, p_size::DOUBLE * p_size AS e FROM part", "a", "b", "c", "d", "e")
_register("lang_logic", "part $a=$(:size > 10 and not :brand = 'Brand#13') $b=$(:type ~= 'econ' or :size <= 3) $c=$(:brand ^= 'Brand#2') +$($a or $b)", "p_partkey",
    """SELECT * FROM (SELECT p_partkey, p_size > 10 AND NOT p_brand = 'Brand#13' AS a, regexp_matches(p_type, '(?i)econ') OR p_size <= 3 AS b, starts_with(p_brand, 'Brand#2') AS c FROM part) WHERE a OR b""", "a", "b", "c")  # fmt: skip
_register("lang_format", "customer $n=(3) $t=`{:name} of {:mktsegment}: {$n + 1}`", "c_custkey",
    "SELECT c_custkey, c_name || ' of ' || c_mktsegment || ': 4' AS t FROM customer", "t")
_register("lang_text", "customer $s=$node.props.get(name) $a=$s.upper() $b=$s.slice(0, 4) $c=$s.replace('Customer', 'C') $d=$s.rjust(30, '.') $e=$s.find('#') $f=$s.split('#') $g=$s.startswith('Cust') $h=$s.endswith('7') $i=$s.reverse() $j=$s.size() $k=$s.strip('C0') $l=$s.ljust(20, '-')", "c_custkey",
    """SELECT c_custkey, upper(c_name) AS a, left(c_name, 4) AS b, replace(c_name, 'Customer', 'C') AS c, lpad(c_name, 30, '.') AS d, position('#' IN c_name) - 1 AS e,
    string_split(c_name, '#') AS f, starts_with(c_name, 'Cust') AS g, ends_with(c_name, '7') AS h, reverse(c_name) AS i, length(c_name) AS j, trim(c_name, 'C0') AS k, rpad(c_name, 20, '-') AS l FROM customer""",
    "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l")
_register("lang_regex", "part $a=$lib.regex.matches('^Br', :brand) $b=$lib.regex.replace('[0-9]+', 'N', :brand) $c=$lib.regex.findall('[A-Z]', :type)", "p_partkey",
    "SELECT p_partkey, regexp_matches(p_brand, '^Br') AS a, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS b, regexp_extract_all(p_type, '[A-Z]') AS c FROM part", "a", "b", "c")
_register("lang_list", "part $w=$(:type).split(' ') $a=$w.size() $b=$w.index(0) $c=$w.has('STEEL') $d=$w.slice(1) $e=$lib.sorted($w) $f=$w.reverse() $g=$w.append('x') $h=$w.extend((['y', 'z'])).size() $i=$lib.str.join('/', $w) $j=$w.unique().size()", "p_partkey",
    """SELECT p_partkey, len(w) AS a, w[1] AS b, list_contains(w, 'STEEL') AS c, w[2:] AS d, list_sort(w) AS e, list_reverse(w) AS f, list_append(w, 'x') AS g, len(w) + 2 AS h, array_to_string(w, '/') AS i, len(list_distinct(w)) AS j
    FROM (SELECT *, string_split(p_type, ' ') AS w FROM part)""", "a", "b", "c", "d", "e", "f", "g", "h", "i", "j")  # fmt: skip
_register("lang_bytes", "customer $b=$node.repr().encode() $a=$lib.crypto.hashes.md5($b) $c=$lib.crypto.hashes.sha256($b) $d=$lib.hex.encode($b) $e=$lib.base64.encode($b) $f=$lib.hex.decode($d).decode() $g=$b.gzip().gunzip().decode()", "c_custkey",
    "SELECT c_custkey, md5(k) AS a, sha256(k) AS c, lower(hex(k)) AS d, replace(replace(to_base64(k::BLOB), '+', '-'), '/', '_') AS e, k AS f, k AS g FROM (SELECT *, c_custkey::VARCHAR AS k FROM customer)", "a", "c", "d", "e", "f", "g")
_register("lang_time", "orders $t=$lib.time.parse($node.props.get(date).tostr(), '%Y-%m-%d %H:%M:%S') $a=$lib.time.year($t) $b=$lib.time.month($t) $c=$lib.time.day($t) $d=$lib.time.format($t, '%Y/%m/%d') $e=$lib.time.dayofyear($t) $f=$lib.time.hour($t) $g=$lib.time.dayofweek($t)", "o_orderkey",
    "SELECT o_orderkey, year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c, strftime(o_orderdate, '%Y/%m/%d') AS d, dayofyear(o_orderdate) - 1 AS e, hour(o_orderdate) AS f, isodow(o_orderdate) - 1 AS g FROM orders", "a", "b", "c", "d", "e", "f", "g")
_register("lang_node", "customer $a=$node.form() $b=$node.value() $c=$node.repr(name) $d=$node.ndef() $e=$node.iden() $f=$node.isform(customer) $g=$lib.len($d) $h=$lib.max(:nationkey, 12) $i=$lib.min(:nationkey, 12)", "c_custkey",
    "SELECT c_custkey, 'customer' AS a, c_custkey AS b, c_name AS c, ['customer', c_custkey::VARCHAR] AS d, sha256('customer' || chr(0) || c_custkey::VARCHAR) AS e, true AS f, 2 AS g, greatest(c_nationkey, 12) AS h, least(c_nationkey, 12) AS i FROM customer",
    "a", "b", "c", "d", "e", "f", "g", "h", "i")
_register("lang_tags", "orders +#status $t=$node.tags('status.*') $u=$node.globtags('status.*')", "o_orderkey",
    "SELECT o_orderkey, ['status.' || lower(o_orderstatus)] AS t, [lower(o_orderstatus)] AS u FROM orders", "t", "u")
_register("lang_if", "$z=none part if $(:size > 40) { $z=big } elif $(:size > 20) { $z=`mid {:size}` } $y=$($z != 'none')", "p_partkey",
    "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid ' || p_size ELSE 'none' END AS z, p_size > 20 AS y FROM part", "z", "y")
_register("lang_switch", "orders switch $lib.str.concat(:status, '!') { 'F!': { $w=fin } 'O!': { $w=open } *: { $w=other } }", "o_orderkey",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fin' WHEN 'O' THEN 'open' ELSE 'other' END AS w FROM orders", "w")
_register("lang_for_rows", "part for $w in $(:type.split(' ')) { $l=$w.lower() }", "p_partkey",
    "SELECT p_partkey, w, lower(w) AS l FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part)", "w", "l")
_register("lang_destructure", "part ($a, $b)=$(:brand.split('#')) ($c, $d)=(10, 20) $e=$($b + $c * $d)", "p_partkey",
    "SELECT p_partkey, string_split(p_brand, '#')[1] AS a, string_split(p_brand, '#')[2] AS b, string_split(p_brand, '#')[2]::DOUBLE + 200 AS e FROM part", "a", "b", "e")
@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_nationkey IN (1, 3, 5, 7)")
def lang_functions(g):
    """A function that returns, one that emits, one that yields nodes; loops with break and continue."""
    out = run_text(g, """
        function twice(x) { return(($x * 2)) }
        function odd(n) { $i=(0) while (true) { $i=($i + 1) if ($i > $n) { break } if ($i % 2 = 0) { continue } emit $i } }
        function rich(least) { customer:acctbal>$least }
        $keys=([]) for $k in $odd(7) { $keys.append($k) }
        yield $rich($twice(4500)) +:nationkey*in=$keys
    """)
    return out.df().select("c_custkey")


@query("SELECT p_partkey, 'caught no such part' AS mesg, 10 AS total, 'b' AS top, 3 AS n, 9 AS d FROM part WHERE p_size = 1")
def lang_driver(g):
    """Statements over constants: init, try, for, tallies, dicts; their values end up on rows."""
    return _lang("""
        $mesg=none $total=(0) $tally=$lib.stats.tally() init { $n=(3) }
        try { $lib.raise(NoPart, 'no such part') } catch (Other, NoPart) as e { $mesg=`caught {$e.mesg}` }
        for $i in $lib.range(5) { $total=($total + $i) }
        for ($k, $v) in ([['a', 1], ['b', 5], ['a', 2]]) { $tally.inc($k, $v) }
        $top=$tally.sorted(reverse=(true)).0.0
        $own=({'x': 1, 'list': ([5, 7])}) $own.more = 2 $own.gone = 1 $lib.dict.pop($own, gone) $sum=($own.list.1 + $own.more)
        part:size=1 if $(:size = 1) { $mesg=$mesg $total=$total $top=$top $n=$n $d=$sum }
    """, "p_partkey", "mesg", "total", "top", "n", "d")(g)


# stored tags with times, tag properties, node data


def _marked(g: Graph) -> Graph:
    """Orders that store a tag with times, a tag property for the dear ones, node data for the urgent ones."""
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    day = F.struct(ms.alias("min"), (ms + 86_400_000).alias("max"))
    band = F.create_map(F.lit("price.band"), F.create_map(F.lit("level"), F.floor(F.col("o_totalprice") / 100_000).cast("string")))
    rows = (
        g.tables("orders")
        .withColumn("tags", F.map_from_arrays(F.array(F.lit("seen"), F.lit("seen.day")), F.array(F.lit(None).cast("struct<min:bigint,max:bigint>"), day)))
        .withColumn("tagprops", F.when(F.col("o_totalprice") >= 100_000, band))
        .withColumn("nodedata", F.when(F.col("o_orderpriority") == "1-URGENT", F.create_map(F.lit("rush"), F.lit("1"))))
    )
    return Graph(g.spark, g.model, lambda name: rows if name == "orders" else g.tables(name))


def _orders(s: Stream) -> DataFrame:
    return s.df("orders").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000")
def lift_tagprop(g):
    return _orders(lifts.lift_tagprop(_marked(g), "price.band", "level", Int(), ">=", 3))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000")
def lift_form_tagprop(g):
    return _orders(lifts.lift_tagprop(_marked(g), None, "level", Int(), form="orders"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01' AND o_orderdate + INTERVAL 1 DAY > TIMESTAMP '1996-03-01'")
def lift_tag_at(g):
    return _orders(lifts.lift_tag(_marked(g), "seen.day", "orders", at=("1996/03/01", "1996/07/01")))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def lift_nodedata(g):
    return _orders(lifts.lift_nodedata(_marked(g), "rush", "orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 2, 30)")
def lift_idens(g):
    idens = [hashlib.sha256(f"customer\0{k}".encode()).hexdigest() for k in (1, 2, 30)]
    return lifts.lift_idens(g, [*idens, "no iden"], "customer").df().select("c_custkey", "c_name")


@query("SELECT 'nation' AS form, s_nationkey::VARCHAR AS valu FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM supplier WHERE s_acctbal > 5000")
def yield_values(g):
    rich = lifts.lift(g, "supplier:acctbal", ">", 5000).let(x=F.col("s_nationkey"))
    return lifts.yield_values(rich, "x", "nation").ndefs()


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01' AND o_orderdate + INTERVAL 1 DAY > TIMESTAMP '1996-03-01' AND o_orderstatus = 'F'")
def filter_tag_at(g):
    return _orders(where(lifts.lift(_marked(g), "orders"), Tag("seen.day", "@=", ("1996/03/01", "1996/07/01")) & Prop("status", "=", "F")))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <> TIMESTAMP '1996-03-01'")
def filter_tag_unlike(g):
    return _orders(where(lifts.lift(_marked(g), "orders"), Tag("seen.day", "!=", ("1996/03/01", "1996/03/02"))))


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def filter_tag_glob(g):
    return where(lifts.lift(g, "customer"), Tag("credit.*") | Tag("segment.b*")).df().select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'O'")
def filter_tagprop_has(g):
    return _orders(where(lifts.lift(_marked(g), "orders"), TagProp("price.*", "level") & Prop("status", "!=", "O")))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
def filter_tagprop(g):
    return _orders(where(lifts.lift(_marked(g), "orders"), TagProp("price.band", "level", "<", 2, Int())))


def _map_rows(s: Stream, name: str) -> DataFrame:
    return s.df("orders").select("o_orderkey", F.explode(name).alias("key", "value"))


@query("SELECT o_orderkey, unnest(CASE WHEN o_orderpriority = '1-URGENT' THEN ['status', 'status.' || lower(o_orderstatus)] ELSE ['priority', 'priority.' || trim(regexp_replace(lower(substr(o_orderpriority, 3)), '[^a-z0-9]+', '_', 'g'), '_'), 'status', 'status.' || lower(o_orderstatus)] END) AS tag FROM orders")
def tag_prune(g):
    return _map_rows(edits.prune_tag(lifts.lift(g, "orders"), "priority.urgent"), "tags").select("o_orderkey", F.col("key").alias("tag"))


@query("SELECT o_orderkey, unnest(['state', 'state.of', 'state.of.' || lower(o_orderstatus)]) AS tag FROM orders")
def tag_move(g):
    moved = _map_rows(edits.move_tag(lifts.lift(g, "orders"), "status", "state.of"), "tags")
    return moved.where(~F.col("key").startswith("priority")).select("o_orderkey", F.col("key").alias("tag"))


@query("SELECT o_orderkey, 'hot.top' AS key, 'score' AS prop, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'price.band', 'level', floor(o_totalprice / 100000)::BIGINT::VARCHAR FROM orders WHERE o_totalprice >= 100000")
def tagprop_set(g):
    s = edits.set_tagprop(lifts.lift(_marked(g), "orders"), "hot.top", "score", F.col("o_orderstatus"))
    return _map_rows(s, "tagprops").select("o_orderkey", "key", F.explode("value").alias("prop", "value"))


@query("SELECT o_orderkey, 0::BIGINT AS n FROM orders WHERE o_totalprice >= 100000")
def tagprop_del(g):
    s = edits.del_tagprop(lifts.lift(_marked(g), "orders"), "price.band", "level")
    return _map_rows(s, "tagprops").select("o_orderkey", F.size("value").cast("bigint").alias("n"))


@query("SELECT o_orderkey, 'note' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'rush', '1' FROM orders WHERE o_orderpriority = '1-URGENT'")
def nodedata_set(g):
    return _map_rows(edits.set_data(lifts.lift(_marked(g), "orders"), "note", F.col("o_orderstatus")), "nodedata")


@query("SELECT o_orderkey, 'note' AS key, 'x' AS value FROM orders")
def nodedata_pop(g):
    return _map_rows(edits.pop_data(edits.set_data(lifts.lift(_marked(g), "orders"), "note", "x"), "rush"), "nodedata")


@query("SELECT vec_id, len(embedding) + 1 AS n, 9.5::DOUBLE AS last FROM embeddings")
def array_edit(g):
    s = edits.edit_array(lifts.lift(g, "embedding"), "vector", add=[9.5, 7.25], remove=[7.25])
    return s.df().select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.element_at("embedding", -1).cast("double").alias("last"))


@query("SELECT p_partkey, NULL::VARCHAR AS brand, p_name AS name FROM part")
def prop_del(g):
    return edits.del_prop(lifts.lift(g, "part"), "brand").df().select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))


# edges, blocks and pivots over subqueries


@query("SELECT n1, count(*) AS n FROM (SELECT DISTINCT l_suppkey AS n1, l_partkey FROM lineitem) JOIN supplier ON n1 = s_suppkey WHERE s_acctbal >= 0 GROUP BY n1")
def edges_del(g):
    left = edits.edges_del(walks.edges(g, ["supplies"]), lifts.lift(g, "supplier:acctbal", "<", 0), "supplies")
    return left.groupBy(F.col("n1").cast("bigint").alias("n1")).agg(F.count("*").alias("n"))


@query("SELECT 'supplies' AS verb UNION ALL SELECT 'bought'")
def edge_verbs(g):
    return walks.edge_verbs(g)


@query("SELECT 'customer' AS n1form, 'nationkey' AS verb, 'nation' AS n2form, count(*) AS n FROM customer UNION ALL SELECT 'supplier', 'nationkey', 'nation', count(*) FROM supplier UNION ALL SELECT 'nation', 'regionkey', 'region', count(*) FROM nation UNION ALL SELECT 'orders', 'custkey', 'customer', count(*) FROM orders")
def references(g):
    kinds = walks.references(g).groupBy("n1form", "verb", "n2form").agg(F.count("*").alias("n"))
    return kinds.where(F.col("n1form").isin("customer", "supplier", "nation", "orders"))


@query("WITH s AS (SELECT * FROM supplier WHERE s_acctbal > 8000) SELECT 'nation' AS form, s_nationkey::VARCHAR AS valu FROM s UNION ALL SELECT 'part', p::VARCHAR FROM (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem) JOIN s ON l_suppkey = s_suppkey")
def pivot_out_edges(g):
    return pivots.pivot_out(lifts.lift(g, "supplier:acctbal", ">", 8000), edges=True).ndefs()


@query("WITH p AS (SELECT * FROM part WHERE p_size = 7), l AS (SELECT * FROM lineitem JOIN p ON l_partkey = p_partkey) SELECT 'lineitem' AS form, count(*) AS n FROM l UNION ALL SELECT 'supplier', count(DISTINCT (l_suppkey, l_partkey)) FROM l UNION ALL SELECT 'customer', count(DISTINCT (o_custkey, l_partkey)) FROM l JOIN orders ON l_orderkey = o_orderkey")
def pivot_in_edges(g):
    return pivots.pivot_in(lifts.lift(g, "part:size", "=", 7), edges=True).ndefs().groupBy("form").agg(F.count("*").alias("n"))


@query("SELECT 'region' AS form, n_regionkey::VARCHAR AS valu FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def pivot_raw(g):
    two = lambda s: pivots.pivot(pivots.pivot(s, "nation"), "region")
    return pivots.raw_pivot(lifts.lift(g, "customer:acctbal", ">", 9000), two).ndefs()


@query("SELECT o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000")
def pivot_where(g):
    return _orders(pivots.pivot_where(lifts.lift(g, "customer:mktsegment", "=", "BUILDING"), "orders", Prop("totalprice", ">", 300000)))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def pivot_from_tags(g):
    tags = g.spark.createDataFrame([("priority.high",), ("status.p",), ("no.such",)], "tag string")
    return _orders(pivots.from_tags(g, tags, "orders"))


@query("SELECT 'region' AS form, r_regionkey::VARCHAR AS valu FROM region UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation")
def block_init(g):
    return control.init(g, lifts.lift(g, "nation"), lambda g: lifts.lift(g, "region")).ndefs()


@query("SELECT 'region' AS form, r_regionkey::VARCHAR AS valu FROM region")
def block_empty(g):
    return control.empty(lifts.lift(g, "nation:name", "=", "no such nation"), lambda g: lifts.lift(g, "region")).ndefs()


@query("SELECT 'nation' AS form, n_nationkey::VARCHAR AS valu FROM nation UNION ALL SELECT 'region', n_regionkey::VARCHAR FROM nation")
def block_fini(g):
    return control.fini(lifts.lift(g, "nation"), lambda s: pivots.pivot(s, "region")).ndefs()


@query("SELECT 'caught' AS what, count(*) AS n FROM region")
def block_try(g):
    got = control.try_(lambda: lifts.lift(g, "nosuch"), {"NoSuchForm": lambda e: lifts.lift(g, "region")})
    return cmd.count(got).toDF("n").select(F.lit("caught").alias("what"), "n")


@query("SELECT 'region' AS form, n_regionkey::VARCHAR AS valu FROM nation")
def macro_exec(g):
    cmd.macro_set(g, "up", lambda s: pivots.pivot(s, "region"))
    return cmd.macro_exec(lifts.lift(g, "nation"), "up").ndefs()


@query("SELECT o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def parallel(g):
    return _orders(cmd.parallel(lifts.lift(g, "customer:acctbal", ">", 9000), lambda s: pivots.pivot(s, "orders")))


@query("SELECT 'orders' AS form, o_orderkey::VARCHAR AS valu, o_orderkey::VARCHAR AS repr FROM orders")
def node_repr(g):
    return cmd.node_repr(lifts.lift(g, "orders"))


# layers beyond forks, feeds, windows


@query("SELECT * FROM (" + _FORKED + ") WHERE regionkey = '1'")
def copyto(g):
    view = _fork(g)
    to = layers.View((layers.Layer.empty(g.spark, "to"),))
    return _flat(view.copy_to(view.nodes().where(F.try_element_at("props", F.lit("regionkey")) == "1"), to).nodes())


@query(_FORKED)
def movenodes(g):
    view = _fork(g)
    return _flat(view.move(view.nodes().where(F.try_element_at("props", F.lit("regionkey")) == "1"), 1).nodes())


@query("SELECT DISTINCT name AS valu FROM (" + _FORKED + ")")
def view_prop_values(g):
    return _fork(g).prop_values("nation", "name")


@query("SELECT 'nation' AS form, count(*) AS count FROM (" + _FORKED + ")")
def view_form_counts(g):
    return _fork(g).form_counts()


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS valu FROM nation UNION ALL SELECT r_name, md5('nation' || chr(0) || r_name) FROM region")
def gen_nodes(g):
    f = g.model.form("nation")
    made = edits.get_or_create(edits.storage(g, f, g.frame(f)), "nation", g.tables("region").select(F.col("r_name").alias("name")), "name")
    return made.select(F.try_element_at("props", F.lit("name")).alias("name"), "valu")


@query("SELECT 'supplier' AS form, s_suppkey::VARCHAR AS valu, s_name AS name FROM supplier")
def csv_nodes(g):
    rows = feeds.csv_nodes(g.tables("supplier"), "supplier", "s_suppkey", {"name": "s_name", "nationkey": "s_nationkey"})
    return rows.select("form", "valu", F.try_element_at("props", F.lit("name")).alias("name"))


@query("SELECT 'part' AS form, p_partkey::VARCHAR AS valu, p_name AS name, p_size::VARCHAR AS size FROM part")
def feed_pack(g):
    f = g.model.form("part")
    line = lambda path: F.get_json_object("value", path)
    packed = feeds.pack(edits.storage(g, f, g.frame(f)))
    return packed.select(line("$[0][0]").alias("form"), line("$[0][1]").alias("valu"), line("$[1].props.name").alias("name"), line("$[1].props.size").alias("size"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(g):
    return queues.windows(g.tables("events"), "ts", "1 day", by=["event_type"]).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
