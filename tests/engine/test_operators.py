import pytest
from pyspark.sql import functions as F

from graphloom.errors import BadArg, NoSuchForm, NoSuchPivot, NoSuchProp
from graphloom.graph import Graph, q
from graphloom.model import Form, Model, bare_tags
from graphloom.operators import commands as cmd
from graphloom.operators import control, edits, lifts, pivots, subgraph, walks
from graphloom.operators.filters import ArrayHas, IsForm, Prop, Subq, Tag, TagProp, where
from graphloom.plans.language import run_text
from graphloom.types import Int


def vals(stream):
    return sorted((r.form, r.valu) for r in stream.ndefs().collect())


def names(stream):
    return sorted(v for _, v in vals(stream))


def test_lifts(g):
    assert names(lifts.lift(g, "test:str")) == ["a", "b", "c"]
    assert names(lifts.lift(g, "test:str:hehe")) == ["a", "c"]
    assert names(lifts.lift(g, "test:str:tick", ">=", 2000)) == ["b"]
    assert len(vals(lifts.lift(g, "named"))) == 9
    assert len(vals(lifts.lift(g, "test:*"))) == 6
    assert names(lifts.lift(g, "test:int", "in=", [1, 1, 2])) == ["1", "1", "2"]  # a repeated item repeats its rows
    assert names(lifts.lift_array(g, "test:str:ns", "=", 2)) == ["a", "a"]  # one per matching element
    assert names(lifts.lift(g, "test:str:n::loc", "^=", "us.va")) == ["a"]
    assert names(lifts.lift_tag(g, "foo.bar", at=(15, 16))) == ["a"] and not names(lifts.lift_tag(g, "foo", at=(15, 16)))
    assert names(lifts.lift_tag(g, "baz", "test:str")) == ["b"]
    assert names(lifts.lift_tagprop(g, "foo.bar", "score", Int(), ">", 5)) == ["a"]
    assert names(lifts.lift_nodedata(g, "k")) == ["a"]
    iden = lifts.lift(g, "test:str", "=", "b").idens().first().iden
    assert names(lifts.lift_idens(g, [iden, "junk"])) == ["b"]
    assert names(lifts.yield_values(lifts.lift(g, "test:str", "=", "a").let(x=F.col("ns")), "x", "test:int")) == ["1", "2", "2", "a"]
    for bad, err in (("newp", NoSuchForm), ("test:str:newp", NoSuchProp)):
        with pytest.raises(err):
            lifts.lift(g, bad)


def test_filters_are_two_valued(g):
    s = lifts.lift(g, "test:str")
    assert names(where(s, Prop("hehe", "=", "x"))) == ["a"]
    assert names(where(s, Prop("hehe", "=", "x"), keep=False)) == ["b", "c"]
    assert names(where(s, Prop("hehe", "!=", "x"))) == ["c"]  # null differs from nothing
    assert names(where(s, ~Prop("hehe", "!=", "x"))) == ["a", "b"]
    assert names(where(s, Prop("hehe", "~=", "^x$"))) == ["a", "c"]
    assert names(where(s, ArrayHas("ns", ">", 1))) == ["a"]
    assert names(where(s, Prop("n::int2"))) == ["a", "b"]
    assert names(where(s, Tag("foo.*"))) == ["a"] and names(where(s, Tag("*"))) == ["a", "b"]
    assert names(where(s, Tag("foo.bar", "!=", (10, 20)))) == ["b", "c"]  # true without the tag
    assert names(where(s, TagProp("foo.*", "score"))) == ["a"] and names(where(s, TagProp("foo.bar", "score", ">", 5, Int()))) == ["a"]
    both = s.union(lifts.lift(g, "inet:ipv4", "=", "1.2.3.0-1.2.3.1"))
    assert len(vals(both)) == 5 and names(where(both, IsForm("inet:ipv4"), keep=False)) == ["a", "b", "c"]


def test_subqueries(g):
    s = lifts.lift(g, "test:str")
    out = lambda x: walks.walk(x, ["refs"])
    assert names(where(s, Subq(out))) == ["a", "b"] and names(where(s, Subq(out), keep=False)) == ["c"]
    assert names(where(s, Subq(out, ">=", 2))) == ["a"] and names(where(s, Subq(out, "<", 2))) == ["b", "c"]
    assert names(where(s, Subq(out, "=", 0))) == ["c"] and names(where(s, Subq(out, "=", 1) | Prop("hehe", "=", "X"))) == ["b", "c"]


def test_pivots(g):
    s = lifts.lift(g, "test:str")
    assert names(pivots.prop_pivot(s, "n", "test:int")) == ["1", "2"]
    assert names(pivots.prop_pivot(s, "ns")) == ["1", "2", "2"]
    assert names(pivots.pivot(s, "test:int")) == ["1", "1", "2", "2", "2"]
    assert names(pivots.pivot(lifts.lift(g, "test:int", "=", 2), "test:str")) == ["a", "a", "b"]
    assert vals(pivots.pivot(lifts.lift(g, "test:str", "=", "c"), "test:int", join=True)) == [("test:str", "c")]  # the row stays without a target
    assert names(pivots.pivot_out(lifts.lift(g, "test:int"))) == ["1", "2"]  # 1 refers to itself
    assert names(pivots.pivot_in(lifts.lift(g, "test:int", "=", 1))) == ["1", "2", "a", "a"]
    with pytest.raises(NoSuchPivot):
        pivots.pivot(s, "inet:ipv4")
    assert sorted(r.tag for r in pivots.to_tags(s).collect()) == ["baz", "foo.bar"]
    assert sorted(r.tag for r in pivots.to_tags(s, "*").collect()) == ["baz", "foo", "foo.bar"]
    carried = pivots.pivot(s.let(x=F.col("hehe")), "test:int").df()
    assert "$x" in carried.columns


def test_walks(g):
    s = lifts.lift(g, "test:str")
    assert len(vals(walks.walk(s, ["refs"], "inet:ipv4"))) == 3
    assert not vals(walks.walk(s, ["ref"]))  # exact, not a prefix
    assert names(walks.walk(lifts.lift(g, "inet:ipv4", "=", "1.2.3.2"), ["*"], reverse=True)) == ["a", "b"]
    assert len(vals(walks.walk(s, ["*"], "inet:ipv4", "=", "1.2.3.2"))) == 2
    assert len(vals(walks.walk(s, ["refs"], join=True))) == 6
    assert names(walks.lift_byverb(g, "refs")) == ["a", "b"] and len(vals(walks.lift_byverb(g, "refs", n2=True))) == 2
    with pytest.raises(BadArg):
        walks.walk(s, ["*"], "*", "=", 1)


def test_commands(g):
    s = lifts.lift(g, "test:str")
    assert names(cmd.limit(s, 2)) == ["a", "b"] and names(cmd.limit(s, 0)) == ["a"]
    assert len(vals(cmd.limit(lifts.lift(g, "named"), 7))) == 7
    assert names(cmd.uniq(s.union(s))) == ["a", "b", "c"] and names(cmd.uniq(s, "n")) == ["a", "b"]
    assert names(cmd.top(s, ":tick")) == ["b"] and names(cmd.top(s, ":seen", largest=False)) == ["a"] and names(cmd.top(s, ":tick", 5)) == ["a", "b"]
    assert cmd.count(s).first()[0] == 3 and not vals(cmd.spin(s))
    assert [tuple(r) for r in cmd.countby(s.union(s), ":hehe").collect()] == [("X", 2), ("x", 2)]
    assert "x | 2" in cmd.chart(cmd.countby(s.union(s), ":hehe"))
    ints = lifts.lift(g, "test:int", "in=", [1, 2])
    assert names(cmd.intersect(lifts.lift(g, "test:str", "in=", ["a", "b"]), lambda x: walks.walk(x, ["refs"]))) == [str(0x01020302)]
    assert len(vals(cmd.tee(ints, [lambda x: x, lambda x: pivots.pivot_out(x)], join=True))) == 5
    assert names(cmd.tree(lifts.lift(g, "test:int", "=", 2), lambda x: where(pivots.pivot_in(x), IsForm("test:int")))) == ["2", "3"]
    with pytest.raises(BadArg):  # 1 refers to itself
        cmd.tree(lifts.lift(g, "test:int", "=", 1), lambda x: where(pivots.pivot_in(x), IsForm("test:int")), depth=3)
    b = cmd.batch(s, 2).groupBy("batch").count().collect()
    assert all(r["count"] <= 2 for r in b)
    state = g.spark.createDataFrame([], "name string, iden string, ts bigint")
    passed, state = cmd.once(cmd.limit(s, 2), "k", state, 5)
    assert names(passed) == ["a", "b"]
    again, _ = cmd.once(s, "k", state, 6)
    assert names(again) == ["c"] and names(cmd.once(s, "k", state, 9, asof=7)[0]) == ["a", "b", "c"]
    cmd.macro_set(g, "m", lambda x: cmd.limit(x, 1))
    assert names(cmd.macro_exec(s, "m")) == ["a"]


def test_control(g):
    s = lifts.lift(g, "test:str")
    one = control.if_(s, [(Prop("hehe", "=", "x"), lambda x: x.let(v=F.lit(1)))]).df()
    assert sorted((r["s"], r["$v"]) for r in one.collect()) == [("a", 1), ("b", None), ("c", None)]  # without else they pass
    assert names(control.switch(s, "hehe", {"x": cmd.spin})) == ["b", "c"]
    rows = control.for_rows(s, ["i"], lambda f: F.col("ns"), lambda x: x).df()
    assert sorted(r["$i"] for r in rows.collect()) == [1, 2, 2]
    assert control.while_(0, lambda x: x < 5, lambda x: x + 2) == 6
    assert names(control.empty(cmd.spin(s), lambda gr: lifts.lift(gr, "test:int"))) == ["1", "2", "3"]
    assert names(control.empty(s, lambda gr: lifts.lift(gr, "test:int"))) == ["a", "b", "c"]
    assert control.try_(lambda: lifts.lift(g, "newp"), {"NoSuchForm": lambda e: "caught"}) == "caught"
    v = control.subquery_value(s, lambda x: pivots.prop_pivot(x, "n", "test:int"), "v").df()
    assert sorted((r["s"], r["$v"]) for r in v.collect()) == [("a", 1), ("b", 2), ("c", None)]
    arr = control.subquery_value(s, lambda x: pivots.prop_pivot(x, "ns", "test:int"), "v", array=True).df()
    assert {r["s"]: r["$v"] for r in arr.collect()}["a"] == [1, 2, 2]
    with pytest.raises(Exception, match="more than 1"):
        control.subquery_value(s, lambda x: pivots.prop_pivot(x, "ns", "test:int"), "v").df().collect()


def test_subgraph(g):
    nodes, edges = subgraph.project(lifts.lift(g, "test:str", "=", "a"), subgraph.Rules(degrees=2))
    assert sorted((r.form, r.valu, r["$degree"]) for r in nodes.ndefs("$degree").collect()) == [
        ("inet:ipv4", str(0x01020301), 1), ("inet:ipv4", str(0x01020302), 1), ("test:int", "1", 1), ("test:int", "2", 1), ("test:str", "a", 0),
    ]
    got = {(r.n1, r.verb, r.n2) for r in edges.collect()}
    assert ("a", "refs", str(0x01020301)) in got and ("2", "int2", "1") in got and ("3", "int2", "2") not in got
    few, _ = subgraph.project(lifts.lift(g, "test:str", "=", "a"), subgraph.Rules(degrees=2, filters=(~IsForm("inet:ipv4"),)))
    assert "inet:ipv4" not in few.forms() or not few.df("inet:ipv4").count()
    star, _ = subgraph.project(lifts.lift(g, "test:str", "=", "a"), subgraph.Rules(degrees=1, edgelimit=1))
    assert names(star) == ["a"]


def test_edits(g):
    s = lifts.lift(g, "test:str")
    col = lambda st, c: {r["s"]: r[c] for r in st.df().collect()}
    assert col(edits.set_prop(s, "hehe", "new", mode="unset"), "hehe") == {"a": "x", "b": "new", "c": "X"}
    merged = col(edits.set_prop(s, "seen", (15, 40)), "seen")
    assert (merged["a"]["min"], merged["a"]["max"]) == (10, 40) and (merged["c"]["min"], merged["c"]["max"]) == (15, 40)
    assert col(edits.edit_array(s, "ns", add=[9], remove=[2]), "ns")["a"] == [1, 2, 9]
    assert set(col(edits.del_prop(s, "hehe"), "hehe").values()) == {None}
    t = col(edits.add_tag(s, "foo.bar", (15, 50)), "tags")
    assert (t["a"]["foo.bar"]["min"], t["a"]["foo.bar"]["max"]) == (10, 50) and set(t["c"]) == {"foo", "foo.bar"} and t["c"]["foo"] is None
    assert col(edits.add_tag(s, "foo.bar"), "tags")["a"]["foo.bar"]["max"] == 20  # no time keeps the old
    gone = edits.del_tag(s, "foo")
    assert col(gone, "tags")["a"] == {} and col(gone, "tagprops")["a"] == {}
    assert col(edits.prune_tag(s, "foo.bar"), "tags")["a"] == {}
    assert set(col(edits.move_tag(s, "foo", "x.y"), "tags")["a"]) == {"x", "x.y", "x.y.bar"}
    tp = edits.set_tagprop(s, "new.one", "score", "3")
    assert col(tp, "tagprops")["c"] == {"new.one": {"score": "3"}} and "new" in col(tp, "tags")["c"]
    assert col(edits.del_tagprop(s, "foo.bar", "score"), "tagprops")["a"] == {"foo.bar": {}}
    assert col(edits.pop_data(edits.set_data(s, "z", "1"), "k"), "nodedata") == {"a": {"z": "1"}, "b": {"z": "1"}, "c": {"z": "1"}}
    assert edits.node(g, "inet:ipv4", ["1.2.0.0/30", "1.1.1.1"]).count() == 5
    assert edits.node(g, "inet:ipv4", ["junk", "1.1.1.1"], lenient=True).count() == 1
    form = g.model.form("test:str")
    base = edits.storage(g, form, s.df())
    assert edits.add_nodes(base, base).count() == 3
    back = edits.typed(form, base)
    assert sorted((r.s, r.n, r.ns) for r in back.select("s", "n", "ns").collect())[0] == ("a", 1, [1, 2, 2])
    e = edits.edges_between(s, "likes", lambda x: pivots.prop_pivot(x, "n", "test:int"))
    assert edits.add_edges(e, e).count() == 2 and edits.del_edges(e, e).count() == 0
    assert edits.edges_del(e, lifts.lift(g, "test:str", "=", "a"), "likes").count() == 1
    made = edits.get_or_create(base, "test:str", g.spark.createDataFrame([("x",), ("fresh",)], "name string"), "hehe")
    assert made.count() == 4


@pytest.mark.parametrize(
    "text, want",
    [
        ("test:str", ["a", "b", "c"]), ("test:str=a", ["a"]), ("test:str +:hehe=x", ["a"]), ("test:str -:hehe", ["b"]),
        ("test:str +(:hehe=x or :n=2)", ["a", "b"]), ("test:str +(:hehe and not :hehe=x)", ["c"]), ("test:str :n -> test:int", ["1", "2"]),
        ("test:int=2 -> test:str | uniq", ["a", "b"]), ("test:str -(refs)> * | uniq", [str(0x01020301), str(0x01020302)]),
        ("inet:ipv4=1.2.3.2 <(refs)- test:str", ["a", "b"]), ("test:str +{ -(refs)> * }>=2", ["a"]), ("test:str -{ -(refs)> * }", ["c"]),
        ("#foo.bar", ["a"]), ("test:str#baz", ["b"]), ("test:str +#foo.*", ["a"]), ("test:int test:str=a", ["1", "2", "3", "a"]),
        ("test:str | max :tick", ["b"]), ("test:str | limit 2", ["a", "b"]), ("$x=b test:str=$x", ["b"]), ("test:str:ns*[=2]", ["a", "a"]),
        ("test:int +:loc^=us.va", ["1"]), ("test:int=1 <- test:int", ["1", "2"]), ("test:str*in=(a, c)", ["a", "c"]),
        ("test:str if (:hehe=x) { -> test:int } else { | spin }", ["1", "1", "2", "2"]), ("test:str=a -+> test:int | uniq", ["1", "2", "a"]),
        ("test:str=a yield { -(refs)> * }", [str(0x01020301), str(0x01020302), "a"]), ("test:str:n::loc=us.va", ["a"]), ("test:str +:n::loc=us.va // why", ["a"]),
        ("test:str | tee { -> test:int } { -(refs)> * } | uniq", ["1", str(0x01020301), str(0x01020302), "2"]), ("", []),
        ("test:str switch :hehe { x: { | spin } *: { +:n } }", ["b"]), ("lift.byverb refs", ["a", "b"]), ("test:str=a | graph --degrees 1 | spin", []),
    ],
)
def test_language(g, text, want):
    assert names(run_text(g, text)) == sorted(want)


def test_language_edits(g):
    rows = {r["s"]: r for r in run_text(g, "test:str [ :hehe=new +#x.y=(10, 20) -#foo :ns+=7 -:n +#x.y:score=3 ]").df().collect()}
    assert {r["hehe"] for r in rows.values()} == {"new"} and {r["n"] for r in rows.values()} == {None}
    assert set(rows["a"]["tags"]) == {"x", "x.y"} and rows["a"]["tags"]["x.y"]["max"] == 20 and rows["a"]["ns"] == [1, 2, 2, 7] and rows["c"]["ns"] == [7]
    assert rows["b"]["tagprops"] == {"x.y": {"score": "3"}}
    got = {r["ip"]: r["asn"] for r in run_text(g, "[ inet:ipv4=1.2.3.0/29 inet:ipv4?=junk ]").df().collect()}
    assert len(got) == 8 and got[0x01020302] == 2 and got[0x01020307] is None
    assert names(run_text(g, "[ test:str=new :hehe=q ] +:hehe=q")) == ["new"]


def test_language_for(g):
    assert names(run_text(g, "for $x in (1, 2) { test:int=$x }")) == ["1", "2"]


def test_language_tables(g):
    assert [tuple(r) for r in run_text(g, "test:str | stats.countby :hehe --size 1").collect()] == [("X", 1)]
    assert run_text(g, "test:str | count").first()[0] == 3
    assert names(run_text(g, "test:str=$who", {"vars": {"who": "c"}})) == ["c"]
    assert names(run_text(g, "test:str", {"limit": 1})) == ["a"]
    row = run_text(g, "test:str $x=:hehe +$x=x").df()
    assert [r["$x"] for r in row.select(q("$x")).collect()] == ["x"]


def test_subgraph_edges_whole(spark, model):
    n = 101_000
    t = {
        "ints": spark.range(n).selectExpr("id AS n", "CAST(NULL AS string) AS loc", f"(id + 1) % {n} AS int2"),
        "strs": spark.createDataFrame([("a",)], "s string").selectExpr("s", "CAST(NULL AS bigint) AS n", "CAST(array() AS array<bigint>) AS ns"),
        "ips": spark.range(3_001).selectExpr("id AS ip", "id AS asn"),
        "refs": spark.range(3_001).selectExpr("'a' AS n1", "id AS n2"),
    }
    big = Graph(spark, model, t.__getitem__)
    _, edges = subgraph.project(lifts.lift(big, "test:int"), subgraph.Rules(degrees=1, edges=False))
    assert edges.count() == n
    nodes, edges = subgraph.project(lifts.lift(big, "test:str"), subgraph.Rules(degrees=1))
    assert nodes.df("inet:ipv4").count() == edges.count() == 3_001


def test_subgraph_nodes_whole(spark, model):
    n = 60_000
    t = {
        "ints": spark.range(2 * n).selectExpr("id AS n", "CAST(NULL AS string) AS loc", f"id + {n} AS int2"),
        "strs": spark.createDataFrame([], "s string, n bigint, ns array<bigint>"),
    }
    big = Graph(spark, model, t.__getitem__)
    nodes, _ = subgraph.project(lifts.lift(big, "test:int", "<", n), subgraph.Rules(degrees=2, edges=False))
    assert {r["$degree"]: r["count"] for r in nodes.ndefs("$degree").groupBy("$degree").count().collect()} == {0: n, 1: n}


def test_derived_tags_without_maps(spark):
    rows = [(1, "a.b", "a", None), (2, "a", "a", "a"), (3, None, None, None), (4, "", "a.", "a..b"), (5, "a.b.c", "ab", "a.bc"), (6, "x.y", "x.y.z", "x")]
    model = Model([Form("t", "t", ("k",), Int(), {}, (), lambda: [F.col("x"), F.col("y"), F.col("z")])])
    plain = spark.createDataFrame(rows, "k bigint, x string, y string, z string")
    derived = lifts.lift(Graph(spark, model, {"t": plain}.__getitem__), "t")
    stored = lifts.lift(Graph(spark, model, {"t": plain.withColumn("tags", bare_tags(F.col("x"), F.col("y"), F.col("z")))}.__getitem__), "t")
    for glob in (None, "*", "a.*", "x.*", "a", "a.b"):
        got = pivots.to_tags(derived, glob)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pivots.to_tags(stored, glob).collect()))
        assert "map_from_entries" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.tag for r in pivots.to_tags(derived).collect()) == ["", "a", "a..b", "a.b", "a.b.c", "a.bc", "ab", "x.y.z"]
