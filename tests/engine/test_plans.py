import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.graph import TAGPROPS, TAGS
from graphloom.plans import joins
from graphloom.plans.layers import SCHEMA, Layer, View
from graphloom.sources import feeds
from graphloom.streaming import editlog, queues, triggers
from graphloom.streaming.cron import Recurrence


def layer(spark, name, rows, edges=()):
    full = [(f, v, has, props, tags, tps, data) for f, v, has, props, tags, tps, data in rows]
    e = spark.createDataFrame(list(edges), "n1form string, n1 string, verb string, n2form string, n2 string")
    return Layer(name, spark.createDataFrame(full, SCHEMA), e)


@pytest.fixture(scope="module")
def view(spark):
    base = layer(
        spark, "base",
        [("x", "1", True, {"a": "1", "b": "1"}, {"t": (10, 20)}, {"t": {"p": "1"}}, {}), ("x", "2", True, {"a": "2"}, {}, {}, {})],
        [("x", "1", "v", "x", "2")],
    )
    top = layer(
        spark, "top",
        [("x", "1", False, {"a": "9"}, {"t": (15, 30), "u": None}, {"t": {"q": "2"}}, {"k": "v"}), ("x", "3", True, {"b": "3"}, {}, {}, {}), ("x", "4", False, {"b": "lost"}, {}, {}, {})],
        [("x", "1", "v", "x", "2"), ("x", "3", "v", "x", "1")],
    )
    return View((top, base))


def rows(df):
    return {r.valu: r.asDict(recursive=True) for r in df.collect()}


def test_view_resolves(view):
    got = rows(view.nodes())
    assert set(got) == {"1", "2", "3"}  # 4 has no value in any layer
    one = got["1"]
    assert one["props"] == {"a": "9", "b": "1"} and one["tags"]["t"] == {"min": 15, "max": 30} and one["tags"]["u"] is None
    assert one["tagprops"] == {"t": {"p": "1", "q": "2"}} and one["nodedata"] == {"k": "v"}
    assert view.edges().count() == 2
    assert set(rows(view.diff())) == {"1", "3"} and set(rows(view.diff(tag="u"))) == {"1"} and set(rows(view.diff(prop=("x", "b")))) == {"3"}
    assert view.prop_count("x", "a").first()[0] == 3  # without masking
    assert {r[0] for r in view.prop_values("x", "a").collect()} == {"9", "2"}
    assert view.fork("f").nodes().count() == 3


def test_merge_move_copy(view):
    assert view.merge().count() == 3  # a dry run
    m = view.merge(apply=True)
    assert m.top.nodes.count() == 0 and m.layers[0].edges.count() == 0
    low = rows(View(m.layers[1:]).nodes())
    assert low["1"]["props"] == {"a": "9", "b": "1"} and low["1"]["tags"]["t"] == {"min": 10, "max": 30} and "3" in low
    part = view.merge(apply=True, only_tags=True, include_tags=["u"])
    assert rows(View(part.layers[1:]).nodes())["1"]["tags"]["t"] == {"min": 10, "max": 20}
    assert rows(part.nodes())["1"]["props"]["a"] == "9"
    moved = view.move(view.nodes(), dest=1)
    assert moved.layers[0].nodes.where("valu = '1'").count() == 0 and rows(moved.nodes())["1"]["props"]["a"] == "9"
    target = View((Layer.empty(view.top.nodes.sparkSession, "t"),))
    copied = view.copy_to(view.nodes().where("valu IN ('1', '2')"), target)
    assert set(rows(copied.nodes())) == {"1", "2"} and [(r.n1, r.n2) for r in copied.edges().collect()] == [("1", "2")]


def test_log_round_trip(view, spark, tmp_path):
    for lay in view.layers:
        back = editlog.replay(editlog.to_edits(lay))
        assert rows(back.nodes) == rows(lay.nodes) and sorted(back.edges.collect()) == sorted(lay.edges.collect())
    feeds.dump_layer(view.layers[1], f"{tmp_path}/dump")
    assert rows(feeds.load_layer(spark, f"{tmp_path}/dump").nodes) == rows(view.layers[1].nodes)


def edits(spark, items):
    return spark.createDataFrame([(i, "x", *r) for i, r in enumerate(items)], editlog.SCHEMA)


def test_replay_order(spark):
    e = editlog
    log = edits(spark, [
        ("1", e.NODE_ADD, None, None, None, None, None), ("1", e.PROP_SET, "a", None, "1", None, None), ("1", e.PROP_SET, "a", None, "2", None, None),
        ("1", e.TAG_SET, "t", None, None, 10, 20), ("1", e.TAG_SET, "t", None, None, 5, 12), ("1", e.PROP_SET, "b", None, "1", None, None),
        ("1", e.PROP_DEL, "b", None, None, None, None), ("2", e.NODE_ADD, None, None, None, None, None), ("2", e.PROP_SET, "a", None, "old", None, None),
        ("2", e.NODE_DEL, None, None, None, None, None), ("2", e.NODE_ADD, None, None, None, None, None), ("3", e.NODE_ADD, None, None, None, None, None),
        ("3", e.NODE_DEL, None, None, None, None, None), ("1", e.EDGE_ADD, "v", "x", "2", None, None), ("1", e.EDGE_ADD, "w", "x", "2", None, None),
        ("1", e.EDGE_DEL, "v", "x", "2", None, None), ("1", e.TAGPROP_SET, "t", "s", "7", None, None), ("1", e.NODEDATA_SET, "k", None, "d", None, None),
    ])
    lay = editlog.replay(log)
    got = rows(lay.nodes)
    assert set(got) == {"1", "2"} and got["2"]["props"] == {}
    assert got["1"]["props"] == {"a": "2"} and got["1"]["tags"] == {"t": {"min": 5, "max": 20}} and got["1"]["tagprops"] == {"t": {"s": "7"}}
    assert [(r.n1, r.verb) for r in lay.edges.collect()] == [("1", "w")]
    assert [r.offs for r in editlog.slice_(log, 3, 2).collect()] == [3, 4] and [r.offs for r in editlog.slice_(log, 3, 2, reverse=True).collect()] == [3, 2]
    assert editlog.index_events(log, forms=["x"], props=["x:b"], tags=["t"]).count() == 6 + 2 + 2


def test_triggers_and_streams(spark, tmp_path):
    e = editlog
    log = edits(spark, [
        ("1", e.NODE_ADD, None, None, None, None, None), ("1", e.TAG_SET, "a.b", None, None, None, None), ("1", e.TAG_SET, "a.b.c", None, None, None, None),
        ("1", e.EDGE_ADD, "refs", "y", "9", None, None),
    ])
    rules = [triggers.Trigger("t", "tag:add", tag="a.*"), triggers.Trigger("n", "node:add", "x"), triggers.Trigger("e", "edge:add", verb="re*", n2form="y"), triggers.Trigger("off", "node:add", enabled=False)]
    assert sorted((r.trigger, r.offs) for r in triggers.fired(log, rules).collect()) == [("e", 3), ("n", 0), ("t", 1)]
    path, got = f"{tmp_path}/edits", []
    editlog.append(log, path)
    run = lambda: triggers.run(editlog.feed(spark, path), {"t": (rules[0], lambda df: got.extend(r.offs for r in df.collect()))}, f"{tmp_path}/ck").awaitTermination()
    run()
    assert got == [1]
    editlog.append(log.withColumn("offs", F.col("offs") + 10), path)
    run()  # only what came since
    assert got == [1, 11]


def test_queue(spark, tmp_path):
    queue = queues.Queue(spark, f"{tmp_path}/q")
    assert queue.puts(["a", "b"]) == 0 and queue.puts(["c"]) == 2
    assert [r.item for r in queue.gets(1, 5).collect()] == ["b", "c"]
    queue.cull(0)
    assert [r.offs for r in queue.gets().collect()] == [1, 2]


def test_once_stream(spark, tmp_path):
    spark.createDataFrame([("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1, 0, 1)), ("b", datetime(2024, 1, 1))], "k string, ts timestamp").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    w = queues.once_stream(s, ["k"], "ts", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    w.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_cron():
    t = datetime(2024, 1, 31, 12, 30)
    assert Recurrence({"minute": 15}, "hour").next(t) == datetime(2024, 1, 31, 13, 15)
    assert Recurrence({"hour": (6, 18), "minute": 0}, "day").next(t) == datetime(2024, 1, 31, 18, 0)
    assert Recurrence({"dayofmonth": -1, "hour": 1, "minute": 0}, "month").next(t) == datetime(2024, 2, 29, 1, 0)
    assert Recurrence({"dayofweek": 0, "hour": 0, "minute": 0}, "dayofweek").next(t) == datetime(2024, 2, 5)
    assert Recurrence({"year": 2020}).next(t) is None
    assert Recurrence({"month": 2, "dayofmonth": 29, "hour": 0, "minute": 0}, "year").next(datetime(2024, 3, 1)) == datetime(2028, 2, 29)


def test_feeds(spark, tmp_path, view):
    lines = [
        feeds.node_json("x", "1", props={"a": "1"}, tags={"t": [1, 2], "u": [None, None]}, edges=[["v", "x", "2"], ["v", "x", "9"]]),
        feeds.node_json("x", "2"), "junk", "",
    ]
    (tmp_path / "feed.jsonl").write_text("\n".join(lines))
    lay = feeds.read_nodes(spark, f"{tmp_path}/feed.jsonl")
    got = rows(lay.nodes)
    assert got["1"]["tags"] == {"t": {"min": 1, "max": 2}, "u": None} and set(got) == {"1", "2"} and lay.edges.count() == 2
    v = View((lay,))
    feeds.export(v, v.nodes(), f"{tmp_path}/out")
    again = feeds.read_nodes(spark, f"{tmp_path}/out")
    assert rows(again.nodes) == got and [r.n2 for r in again.edges.collect()] == ["2"]  # both ends are in the export
    (tmp_path / "x.csv").write_text('id,name\n1,"a, b"\n2,\n')
    n = rows(feeds.csv_nodes(feeds.read_csv(spark, f"{tmp_path}/x.csv", header=True), "x", "id", {"name": "name"}))
    assert n["1"]["props"] == {"name": "a, b"} and n["2"]["props"] == {}
    s = feeds.stix_bundle(lay.nodes, {"x": "ipv4-addr"}).collect()
    assert all('"spec_version":"2.1"' in r.object for r in s)


def test_blobs(spark, tmp_path):
    b = feeds.Blobs(spark, f"{tmp_path}/blobs")
    put = b.put(spark.createDataFrame([(b"one\ntwo\n",), (b'{"k": 1}\nbad{\n',), (b"one\ntwo\n",)], "bytes binary"))
    assert put.count() == 3 and b.metrics().first()["file_count"] == 2
    sha = put.first()["sha256"]
    b.put(spark.createDataFrame([(b"one\ntwo\n",)], "bytes binary"))
    assert b.metrics().first()["file_count"] == 2 and b.has(sha) and b.size(sha) == 8 and b.read(sha, 4, 3) == b"two"
    assert [r.line for r in b.readlines(sha).collect()] == ["one", "two"]


def test_interval_and_range_joins(spark):
    rnd = random.Random(1)
    a = [(i, x := rnd.randrange(-500, 500), x + rnd.randrange(0, 60)) for i in range(150)]
    b = [(i, x := rnd.randrange(-500, 500), x + rnd.randrange(0, 60)) for i in range(150)]
    da, db = spark.createDataFrame(a, "a bigint, lo bigint, hi bigint"), spark.createDataFrame(b, "b bigint, lo2 bigint, hi2 bigint")
    want = sorted((i, j) for i, l, h in a for j, m, n in b if l < n and h > m and l < h and m < n)
    assert sorted(map(tuple, joins.interval_join(da, db, "lo", "hi", "lo2", "hi2", 17).select("a", "b").collect())) == want
    want = sorted((i, j) for i, l, _ in a for j, m, n in b if m <= l <= n)
    assert sorted(map(tuple, joins.range_join(da.drop("hi"), db, "lo", "lo2", "hi2", 13).select("a", "b").collect())) == want


def test_near_join(spark):
    rnd = random.Random(2)
    p = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(120)] + [(200, 0.0, 179.99), (201, 89.99, 10.0), (202, 60.0, -179.999)]
    r = [(i, a + rnd.uniform(-0.5, 0.5), o + rnd.uniform(-0.5, 0.5)) for i, a, o in p[:120]] + [(200, 0.0, -179.99), (201, 89.99, -170.0), (202, 60.0, 179.999)]
    r = [(i, max(-90.0, min(90.0, a)), (o + 180) % 360 - 180) for i, a, o in r]

    def dist(a, o, b, u):
        a, o, b, u = map(math.radians, (a, o, b, u))
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((u - o) / 2) ** 2
        return 2 * 6_371_008_800.0 * math.asin(min(1, math.sqrt(h)))

    d = 40_000_000.0
    want = sorted((i, j) for i, a, o in p for j, b, u in r if dist(a, o, b, u) <= d)
    got = joins.near_join(spark.createDataFrame(p, "i bigint, lat double, lon double"), spark.createDataFrame(r, "j bigint, lat2 double, lon2 double"), ("lat", "lon"), ("lat2", "lon2"), d)
    assert sorted(map(tuple, got.select("i", "j").collect())) == want and {(200, 200), (201, 201), (202, 202)} <= set(want)


def test_types_of_maps():
    assert TAGS.startswith("map") and TAGPROPS.startswith("map")


def test_interval_join_packs_its_pairs(spark, tmp_path):
    days = spark.range(2400).selectExpr("id AS a", "hash(id) % 12 AS lo").selectExpr("a", "lo", "lo + 3 AS hi")
    hot = days.unionAll(spark.range(5000, 5600).selectExpr("id AS a", "100L AS lo", "101L AS hi")).selectExpr("a", "CAST(lo AS bigint) AS lo", "CAST(hi AS bigint) AS hi")
    rows = hot.collect()
    met = joins.interval_join(hot, hot.toDF("b", "lo2", "hi2"), "lo", "hi", "lo2", "hi2", 3).select("a", "b")
    met.write.parquet(f"{tmp_path}/met")
    got = spark.read.parquet(f"{tmp_path}/met")
    by = {}
    for r in rows:
        by[r.lo, r.hi] = by.get((r.lo, r.hi), 0) + 1
    want = sum(n * m for (lo, hi), n in by.items() for (lo2, hi2), m in by.items() if lo < hi2 and lo2 < hi)
    assert got.count() == got.distinct().count() == want > 1_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "met").glob("*.parquet")) < 0.75 * want
