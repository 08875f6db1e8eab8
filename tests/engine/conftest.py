import pytest

from graphloom.graph import Graph
from graphloom.model import Form, Model, Prop, Verb
from graphloom.types import Array, Int, IPv4, Ival, Loc, Str, Time

TAGS = "map<string,struct<min:bigint,max:bigint>>"


@pytest.fixture(scope="session")
def model():
    s, i = Str(), Int()
    forms = [
        Form("test:int", "ints", ("n",), i, {"loc": Prop("loc", Loc()), "int2": Prop("int2", i, "test:int")}),
        Form(
            "test:str", "strs", ("s",), s,
            {"tick": Prop("tick", Time()), "hehe": Prop("hehe", s), "n": Prop("n", i, "test:int"), "ns": Prop("ns", Array(i), "test:int"), "seen": Prop("seen", Ival())},
            ("named",),
        ),
        Form("inet:ipv4", "ips", ("ip",), IPv4(), {"asn": Prop("asn", i)}, ("named",)),
    ]
    return Model(forms, [Verb("refs", "test:str", "inet:ipv4", lambda t: t("refs"))])


@pytest.fixture(scope="session")
def g(spark, model):
    t = {
        "ints": spark.createDataFrame([(1, "us.va", 1), (2, "us.v", 1), (3, None, 2)], "n bigint, loc string, int2 bigint"),
        "strs": spark.createDataFrame(
            [
                ("a", 1000, "x", 1, [1, 2, 2], (10, 20), {"foo": None, "foo.bar": (10, 20)}, {"foo.bar": {"score": "7"}}, {"k": "1"}),
                ("b", 2000, None, 2, [], (20, 30), {"baz": None}, {}, {}),
                ("c", None, "X", None, None, None, {}, {}, {}),
            ],
            f"s string, tick bigint, hehe string, n bigint, ns array<bigint>, seen struct<min:bigint,max:bigint>, tags {TAGS}, tagprops map<string,map<string,string>>, nodedata map<string,string>",
        ),
        "ips": spark.createDataFrame([(0x01020300 + i, i) for i in range(6)], "ip bigint, asn bigint"),
        "refs": spark.createDataFrame([("a", 0x01020301), ("a", 0x01020302), ("b", 0x01020302)], "n1 string, n2 bigint"),
    }
    return Graph(spark, model, t.__getitem__)
