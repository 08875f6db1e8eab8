"""The registry: which forms there are, where their rows lie and how they refer to each other."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import NoSuchForm, NoSuchProp
from graphloom.types import Array, Float, Int, Str, Time, Type, Url


@dataclass(frozen=True)
class Prop:
    """A typed column; ``ref`` names the form (or interface) that its values are keys of."""

    column: str
    type: Type
    ref: str | None = None
    ro: bool = False

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, Array)


@dataclass(frozen=True)
class Form:
    """A node kind. ``key`` are the columns of its primary value; ``tags`` derives leaf tags,
    each a column of names or nulls, where the table has no ``tags`` column."""

    name: str
    table: str
    key: tuple[str, ...]
    type: Type
    props: dict[str, Prop] = field(default_factory=dict)
    ifaces: tuple[str, ...] = ()
    tags: Callable[[], list[Column]] | None = None

    def prop(self, name: str) -> Prop:
        if name not in self.props:
            raise NoSuchProp(f"{self.name}:{name}")
        return self.props[name]

    def valu(self) -> Column:
        return F.col(self.key[0]) if len(self.key) == 1 else F.struct(*self.key)


@dataclass(frozen=True)
class Verb:
    """Light edges of one verb between two forms: a frame ``(n1, n2)`` of primary values."""

    verb: str
    n1: str
    n2: str
    frame: Callable[[Callable[[str], DataFrame]], DataFrame]


class Model:
    def __init__(self, forms: list[Form], verbs: list[Verb] = ()):
        self.forms = {f.name: f for f in forms}
        self.verbs = list(verbs)

    def form(self, name: str) -> Form:
        if name not in self.forms:
            raise NoSuchForm(name)
        return self.forms[name]

    def resolve(self, name: str) -> list[Form]:
        """Forms that a name, a glob (``inet:*``) or an interface stands for."""
        if name in self.forms:
            return [self.forms[name]]
        found = [f for f in self.forms.values() if name in f.ifaces or "*" in name and fnmatch.fnmatchcase(f.name, name)]
        if not found:
            raise NoSuchForm(name)
        return found

    def split(self, text: str) -> tuple[list[Form], str | None]:
        """``form:prop`` -> its forms and the property; form names may hold colons."""
        try:
            return self.resolve(text), None
        except NoSuchForm:
            name, _, prop = text.rpartition(":")
            if not name:
                raise
            forms = [f for f in self.resolve(name) if prop in f.props]
            if not forms:
                raise NoSuchProp(text) from None
            return forms, prop

    def refs(self, src: Form, dst: Form | None = None) -> list[tuple[str, Prop, Form]]:
        """``(prop name, prop, target form)`` of all references out of ``src``."""
        out = []
        for name, p in src.props.items():
            if p.ref:
                out += [(name, p, t) for t in self.resolve(p.ref) if dst is None or t.name == dst.name]
        return out

    def as_rows(self) -> list[dict]:
        """The model itself as rows (``syn:form``/``syn:prop`` of a runt lift)."""
        return [
            {"form": f.name, "prop": n, "type": p.type.name, "ref": p.ref, "ro": p.ro} for f in self.forms.values() for n, p in f.props.items()
        ]


def bare_tags(*names: Column) -> Column:
    """Tags without times from columns that each hold a name or null; parents come along."""
    none = F.lit(None).cast("struct<min:bigint,max:bigint>")
    every = F.flatten(F.transform(F.filter(F.array(*names), lambda x: x.isNotNull()), with_parents))
    return F.map_from_entries(F.transform(F.array_distinct(every), lambda t: F.struct(t.alias("key"), none.alias("value"))))


def with_parents(tag: Column) -> Column:
    """``a.b.c`` -> ``[a, a.b, a.b.c]``."""
    parts = F.split(tag, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def driver_model() -> Model:
    """The model of the driver's tables."""
    i, s, d, t = Int(), Str(), Float(), Time(ms=False)
    ns = lambda p: {
        "name": Prop(f"{p}_name", s), "nationkey": Prop(f"{p}_nationkey", i, "nation"), "acctbal": Prop(f"{p}_acctbal", d),
    }
    forms = [
        Form("region", "region", ("r_regionkey",), i, {"name": Prop("r_name", s)}),
        Form("nation", "nation", ("n_nationkey",), i, {"name": Prop("n_name", s), "regionkey": Prop("n_regionkey", i, "region")}),
        Form("customer", "customer", ("c_custkey",), i, ns("c") | {"mktsegment": Prop("c_mktsegment", s)}, ("party",), lambda: [F.concat(F.lit("segment."), slug(F.col("c_mktsegment"))), F.when(F.col("c_acctbal") < 0, F.lit("credit.overdrawn"))]),
        Form("supplier", "supplier", ("s_suppkey",), i, ns("s"), ("party",)),
        Form("part", "part", ("p_partkey",), i, {"name": Prop("p_name", s), "brand": Prop("p_brand", s), "type": Prop("p_type", s), "size": Prop("p_size", i), "retailprice": Prop("p_retailprice", d)}),
        Form("orders", "orders", ("o_orderkey",), i, {
            "custkey": Prop("o_custkey", i, "customer"), "status": Prop("o_orderstatus", s), "totalprice": Prop("o_totalprice", d), "date": Prop("o_orderdate", t), "priority": Prop("o_orderpriority", s),
        }, (), lambda: [F.concat(F.lit("priority."), slug(F.regexp_replace("o_orderpriority", r"^\d-", ""))), F.concat(F.lit("status."), F.lower("o_orderstatus"))]),
        Form("lineitem", "lineitem", ("l_orderkey", "l_linenumber"), s, {
            "orderkey": Prop("l_orderkey", i, "orders"), "partkey": Prop("l_partkey", i, "part"), "suppkey": Prop("l_suppkey", i, "supplier"), "linenumber": Prop("l_linenumber", i),
            "quantity": Prop("l_quantity", d), "extendedprice": Prop("l_extendedprice", d), "discount": Prop("l_discount", d), "tax": Prop("l_tax", d),
            "returnflag": Prop("l_returnflag", s), "linestatus": Prop("l_linestatus", s), "shipdate": Prop("l_shipdate", t),
        }),
        Form("event", "events", ("event_id",), i, {"time": Prop("ts", t), "user": Prop("user_id", i), "type": Prop("event_type", s), "value": Prop("value", d), "props": Prop("props", s)}),
        Form("document", "documents", ("doc_id",), i, {"text": Prop("text", s), "lang": Prop("lang", s), "source": Prop("source", s), "n_chars": Prop("n_chars", i)}),
        Form("label", "labels", ("doc_id",), i, {"doc": Prop("doc_id", i, "document"), "quality": Prop("quality", i), "toxic": Prop("toxic", i)}),
        Form("embedding", "embeddings", ("vec_id",), i, {"vector": Prop("embedding", Array(d)), "label": Prop("label", i)}),
        Form("page", "pages", ("page_id",), i, {"url": Prop("url", Url()), "html": Prop("html", s)}),
        Form("passage", "benchmark", ("item_id",), i, {"text": Prop("text", s)}),
        Form("turn", "conversations", ("conv_id", "turn"), s, {"conv": Prop("conv_id", i), "turn": Prop("turn", i), "role": Prop("role", s), "text": Prop("text", s)}),
    ]
    supplies = Verb(
        "supplies", "supplier", "part", lambda t: t("lineitem").select(F.col("l_suppkey").alias("n1"), F.col("l_partkey").alias("n2")).distinct()
    )
    bought = Verb(
        "bought", "customer", "part",
        lambda t: t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("n1"), F.col("l_partkey").alias("n2")).distinct(),
    )
    return Model(forms, [supplies, bought])
