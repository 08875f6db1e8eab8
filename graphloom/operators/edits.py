"""Edits: how node frames change. All are expressions over map and array columns or
joins with edge frames; nothing is changed in place.

A storage frame holds any form: ``(form, valu, props, tags, tagprops, nodedata)``, with
properties as text by name (see :func:`storage` and :func:`typed`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import timing
from graphloom.errors import BadArg, BadTypeValu
from graphloom.graph import TAGPROPS, TAGS, Graph, Stream, q, union_all, valu_text
from graphloom.model import Form, with_parents
from graphloom.types import Array, IPv4, Ival, Type

SCHEMA = f"form string, valu string, props map<string,string>, tags {TAGS}, tagprops {TAGPROPS}, nodedata map<string,string>"
IVAL = "struct<min:bigint,max:bigint>"


def nested(kind: Type) -> bool:
    """Whether values are kept as JSON text."""
    return kind.spark.startswith(("array", "struct"))


def storage(graph: Graph, form: Form, df: DataFrame) -> DataFrame:
    """A typed frame as a storage frame."""
    pairs = [F.struct(F.lit(n).alias("key"), (F.to_json(q(p.column)) if nested(p.type) else q(p.column).cast("string")).alias("value")) for n, p in form.props.items()]
    props = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))
    return df.select(
        F.lit(form.name).alias("form"), valu_text(form).alias("valu"), props.alias("props"), graph.tags(form, df).alias("tags"),
        graph.tagprops(df).alias("tagprops"), graph.nodedata(df).alias("nodedata"),
    )


def typed(form: Form, df: DataFrame) -> DataFrame:
    """The rows of one form of a storage frame, with the form's own columns."""
    def col(name: str) -> Column:
        p, text = form.props[name], F.try_element_at("props", F.lit(name))
        return (F.from_json(text, p.type.spark) if nested(p.type) else text.try_cast(p.type.spark)).alias(p.column)

    own = {p.column for p in form.props.values()}
    keys = [] if len(form.key) > 1 or form.key[0] in own else [F.col("valu").try_cast(form.type.spark).alias(form.key[0])]
    return df.where(F.col("form") == form.name).select(*keys, *[col(n) for n in form.props], "tags", "tagprops", "nodedata")


def add_nodes(base: DataFrame, new: DataFrame) -> DataFrame:
    """Add or get: nodes of ``new`` that ``base`` lacks, each once, beside all of ``base``."""
    fresh = new.dropDuplicates(["form", "valu"]).join(base, ["form", "valu"], "left_anti")
    return base.unionByName(fresh)


def node(graph: Graph, form: str, values: list, kind: Type | None = None, lenient: bool = False) -> DataFrame:
    """Nodes from literals; ``lenient`` (``?=``) skips bad ones. An IPv4 block or range gives
    every address in it, made by the executors."""
    kind = kind or graph.model.form(form).type
    spans, plain = [], []
    for v in values:
        try:
            if isinstance(kind, IPv4) and (span := IPv4.span(v)):
                spans.append(span)
            else:
                plain.append(str(kind.norm(v)))
        except BadTypeValu:
            if not lenient:
                raise
    rows = graph.spark.createDataFrame([(v,) for v in plain], "valu string")
    for lo, hi in spans:
        rows = rows.union(graph.spark.range(lo, hi + 1).select(F.col("id").cast("string")))
    return rows.select(F.lit(form).alias("form"), "valu", *empties())


def add_or_get(graph: Graph, form: str, values: list, lenient: bool = False) -> Stream:
    """``[ form=v ]``: typed rows of the nodes, those that are there as they are and the
    others with nothing but their value."""
    f = graph.model.form(form)
    if len(f.key) != 1:
        raise BadArg(f"{form} has several keys")
    made = node(graph, form, values, lenient=lenient).select(F.col("valu").try_cast(f.type.spark).alias("_k")).distinct()
    have = graph.frame(f)
    there = have.join(made, f.valu() == F.col("_k"), "left_semi")
    fresh = made.join(have.select(f.valu().alias("_h")), F.col("_k") == F.col("_h"), "left_anti").withColumnRenamed("_k", f.key[0])
    return graph.stream({form: there.unionByName(fresh, allowMissingColumns=True)})


def empties() -> list[Column]:
    none = F.create_map()
    return [
        none.cast("map<string,string>").alias("props"), none.cast(TAGS).alias("tags"), none.cast(TAGPROPS).alias("tagprops"),
        none.cast("map<string,string>").alias("nodedata"),
    ]


def put(m: Column, key: str, valu: Column) -> Column:
    """A map with one entry set."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), valu))


def set_prop(stream: Stream, prop: str, valu: Column | object, mode: str = "always") -> Stream:
    """``:p=v``, ``:p*unset=v``; intervals and min/max types merge with the old value."""
    def one(form: Form, df: DataFrame) -> DataFrame:
        p = form.prop(prop)
        new, old = p.type.value(valu).cast(dict(df.dtypes)[p.column]), q(p.column)
        if mode == "never":
            return df
        if mode == "unset":
            return df.withColumn(p.column, F.coalesce(old, new))
        return df.withColumn(p.column, F.when(new.isNull(), old).otherwise(p.type.merge(old, new)))

    return stream.map(one)


def remove_first(arr: Column, item: Column) -> Column:
    at = F.array_position(arr, item)
    return F.when(at == 0, arr).otherwise(F.concat(F.slice(arr, F.lit(1), at.cast("int") - 1), F.slice(arr, at.cast("int") + 1, F.size(arr))))


def edit_array(stream: Stream, prop: str, add: list = (), remove: list = (), lenient: bool = False) -> Stream:
    """``+=``, ``-=`` (the first equal element), ``++=``, ``--=`` and, ``lenient``, ``?+=``."""
    def one(form: Form, df: DataFrame) -> DataFrame:
        p = form.prop(prop)
        if not isinstance(p.type, Array):
            raise BadArg(f"{form.name}:{prop} is no array")
        c = F.coalesce(q(p.column), F.array().cast(dict(df.dtypes)[p.column]))
        for items, op in ((add, F.array_append), (remove, remove_first)):
            for v in items:
                try:
                    c = op(c, p.type.elem.value(v))
                except BadTypeValu:
                    if not lenient:
                        raise
        c = F.array_distinct(c) if p.type.uniq else c
        return df.withColumn(p.column, F.array_sort(c) if p.type.sorted else c)

    return stream.map(one)


def del_prop(stream: Stream, prop: str) -> Stream:
    return stream.map(lambda form, df: df.withColumn(form.prop(prop).column, F.lit(None).cast(dict(df.dtypes)[form.prop(prop).column])))


def _tagged(stream: Stream, name: str, change: Callable[[Column], Column], kind: str) -> Stream:
    def one(form: Form, df: DataFrame) -> DataFrame:
        old = {"tags": lambda: stream.graph.tags(form, df), "tagprops": lambda: stream.graph.tagprops(df), "nodedata": lambda: stream.graph.nodedata(df)}[name]()
        return df.withColumn(name, change(old).cast(kind))

    return stream.map(one)


def merged_interval(old: Column, new: Column) -> Column:
    return Ival().merge(old, new)


def tag_put(tags: Column, tag: str, interval: Column) -> Column:
    """Sets a tag; parents come along without times, intervals unite, no interval keeps the old."""
    parts = tag.split(".")
    out = tags
    for n in range(1, len(parts)):
        parent = ".".join(parts[:n])
        out = F.when(F.map_contains_key(out, parent), out).otherwise(F.map_concat(out, F.create_map(F.lit(parent), F.lit(None).cast(IVAL))))
    return put(out, tag, merged_interval(F.try_element_at(out, F.lit(tag)), interval))


def add_tag(stream: Stream, tag: str, at=None) -> Stream:
    """``+#tag`` and ``+#tag=ival``."""
    from graphloom.types import Tag

    name = Tag().norm(tag)
    iv = F.lit(None).cast(IVAL) if at is None else F.struct(*[F.lit(x).alias(n) for x, n in zip(timing.interval(at), ("min", "max"))])
    return _tagged(stream, "tags", lambda t: tag_put(t, name, iv), TAGS)


def below(key: Column, tag: str) -> Column:
    return (key == tag) | key.startswith(tag + ".")


def del_tag(stream: Stream, tag: str) -> Stream:
    """``-#tag``: the tag, all below it, and their properties."""
    out = _tagged(stream, "tags", lambda t: F.map_filter(t, lambda k, _: ~below(k, tag)), TAGS)
    return _tagged(out, "tagprops", lambda t: F.map_filter(t, lambda k, _: ~below(k, tag)), TAGPROPS)


def prune_tag(stream: Stream, tag: str) -> Stream:
    """Deletes a tag and all below it, then, walking up, parents left without others below
    them; the first that has one ends the walk."""
    parts = tag.split(".")

    def change(tags: Column) -> Column:
        out = F.map_filter(tags, lambda k, _: ~below(k, tag))
        for n in range(len(parts) - 1, 0, -1):
            parent = ".".join(parts[:n])
            busy = F.exists(F.map_keys(out), lambda k: k.startswith(parent + "."))  # noqa: B023
            out = F.when(busy, out).otherwise(F.map_filter(out, lambda k, _: k != parent))  # noqa: B023
        return F.when(F.map_contains_key(tags, tag), out).otherwise(tags)

    return _tagged(stream, "tags", change, TAGS)


def move_tag(stream: Stream, old: str, new: str) -> Stream:
    """Renames a tag and all below it on all rows; times of tags that meet unite."""
    if old == new or new.startswith(old + "."):
        raise BadArg("a tag can't move below itself")

    def change(tags: Column) -> Column:
        moved = F.map_filter(tags, lambda k, _: below(k, old))
        renamed = F.map_from_entries(F.transform(F.map_entries(moved), lambda e: F.struct(F.concat(F.lit(new), F.substring(e["key"], F.lit(len(old) + 1), F.length(e["key"]))).alias("key"), e["value"].alias("value"))))
        parents = [".".join(new.split(".")[:n]) for n in range(1, new.count(".") + 1)]
        none = F.lit(None).cast(IVAL)
        above = F.create_map(*[x for p in parents for x in (F.lit(p), none)]).cast(TAGS) if parents else F.create_map().cast(TAGS)
        rest = F.map_filter(tags, lambda k, _: ~below(k, old))
        out = F.map_zip_with(F.map_zip_with(rest, renamed, lambda _, a, b: merged_interval(a, b)), above, lambda _, a, b: merged_interval(a, b))
        return F.when(F.size(moved) > 0, out).otherwise(tags)

    return _tagged(stream, "tags", change, TAGS)


def set_tagprop(stream: Stream, tag: str, prop: str, valu: Column | str) -> Stream:
    """``+#tag:prop=v``; the tag is added where it is missing."""
    out = add_tag(stream, tag)
    v = (valu if isinstance(valu, Column) else F.lit(str(valu))).cast("string")
    none = F.create_map().cast("map<string,string>")
    return _tagged(out, "tagprops", lambda t: put(t, tag, put(F.coalesce(F.try_element_at(t, F.lit(tag)), none), prop, v)), TAGPROPS)


def del_tagprop(stream: Stream, tag: str, prop: str) -> Stream:
    return _tagged(stream, "tagprops", lambda t: F.transform_values(t, lambda k, m: F.when(k == tag, F.map_filter(m, lambda p, _: p != prop)).otherwise(m)), TAGPROPS)


def set_data(stream: Stream, name: str, valu: Column | str) -> Stream:
    v = valu if isinstance(valu, Column) else F.lit(valu)
    return _tagged(stream, "nodedata", lambda t: put(t, name, v), "map<string,string>")


def pop_data(stream: Stream, name: str) -> Stream:
    return _tagged(stream, "nodedata", lambda t: F.map_filter(t, lambda k, _: k != name), "map<string,string>")


EDGE = ["n1form", "n1", "verb", "n2form", "n2"]


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges are a set: those of ``new`` that aren't there yet are appended."""
    fresh = new.select(*EDGE).distinct().join(edges, EDGE, "left_anti")
    return edges.select(*EDGE).unionByName(fresh)


def del_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*EDGE), EDGE, "left_anti")


def edges_between(stream: Stream, verb: str, other: Callable[[Stream], Stream], reverse: bool = False) -> DataFrame:
    """``+(verb)> { q }``: edges from each row to what the query gives for it."""
    parts = []
    for name, df in stream.frames.items():
        form = stream.graph.model.form(name)
        out = other(stream.graph.stream({name: df.withColumn("$_n1", valu_text(form))}))
        for there, rows in out.frames.items():
            a, b = F.col("`$_n1`"), valu_text(stream.graph.model.form(there))
            n1, n2, f1, f2 = (b, a, there, name) if reverse else (a, b, name, there)
            parts.append(rows.select(F.lit(f1).alias("n1form"), n1.alias("n1"), F.lit(verb).alias("verb"), F.lit(f2).alias("n2form"), n2.alias("n2")))
    return union_all(parts).distinct()


def edges_del(edges: DataFrame, stream: Stream, verb: str = "*", n2: bool = False) -> DataFrame:
    """Edges of these nodes go, by verb or all."""
    ends = stream.ndefs().toDF("n2form", "n2") if n2 else stream.ndefs().toDF("n1form", "n1")
    hit = edges.where(F.lit(verb == "*") | (F.col("verb") == verb)).join(ends, ends.columns, "left_semi")
    return edges.join(hit.select(*EDGE), EDGE, "left_anti")


def delete_nodes(base: DataFrame, edges: DataFrame, gone: DataFrame, force: bool = False, deledges: bool = False) -> tuple[DataFrame, DataFrame]:
    """``delnode``: nodes that edges lead to stay unless ``force``; ``deledges`` removes
    those edges first. Outbound edges go with their node."""
    ends = gone.select("form", "valu").distinct()
    inbound = edges.select(F.col("n2form").alias("form"), F.col("n2").alias("valu")).distinct()
    doomed = ends if force or deledges else ends.join(inbound, ["form", "valu"], "left_anti")
    kept = base.join(doomed, ["form", "valu"], "left_anti")
    left = edges.join(doomed.toDF("n1form", "n1"), ["n1form", "n1"], "left_anti")
    if deledges:
        left = left.join(doomed.toDF("n2form", "n2"), ["n2form", "n2"], "left_anti")
    return kept, left.select(*EDGE)


def get_or_create(base: DataFrame, form: str, names: DataFrame, prop: str) -> DataFrame:
    """``gen.*``: a node of ``form`` for each name in ``names(name)``; the one whose property
    has it, else a new one whose guid comes from form and name."""
    have = base.where(F.col("form") == form).select(F.try_element_at("props", F.lit(prop)).alias("name"))
    new = names.select("name").where("name IS NOT NULL").distinct().join(have, "name", "left_anti")
    made = new.select(
        F.lit(form).alias("form"), F.md5(F.concat_ws("\x00", F.lit(form), "name")).alias("valu"),
        F.create_map(F.lit(prop), F.col("name")).alias("props"), *empties()[1:],
    )
    return base.unionByName(made)


def all_parents(tag: Column) -> Column:
    return with_parents(tag)
