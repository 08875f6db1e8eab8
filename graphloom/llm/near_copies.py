"""Near copies by SimHash and, beyond its reach, by shingle sets of exact Jaccard similarity.

The corpus pipeline's near-copies stage. Its first step is op3's method as ``simhash.py``
has it: fingerprints, pigeonhole blocks, Hamming check; whatever op3 links is linked here.
That is exact for fingerprints two bits apart, but texts of similarity 0.8 differ in some
ten bits of 64, which no blocks of useful width survive. So a second step adds links: MinHash
bands propose, exact Jaccard similarity decides. Groups follow links of either step
transitively, through fingerprints: rows of one fingerprint are of one group.

In the second step texts are sets of ``shingle``-word shingles (bytes with A-Z lowered, split at ASCII
space; a shorter text is one shingle, a blank or null one the empty set). Texts of the
same set are one class, known by a digest of the set. Two classes are linked if the
Jaccard similarity of their sets is ``least`` or more.

Candidates are classes that share a whole band of MinHash values and whose sizes allow
the similarity. With ``BANDS`` bands of ``ROWS`` values a pair of similarity s shares one
with probability 1 - (1 - s**ROWS)**BANDS: 0.99995 at 0.8, 0.06 at 0.3. Every candidate
is verified on its full shingle sets, so nothing is linked by estimate.

Within a band key of at most ``pair_limit`` classes all pairs are candidates. In a larger
one, as a big group of near copies makes them, classes are sorted by the bands that
follow (in a circle), so that those which share most bands stand side by side, and each
is held against its ``REACH`` successors in each of its keys' orders, and a key's classes
are dealt over tasks by range. Then, in keys whose classes aren't of one group yet, those
outside the key's largest group are held against all classes of other groups. So every two
classes that share a key end in one group or are verified, and work grows with a group's
size, not with its square; only classes that share a key and are no near copies cost pairs.

Defined cases: blank and null texts are one class of fingerprint zero; repeated rows
and exact copies are of one class; null ids come last; an empty table gives an empty
result; columns of any name are returned untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.llm.common import column, deal, discard, materialise, maybe_broadcast, row_key, text_column
from graphloom.llm.components import connected_components

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 25, 5
PAIR_LIMIT = 16
#: Successors in a large key's order that a class is held against.
REACH = 8
#: Following bands that a large key's order looks at.
ORDER = 6
#: Classes of a family, about, whose common shingles give its core; which they are decides cost, not links.
CORE_SAMPLE = 64
#: Shingles that the driver may hold as common ones; with more of them, fewer count as common.
MOST_COMMON = 2_000_000

_random = np.random.default_rng(5)
_MULTIPLY = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start = (end - size)[:n].tolist()
    stop = (end - 1)[len(words) - n :].tolist()
    return np.unique(np.fromiter([digest(joined[a:b], 42) for a, b in zip(start, stop)], np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are the same."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def bands(h: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of MinHash values; none for the empty set."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 512):
        low = np.minimum(low, (h[i : i + 512, None] * _MULTIPLY + _ADD).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(low.reshape(BANDS, ROWS))]


def _set_id(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _classes(shingle: int):
    def run(batches):
        for b in batches:
            texts = b.column("_text").to_pylist()
            sets = [shingles(t, shingle) for t in texts]
            keep = [i for i, name in enumerate(b.schema.names) if name != "_text"]
            made = [
                pa.array([_set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()),
                pa.array([bands(h) for h in sets], pa.list_(pa.int64())), pa.array([simhash.signed_fingerprint(t) for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + made, names=[b.schema.names[i] for i in keep] + ["fp", "size", "bands", "print"])

    return run


def _set_bytes(shingle: int):
    """``(fp, _text)`` -> ``(fp, set)``, the sorted hashes as bytes."""

    def run(batches):
        for b in batches:
            made = [shingles(t, shingle).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["fp", "set"])

    return run


def _verify(least: float):
    """Batches of ``(a, b, ta, tb)`` -> ``(a, b)`` of those that are near."""

    def run(batches):
        of = lambda x: np.frombuffer(x, np.uint64)
        for x in batches:
            near = [jaccard(of(s), of(t)) >= least for s, t in zip(x.column("ta").to_pylist(), x.column("tb").to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _successors(reach: int, least: float):
    """Sorted ``(key number, key, ..., fp, size)`` -> pairs of a key at most ``reach`` apart
    whose sizes allow the similarity."""

    def run(batches):
        kept = None
        for b in batches:
            now = [b.column(n).to_numpy(zero_copy_only=False) for n in ("k", "key", "fp", "size")]
            k, key, fp, size = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            old = 0 if kept is None else len(kept[0])
            one, two = [], []
            for d in range(1, reach + 1):
                i = np.arange(max(0, old - d), len(k) - d)  # pairs whose second row is new
                j = i + d
                same = (k[i] == k[j]) & (key[i] == key[j]) & (np.minimum(size[i], size[j]) >= np.maximum(size[i], size[j]) * least - 1e-6)
                one.append(fp[i[same]])
                two.append(fp[j[same]])
            kept = [x[-reach:] for x in (k, key, fp, size)]
            a, b_ = np.concatenate(one), np.concatenate(two)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b_)), pa.array(np.minimum(a, b_))], names=["a", "b"])

    return run


def _fits(least: float):
    """Sizes ``sa``, ``sb`` of different sets that allow the similarity."""
    return (F.least("sa", "sb") >= F.greatest("sa", "sb") * least - 1e-6) & (
        (F.col("sa") != F.col("sb")) | (F.col("sa") - 1 >= (F.col("sa") + 1) * least - 1e-6)
    )


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select("k", "key", F.col("fp").alias(x), F.col("size").alias("s" + x))


def shared_keys(classes: DataFrame) -> DataFrame:
    """Distinct ``classes(fp, size, bands)`` -> a row for each of their keys that others share."""
    follow = [F.element_at("bands", ((F.col("k") + i) % BANDS + 1).cast("int")).alias(f"o{i}") for i in range(1, ORDER + 1)]
    keyed = classes.select("fp", "size", "bands", F.posexplode("bands").alias("k", "key"))
    shared = materialise(keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = materialise(keyed.join(maybe_broadcast(shared, 40), ["k", "key"]).select("fp", "size", "k", "key", "n", *follow), "met")
    discard(shared)
    return met


def candidates(met: DataFrame, least: float = LEAST, pair_limit: int = PAIR_LIMIT, reach: int = REACH) -> DataFrame:
    """Distinct pairs ``(a, b)``, a > b, to verify: all of small keys, neighbours in large ones."""
    few = met.where(F.col("n") <= pair_limit)
    pairs = _side(few, "a").join(_side(few, "b"), ["k", "key"]).where(F.col("a") > F.col("b")).where(_fits(least)).select("a", "b")
    order = ["k", "key", *(f"o{i}" for i in range(1, ORDER + 1)), "fp"]
    many = met.where(F.col("n") > pair_limit).repartitionByRange(*order).sortWithinPartitions(*order)
    near = many.select("k", "key", "fp", "size").mapInArrow(_successors(reach, least), "a long, b long")
    return materialise(pairs.union(near).distinct(), "pairs")


def _packed(buckets: int, most: int = 1 << 18):
    """``(fp, size, root, set)`` -> ``(bucket, data)``: shingles with fp, root and size, dealt by shingle."""

    def run(batches):
        schema = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])

        def flush(sets, rows):
            h = np.concatenate(sets)
            of = np.repeat(np.array(rows, np.int64), [len(x) for x in sets], axis=0)
            at = (h % np.uint64(buckets)).astype(np.int64)
            own = np.unique(at)
            data = [np.vstack([h[at == k].view(np.int64), of[at == k].T]).tobytes() for k in own]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(data, pa.binary())], schema=schema)

        for b in batches:
            sets, rows, n = [], [], 0
            for fp, size, root, x in zip(*(b.column(k).to_pylist() for k in ("fp", "size", "root", "set"))):
                sets.append(np.frombuffer(x, np.uint64))
                rows.append((fp, root, size))
                n += size
                if n >= most:
                    yield flush(sets, rows)
                    sets, rows, n = [], [], 0
            if sets:
                yield flush(sets, rows)

    return run


def _counted(rare: int, least: float):
    """A bucket's rows of :func:`_packed` -> ``(kind, a, b)``: 0, shingle and count of those in more
    than ``rare`` classes; 1 and two classes of different groups that share another."""

    def run(table):
        h, fp, root, size = np.hstack([np.frombuffer(x, np.int64).reshape(4, -1) for x in table.column("data").to_pylist()])
        order = np.lexsort((fp, h))
        h, fp, root, size = h[order], fp[order], root[order], size[order]
        own, at, n = np.unique(h, return_inverse=True, return_counts=True)
        often = n > rare
        keep = ~often[at]
        h, fp, root, size = h[keep], fp[keep], root[keep], size[keep]
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, rare):
            i, j = slice(0, max(0, len(h) - d)), slice(d, None)
            fits = np.minimum(size[i], size[j]) >= np.maximum(size[i], size[j]) * least - 1e-6
            ok = (h[i] == h[j]) & (root[i] != root[j]) & fits
            found.append(np.column_stack([np.maximum(fp[i], fp[j])[ok], np.minimum(fp[i], fp[j])[ok]]))
        pairs = np.unique(np.concatenate(found), axis=0)
        kind = np.repeat(np.array([0, 1], np.int32), [int(often.sum()), len(pairs)])
        return pa.table({"kind": kind, "a": np.concatenate([own[often], pairs[:, 0]]), "b": np.concatenate([n[often], pairs[:, 1]])})

    return run


def _common(often: np.ndarray, least: float):
    """``(fp, size, root, set)`` -> the same with ``part``, the shingles in the sorted ``often``
    and a digest of them, of classes that can be near one with which they share no others."""

    def run(batches):
        for b in batches:
            parts = [np.intersect1d(np.frombuffer(x, np.uint64), often, assume_unique=True) for x in b.column("set").to_pylist()]
            keep = [len(x) >= n * least - 1e-6 for x, n in zip(parts, b.column("size").to_pylist())]
            made = [pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([_set_id(x) for x in parts], pa.int64())]
            names = ["fp", "size", "root"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *made], names=[*names, "part", "digest"]).filter(pa.array(keep, pa.bool_()))

    return run


def _core(table: pa.Table) -> pa.Table:
    """A family's sample -> the shingles that most of the classes around its middle have."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("part").to_pylist()]
    h, at = np.unique(np.concatenate(parts), return_inverse=True)
    has = np.zeros((len(parts), len(h)), np.int32)
    has[np.repeat(np.arange(len(parts)), [len(x) for x in parts]), at] = 1
    both = has @ has.T
    middle = both[both.sum(axis=1).argmax()]
    around = has[middle * 2 >= middle.max()]
    core = h[around.sum(axis=0) * 2 > len(around)]
    return pa.table({"family": table.column("family")[:1], "core": pa.array([core.tobytes()], pa.binary())})


def _apart(often: np.ndarray, counts: np.ndarray, least: float):
    """Classes with their family's core -> how far they are from it: the ``marks`` (core shingles a
    class lacks, common ones it has besides, the rarer first), ``far`` and ``room`` (see :func:`open_pairs`)."""

    def run(batches):
        for b in batches:
            far, room, marks = [], [], []
            for size, x, y, n in zip(*(b.column(k).to_pylist() for k in ("size", "part", "core", "n"))):
                part, core = np.frombuffer(x, np.uint64), np.frombuffer(y or b"", np.uint64)
                lacks, more = np.setdiff1d(core, part, assume_unique=True), np.setdiff1d(part, core, assume_unique=True)
                has = len(core) - len(lacks)
                mark = np.concatenate([lacks, more])
                seen = counts[np.searchsorted(often, mark)]
                seen[: len(lacks)] = n - seen[: len(lacks)]
                marks.append(mark[np.lexsort((mark, seen))].tobytes())
                far.append((len(lacks) + least * (size - has)) / (1 + least))
                room.append((1 - least) / (1 + least) * len(core))
            names = ["fp", "root", "family", "first"]
            made = [pa.array(far, pa.float64()), pa.array(room, pa.float64()), pa.array([len(x) // 8 for x in marks], pa.int64()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *made], names=[*names, "far", "room", "many", "marks"])

    return run


def _marked(batches):
    """Classes with the levels of others -> a row for each mark by which they may meet one of a level."""
    names = ["key", "side", "fp", "root", "far", "room", "many", "at"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    for b in batches:
        out = [[np.zeros(0, np.float64 if t == pa.float64() else np.int64)] for t in types]
        for r in b.to_pylist():
            mark = np.frombuffer(r["marks"], np.uint64)
            for side, levels in ((0, r["firsts"] if r["is_far"] else None), (1, r["fars"] if r["first"] else None)):
                for v in levels or ():
                    need = max(1, int(np.ceil(r["far"] + v["low"] - r["room"] - 1e-6)))
                    n = len(mark) - need + 1
                    if need > v["many"] or n <= 0:
                        continue
                    x, y = (r["level"], v["level"]) if side == 0 else (v["level"], r["level"])
                    mix = np.uint64(xxhash.xxh64_intdigest(np.array([r["family"], x, y], np.int64).tobytes(), 42))
                    rows = [(mark[:n] ^ mix).view(np.int64), side, r["fp"], r["root"], r["far"], r["room"], r["many"], np.arange(n)]
                    for o, z in zip(out, rows):
                        o.append(z if isinstance(z, np.ndarray) else np.full(n, z))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, types)], names=names)


def open_pairs(
    met: DataFrame, roots: DataFrame, classes: DataFrame, keyed: DataFrame, shingle: int = SHINGLE, least: float = LEAST, pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """Distinct pairs ``(a, b)``, a > b, of classes that ``roots(fp, root)`` has in different groups.
    Verified, they join whatever classes of similarity ``least`` share a large key.

    Shingles in more than ``pair_limit`` of the classes are common. Classes that share another are
    paired by it. Two that share only common ones need these for ``least`` of their size, and of
    classes with the same common shingles the smallest, the first, stands for all: what is near one
    of them is near the first. With a family's ``core`` set (any will do; a key's classes are
    of one family, which is named by the smallest class that keys of its classes hold), let a class lack d core shingles and have e besides. Two are near if
    they share ``far + far - room`` or more of these marks, where far = (d + least e) / (1 + least) and
    room = (1 - least) / (1 + least) |core|. So classes with far + far <= room are all near the one
    that is least far, and any other pair shares one of the first marks, as many as either
    can miss and one, in any order of marks. Marks meet by level of ``far``, as the number depends on both.
    """
    many = materialise(met.where(F.col("n") > pair_limit).select("k", "key", "fp", "size").join(roots, "fp"), "many")
    spans = many.groupBy("k", "key").agg(F.min("fp").alias("b"), F.min("root").alias("low"), F.max("root").alias("high"))
    spans = materialise(spans.where("low < high").select("k", "key", "b"), "spans")
    left = materialise(many.join(maybe_broadcast(spans, 40), ["k", "key"]).select("k", "key", "fp", "size", "root", "b"), "open")
    discard(many, spans)
    if left.isEmpty():
        discard(left)
        return materialise(roots.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false"), "pairs")
    low = materialise(left.groupBy("fp").agg(F.min("b").alias("low")), "low")
    names = materialise(left.join(low, "fp").groupBy("k", "key").agg(F.min("low").alias("family")), "names")
    homes = materialise(left.join(maybe_broadcast(names, 40), ["k", "key"]).select("fp", "family").distinct(), "homes")
    ends = materialise(left.select("fp", "size", "root").distinct(), "ends")
    own = class_sets(ends.select("fp"), classes, keyed, shingle)
    sets = materialise(ends.join(own, "fp"), "family_sets")
    total = sets.agg(F.sum("size")).first()[0]
    packed = materialise(sets.mapInArrow(_packed(max(1, total >> 16)), "bucket long, data binary"), "packed")
    rare, tokens = pair_limit, None
    while tokens is None or tokens.where("kind = 0").count() > MOST_COMMON:
        rare = rare if tokens is None else 2 * rare
        discard(tokens)
        tokens = materialise(packed.groupBy("bucket").applyInArrow(_counted(rare, least), "kind int, a long, b long"), "tokens")
    common = tokens.where("kind = 0").select("a", "b").toArrow()
    often, counts = common.column("a").to_numpy().view(np.uint64), common.column("b").to_numpy()
    order = np.argsort(often)
    often, counts = often[order], counts[order]
    found = tokens.where("kind = 1").select("a", "b")

    parts = sets.mapInArrow(_common(often, least), "fp long, size long, root long, part binary, digest long")
    dense = materialise(parts.join(homes, "fp"), "dense")
    firsts = dense.groupBy("family", "digest").agg(F.min(F.struct("size", "fp")).alias("low"))
    firsts = firsts.select("family", F.col("low.fp").alias("fp"), F.lit(True).alias("first"))
    sizes = materialise(dense.groupBy("family").agg(F.count("*").alias("n")), "sizes")
    sample = dense.join(maybe_broadcast(sizes, 24), "family").where(F.expr(f"pmod(xxhash64(fp), greatest(1, n div {CORE_SAMPLE})) = 0"))
    cores = sample.select("family", "part").groupBy("family").applyInArrow(_core, "family long, core binary")
    cores = materialise(sizes.join(cores, "family", "left"), "cores")
    width = cores.agg(F.max(F.length("core"))).first()[0] or 0
    whole = dense.join(maybe_broadcast(cores, 32 + width), "family").join(firsts, ["family", "fp"], "left").select("fp", "size", "root", "family", F.coalesce("first", F.lit(False)).alias("first"), "part", "core", "n")
    schema = "fp long, root long, family long, first boolean, far double, room double, many long, marks binary"
    apart = materialise(whole.mapInArrow(_apart(often, counts, least), schema), "apart")
    discard(left, low, names, homes, ends, own, sets, packed, dense, sizes, cores)

    apart = apart.withColumn("level", F.floor(8 * F.log2(1 + F.col("far"))).cast("long"))
    mids = materialise(apart.groupBy("family").agg(F.min(F.struct("far", "fp", "root")).alias("mid")), "mids")
    is_far = F.col("far") + F.col("mid.far") > F.col("room") + 1e-6
    placed = apart.join(maybe_broadcast(mids, 40), "family").withColumn("is_far", is_far)
    near = placed.where("NOT is_far AND root != mid.root").select(F.col("fp").alias("a"), F.col("mid.fp").alias("b"))
    levels = placed.groupBy("family", "level").agg(
        F.min("far").alias("low"), F.max("many").alias("most"),
        F.min(F.when(F.col("is_far"), F.col("far"))).alias("far_low"), F.max(F.when(F.col("is_far"), F.col("many"))).alias("far_most"),
    )
    listed = levels.groupBy("family").agg(  # some hundred levels at most
        F.collect_list(F.struct("level", "low", F.col("most").alias("many"))).alias("firsts"),
        F.collect_list(F.when(F.col("far_low").isNotNull(), F.struct("level", F.col("far_low").alias("low"), F.col("far_most").alias("many")))).alias("fars"),
    )
    listed = materialise(listed, "levels")
    rows = placed.where("is_far OR first").join(maybe_broadcast(listed, 4096), "family")
    rows = rows.select("fp", "root", "family", "first", "far", "room", "many", "marks", "level", "is_far", "firsts", "fars")
    marked = materialise(rows.mapInArrow(_marked, "key long, side long, fp long, root long, far double, room double, many long, at long"), "marked")
    one, two = (marked.where(F.col("side") == i).select("key", *[F.col(c).alias(c + str(i)) for c in ("fp", "root", "far", "room", "many", "at")]) for i in (0, 1))
    need = F.greatest(F.lit(1), F.ceil(F.col("far0") + F.col("far1") - F.col("room0") - 1e-6))
    meet = one.join(two, "key").where("root0 != root1").where((F.col("at0") + need <= F.col("many0")) & (F.col("at1") + need <= F.col("many1")))
    pairs = found.union(near).union(meet.select("fp0", "fp1"))
    out = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    discard(tokens, mids, listed, marked)
    return out


def class_sets(ends: DataFrame, classes: DataFrame, keyed: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The sets of the distinct classes ``ends(fp)``. ``classes(fp, _k1, _k2)`` have the key of one of
    their rows in ``keyed(_k1, _k2, _text)``."""
    wanted = materialise(classes.select("fp", "_k1", "_k2").join(ends, "fp", "left_semi"), "wanted")
    # Rows of one key are equal in the text.
    texts = keyed.join(maybe_broadcast(wanted, 48), ["_k1", "_k2"]).select("fp", "_text")
    sets = materialise(texts.mapInArrow(_set_bytes(shingle), "fp long, set binary").dropDuplicates(["fp"]), "sets")
    discard(wanted)
    return sets


def verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Those of ``pairs(a, b)`` that are near, by the sets of their texts (:func:`class_sets`)."""
    ends = pairs.select(F.col("a").alias("fp")).distinct().union(pairs.select(F.col("b").alias("fp")).distinct()).distinct()
    sets = class_sets(ends, classes, keyed, shingle)
    ta, tb = sets.toDF("a", "ta"), sets.toDF("b", "tb")
    out = materialise(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(least), "a long, b long"), "near")
    discard(sets)
    return out


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST,
    pair_limit: int = PAIR_LIMIT, reach: int = REACH,
) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that of the smallest id (null
    ids last; ties go to the smaller hash of the whole row; of repeated rows one stays)."""
    k1, k2 = row_key(docs)
    keyed = docs.select(F.struct("*").alias("_row"), k1.alias("_k1"), k2.alias("_k2"), text_column(text_col).alias("_text"))
    prints = materialise(
        deal(docs.select(column(id_col).alias("_id"), k1.alias("_k1"), k2.alias("_k2"), text_column(text_col).alias("_text"))).mapInArrow(
            _classes(shingle), f"_id {dict(docs.dtypes)[id_col]}, _k1 long, _k2 long, fp long, size long, bands array<long>, print long"
        ),
        "prints",
    )
    best = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_k1", "_k2")).alias("low")
    classes = prints.groupBy("fp").agg(best, F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("print").alias("print"))
    classes = materialise(classes.select("fp", "size", "bands", "print", "low._k1", "low._k2"), "classes")
    low = materialise(prints.groupBy("print").agg(best), "low")
    of = classes.select("fp", F.col("print").alias("b"))
    same = materialise(prints.select("fp", "print").distinct().join(of, "fp").where("print != b").select(F.col("print").alias("a"), "b"), "same")
    discard(prints)

    def between(near: DataFrame) -> DataFrame:
        """Links of classes as links of their fingerprints."""
        a, b = classes.select(F.col("fp").alias("a"), F.col("print").alias("pa")), classes.select(F.col("fp").alias("b"), F.col("print").alias("pb"))
        return near.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))

    texts = keyed.select("_k1", "_k2", "_text")
    met = shared_keys(classes.select("fp", "size", "bands"))
    pairs = candidates(met, least, pair_limit, reach)
    near = verified(pairs, classes, texts, shingle, least)
    roots = connected_components(simhash.links(low.select(F.col("print").alias("fp"))).union(same).union(between(near)))
    named = classes.select("fp", "print").join(roots, F.col("print") == F.col("node"), "left").select("fp", F.coalesce("root", "print").alias("root"))
    rest = open_pairs(met, named, classes, texts, shingle, least, pair_limit)
    discard(met, pairs, near, same)
    if not rest.isEmpty():
        more = verified(rest, classes, texts, shingle, least)
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(between(more)))
        discard(more)
    discard(rest)
    rooted = low.join(roots, F.col("print") == F.col("node"), "left").select("low", F.coalesce("root", "print").alias("root"))
    kept = materialise(rooted.groupBy("root").agg(F.min("low").alias("low")).select("low._k1", "low._k2"), "kept")
    discard(low, classes)
    return keyed.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("_row.*")
