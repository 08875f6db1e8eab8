"""Token ids as binary shards with a minimal perfect hash index over document keys.

A dataset is a folder of shards, each for a range of ids in ascending order:

``shard-NNNNN.bin``
    raw little-endian ids of all its documents, one after the other; two bytes each
    if the vocabulary fits, else four.
``shard-NNNNN.idx``
    a header (magic, id width, rows, keys, levels and their bits), the levels of the
    hash function in blocks of 64 bytes, each after the number of set bits before it,
    for each slot a 32-bit fingerprint of its key, the number of its rows and the first
    of them, and for each row its key, its first id and its number of ids.
``manifest``
    a Parquet table of the shards: counts, first and last key, first id of the shard.

The hash function is minimal and perfect by levels of bits: keys that alone hit a
bit of a level are placed there, the others go on to the next level; a key's slot is
the number of set bits before its own. A lookup visits about one and a half levels
whatever the number of keys, and the slot's fingerprint turns away most keys that
aren't there (the key of the row settles it).

:meth:`Dataset.get` finds the shard of a key in the manifest and reads by ranges: the
header, a block of 72 bytes for each level it visits, a slot, its row, and the ids. None
of these depends on how much a shard holds. :func:`read_tokens` looks all keys of a
shard up in its index and takes rows and ids from the slots it returns.

Executors write shards through ``pyarrow.fs`` under the shared folder; a shard is
written under a name of its own attempt and then renamed, so a task that runs twice
leaves one whole shard. Shards are cut by bytes of text (:data:`SHARD_BYTES`), so the
keys that one task holds are bounded too.

Defined cases: a null or empty text has just the end id; null ids come last and have
no key (they are in the rows, not in the index); rows with the same id lie side by
side, ordered by the first 64 characters of the text, then by its hash, in several
shards if they are many, and the index finds the first; an empty table gives no shards
and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import column, scratch_path, text_column
from graphloom.llm.tokenise import encoder

MAGIC = b"GLTOK002"
_HEAD = struct.Struct("<8sIIQQ")
GAMMA = 2.0
#: Bytes of text in a shard; smaller inputs have a shard a core, of a megabyte at least.
SHARD_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
BLOCK = 512
_LEVEL = np.dtype([("before", "<u8"), ("bits", "<u8", (BLOCK // 64,))])
_SLOT = np.dtype([("print", "<u4"), ("rows", "<u4"), ("row", "<u8")])
_ROW = np.dtype([("key", "<i8"), ("first", "<i8"), ("count", "<i8")])


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _print(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0xF00D) >> np.uint64(32)).astype(np.uint32)


def _levels(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, positions of its set bits) of each level for distinct 64-bit keys."""
    left, k = keys.view(np.uint64), 0
    while len(left):
        m = max(8, int(GAMMA * len(left)))
        at = (_mix(left, k) % np.uint64(m)).astype(np.int64)
        hits = np.bincount(at, minlength=m)
        yield m, np.flatnonzero(hits == 1)
        left, k = left[hits[at] != 1], k + 1


@dataclass
class PerfectHash:
    """Sizes of the levels, and their blocks: set bits before each, and its bits."""

    sizes: list[int]
    blocks: list[np.ndarray]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` must be distinct (signed 64-bit)."""
        sizes, blocks, before = [], [], 0
        for m, ones in _levels(keys):
            bits = np.zeros(-(-m // BLOCK) * BLOCK, np.uint8)
            bits[ones] = 1
            level = np.zeros(len(bits) // BLOCK, _LEVEL)
            level["bits"] = np.packbits(bits, bitorder="little").view("<u8").reshape(len(level), -1)
            held = bits.reshape(len(level), BLOCK).sum(axis=1, dtype=np.int64)
            level["before"] = before + np.cumsum(held) - held
            before += len(ones)
            sizes.append(m)
            blocks.append(level)
        return cls(sizes, blocks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys not built in, any slot or -1."""
        keys = np.ascontiguousarray(keys, np.int64).view(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (m, level) in enumerate(zip(self.sizes, self.blocks)):
            if not len(todo):
                break
            at = (_mix(keys[todo], k) % np.uint64(m)).astype(np.int64)
            hit, slot = slot_in(level[at // BLOCK], at % BLOCK)
            out[todo[hit]] = slot[hit]
            todo = todo[~hit]
        return out


def slot_in(blocks: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a bit of each block: whether it is set, and the set bits before it."""
    word, one = bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64)
    own = np.take_along_axis(blocks["bits"], word[:, None], axis=1)[:, 0]
    rank = blocks["before"].astype(np.int64) + np.bitwise_count(own & (one - np.uint64(1)))
    for w in range(BLOCK // 64):
        rank += np.where(word > w, np.bitwise_count(blocks["bits"][:, w]), 0).astype(np.int64)
    return (own & one) != 0, rank


def pack_index(keys: np.ndarray, null: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> bytes:
    """The ``.idx`` bytes of a shard whose rows are in order, those without a key last."""
    distinct, at, rows = np.unique(keys[~null], return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), _SLOT)
    slot = mph.slots(distinct)
    slots["print"][slot], slots["rows"][slot], slots["row"][slot] = _print(distinct), rows, at
    table = np.zeros(len(keys), _ROW)
    table["key"], table["first"], table["count"] = keys, first, count
    head = _HEAD.pack(MAGIC, width, len(mph.sizes), len(keys), len(distinct))
    return b"".join([head, np.asarray(mph.sizes, "<u8").tobytes(), *(b.tobytes() for b in mph.blocks), slots.tobytes(), table.tobytes()])


class Shard:
    """A shard opened for reading by ranges; :meth:`get` finds a document by its key."""

    def __init__(self, fs: pafs.FileSystem, stem: str):
        self._idx, self._bin = fs.open_input_file(stem + ".idx"), fs.open_input_file(stem + ".bin")
        self.bytes_read = 0
        magic, self.width, levels, self.n, self.k = _HEAD.unpack(self._read(self._idx, 0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{stem}.idx is no token index")
        self.sizes = np.frombuffer(self._read(self._idx, _HEAD.size, 8 * levels), "<u8").astype(np.int64)
        held = -(-self.sizes // BLOCK) * _LEVEL.itemsize
        self._at = _HEAD.size + 8 * levels + np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
        self._slots = int(self._at[-1])
        self._rows = self._slots + self.k * _SLOT.itemsize

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self._idx.close()
        self._bin.close()

    def _read(self, file, at: int, size: int) -> bytes:
        self.bytes_read += size
        return file.read_at(size, at)

    def _table(self, kind: np.dtype, at: int, first: int = 0, n: int = 1) -> np.ndarray:
        return np.frombuffer(self._read(self._idx, at + first * kind.itemsize, n * kind.itemsize), kind)

    def slot(self, key: int) -> np.void | None:
        """The slot of a key, None for one that isn't there (but for a rare clash of
        fingerprints, which the row's own key tells)."""
        one = np.asarray([key], np.int64)
        for k, m in enumerate(self.sizes.tolist()):
            at = int(_mix(one, k)[0]) % m
            hit, slot = slot_in(self._table(_LEVEL, int(self._at[k]), at // BLOCK), np.asarray([at % BLOCK]))
            if hit[0]:
                found = self._table(_SLOT, self._slots, int(slot[0]))[0]
                return found if found["print"] == _print(one)[0] else None
        return None

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document of that key."""
        slot = self.slot(key)
        if slot is None:
            return None
        row = self._table(_ROW, self._rows, int(slot["row"]))[0]
        if row["key"] != key:
            return None
        got = self._read(self._bin, int(row["first"]) * self.width, int(row["count"]) * self.width)
        return np.frombuffer(got, f"<u{self.width}").astype("<u4")

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows, in order, as the index finds them: each key of the shard is looked up,
        and its slot says which rows are its own. And for each, whether it has a key."""
        table = self._table(_ROW, self._rows, 0, self.n)
        blocks = [self._table(_LEVEL, int(a), 0, -(-m // BLOCK)) for a, m in zip(self._at[:-1], self.sizes.tolist())]
        slots = self._table(_SLOT, self._slots, 0, self.k)
        keyed = int(slots["rows"].sum())
        keys = np.unique(table["key"][:keyed])
        at = PerfectHash(self.sizes.tolist(), blocks).slots(keys)
        if len(keys) != self.k or (at < 0).any() or (slots["print"][at] != _print(keys)).any():
            raise ValueError("a key isn't in its index")
        own = slots[at]
        place = np.repeat(own["row"].astype(np.int64), own["rows"]) + np.arange(keyed) - np.repeat(np.cumsum(own["rows"]) - own["rows"], own["rows"]).astype(np.int64)
        rows = table[place]
        if (rows["key"] != np.repeat(keys, own["rows"])).any():
            raise ValueError("the index names rows of other keys")
        return np.concatenate([rows, table[keyed:]]), np.arange(self.n) < keyed

    def ids(self, rows: np.ndarray) -> list[bytes]:
        """The ids of rows that lie near each other, as unsigned 32-bit integers; one read for all."""
        first, end = rows["first"] - rows["first"].min(), int((rows["first"] + rows["count"]).max())
        got = self._read(self._bin, int(rows["first"].min()) * self.width, (end - int(rows["first"].min())) * self.width)
        all_ = memoryview(got if self.width == 4 else np.frombuffer(got, "<u2").astype("<u4").tobytes())
        return [all_[a : a + n] for a, n in zip((4 * first).tolist(), (4 * rows["count"]).tolist())]


class Dataset:
    """A folder of shards: finds a document's ids by its key."""

    def __init__(self, spark: SparkSession, folder: str):
        self._fs, self._base = open_folder(folder)
        rows = read_manifest(spark, folder).where("first_key IS NOT NULL").orderBy("shard").collect()  # one for each shard
        self._last, self._shards = [r.last_key for r in rows], [(r.first_key, r.name) for r in rows]

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document of ``key``, read from one shard; None if there is
        none."""
        at = bisect.bisect_left(self._last, key)
        if at == len(self._last) or self._shards[at][0] > key:
            return None
        with Shard(self._fs, f"{self._base}/{self._shards[at][1]}") as shard:
            return shard.get(key)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """``uri`` as Spark names it -> pyarrow's filesystem and the path in it."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _shard_writer(folder: str, vocab_file: str, end_id: int, width: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        enc, task = encoder(vocab_file), TaskContext.get()
        fs, base = open_folder(folder)
        name = f"shard-{task.partitionId():05d}"
        part = f"{base}/_{name}-{task.taskAttemptId()}"
        keys, counts, out = [], [], None
        for b in batches:
            if b.num_rows and out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(part + ".bin")
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                keys.append(i)
                counts.append(len(ids) // 4)
                out.write(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        if out is None:
            return
        out.close()
        null = np.asarray([k is None for k in keys])
        key, count = np.asarray([k or 0 for k in keys], np.int64), np.asarray(counts, np.int64)
        with fs.open_output_stream(part + ".idx") as f:
            f.write(pack_index(key, null, np.cumsum(count) - count, count, width))
        for kind in (".bin", ".idx"):
            fs.move(part + kind, f"{base}/{name}{kind}")
        own = key[~null]
        ends = [own[0], own[-1]] if len(own) else [None, None]
        row = [task.partitionId(), name, len(keys), int(count.sum()), *ends]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 4))], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


MANIFEST = "shard int, name string, docs long, ids long, first_key long, last_key long"


def write_tokens(
    docs: DataFrame, vocab_file: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    shards: int | None = None, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write ``docs`` to ``folder`` and return its manifest, ``start`` included: the ids before
    each shard. ``shards`` defaults to as many as hold ``shard_bytes`` of text each."""
    spark = docs.sparkSession
    width = 2 if max(encoder(vocab_file).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
    text = text_column(text_col)
    if shards is None:
        size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
        shards = max(1, math.ceil(size / shard_bytes), min(spark.sparkContext.defaultParallelism, math.ceil(size / LEAST_BYTES)))
    order = [F.col("_id").asc_nulls_last(), "_start", "_hash", "_place"]  # an id's rows can lie in several shards
    ordered = (
        docs.select(
            column(id_col).cast("long").alias("_id"), text.alias("_text"), F.substring(text, 1, 64).alias("_start"), F.xxhash64(text).alias("_hash"),
            F.monotonically_increasing_id().alias("_place"),
        )
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .select("_id", "_text")
    )
    ordered.mapInArrow(_shard_writer(folder, vocab_file, end_id, width), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each shard, with the ids before it; ordered by shard number alone."""
    m = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return m.select("*", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("start"))


def read_tokens(manifest: DataFrame, folder: str, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """``(id_col, start, n_tokens, ids_crc32)`` of each document, read from the shards; with
    ``ids`` also the ids. Rows and places of ids are those that the index gives for each key."""
    names = [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * ids]

    def run(batches):
        fs, base = open_folder(folder)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist()):
                with Shard(fs, f"{base}/{name}") as shard:
                    rows, keyed = shard.found()
                    for at in range(0, len(rows), 1024):
                        some = rows[at : at + 1024]
                        own = shard.ids(some)
                        cols = [
                            pa.array(some["key"], pa.int64(), mask=~keyed[at : at + 1024]), pa.array(some["first"] + start, pa.int64()), pa.array(some["count"], pa.int64()),
                            pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays([*cols, *[pa.array([np.frombuffer(x, "<u4") for x in own], pa.list_(pa.int64()))] * ids], names=names)

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "start", "shard").repartition(n, "shard").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Write to a scratch folder and read back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, vocab_file, folder, id_col, text_col, end_id), folder, id_col)
