import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from graphloom.llm import mixing, packing, token_output, tokenise


def whole(vocab, texts):
    t = Tokenizer.from_file(vocab)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD_TEXTS = [
    "", None, " \n", "a,b.c, d. é. ß, can't won't. '.' ... ,. x., 1, 2.", "<|endoftext|> in <|startoftext|>text", "e\u0301 A\u030a. \u00a0x\u2003y\x0bz\x1cq", "漢字。かな, 한글.",
    "İstanbul ΣΑΣ. \U0001f600, ok", "a" * 5000, "it's they're. we'll, I'd", "H\u0331 T\u0308. W\u030a, J\u030c I\u0307 K \u212a", "(paren) 'quoted'. a-b --c-- #tag! $5.00 <|x|> 'S 'LL.", "½! ²³, x².y ٣.", "<|ENDOFTEXT|>",
]


def test_word_memory_gives_the_ids_of_whole_texts(vocab, texts, monkeypatch):
    all_ = ODD_TEXTS + list(texts.values())
    want = [np.asarray(x, "<u4").tobytes() for x in whole(vocab, all_)]
    enc = tokenise.WordEncoder(vocab)
    assert [enc.encode(t) for t in all_] == want
    monkeypatch.setattr(tokenise, "MEMORY", 10)
    enc = tokenise.WordEncoder(vocab)
    assert [enc.encode(t) for t in all_] == want


def pieces_by_hand(vocab, rows, size):
    out = []
    for (i, _), ids in zip(rows, whole(vocab, [t for _, t in rows])):
        ids = ids + [0]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            out.append((i, k // size, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    return sorted(out, key=str)


def hold(got, size):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size,bins,per", [(2048, 2048, 250_000), (64, 16, 500)])
def test_packing(documents, odd, empty, vocab, size, bins, per):
    for df in (documents, odd):
        got = packing.pack(df, vocab, length=size, open_bins=bins, per_packer=per).collect()
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted((tuple(r[:5]) for r in got), key=str) == pieces_by_hand(vocab, rows, size)
        n, full = hold(got, size), sum(r.length for r in got)
        assert n <= 1.1 * full / size + 8
    assert packing.pack(empty, vocab).count() == 0


def test_best_fit_picks_the_tightest_and_closes_the_fullest():
    rng = random.Random(2)
    fit, open_, n = packing.BestFit(100, 4), {}, 0
    for _ in range(3000):
        x = rng.randint(1, 100)
        b, o = fit.place(x)
        able = [f for f in open_.values() if f >= x]
        if able:
            assert open_[b] == min(able) and o == 100 - min(able)
            open_[b] -= x
        else:
            assert b == n and o == 0
            n += 1
            if x < 100 and len(open_) == 4:
                full = min(open_.values())
                gone = [k for k, v in open_.items() if v == full]
                assert len(set(open_) - set(gone)) == 4 - len(gone)
                open_.pop(next(k for k in gone if k not in fit.bins[full]))
            open_[b] = 100 - x
        if not open_.get(b, 1):
            del open_[b]
        assert sorted((f, k) for f, s in enumerate(fit.bins) for k in s) == sorted((f, k) for k, f in open_.items())


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and t[s] >= cap * sizes[s]}
        if not over:
            return t
        full |= over
        if len(full) == len(names):
            return {s: cap * sizes[s] for s in names}


def test_mix(spark, documents, odd, empty):
    for df, near in ((documents, 0.02), (odd, None)):
        got = mixing.mix(df).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)  # reruns agree
        src = {(r.doc_id, r.text): r.source for r in df.collect()}
        want = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect()]
        assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(want, key=str)
        sizes = defaultdict(int)
        for r in df.collect():
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        aim = targets_by_hand(sizes)
        assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
        assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in aim.values()})
        if near:
            by, source = defaultdict(int), {r.doc_id: r.source for r in df.collect()}
            for r in got:
                by[source[r.doc_id]] += r.taken
            assert all(abs(by[s] - aim[s]) <= near * aim[s] + 60 for s in aim)
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_rates_solve_the_dual(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = defaultdict(list)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in mixing.mix(docs).collect():
        by[source[r.doc_id]].append(r)
    for rows in by.values():
        assert abs(sum(r.rate * r.size for r in rows) / rows[0].target - 1) < 1e-6
        assert abs(sum(r.taken for r in rows) / rows[0].target - 1) < 0.01
        lam = [math.log(r.rate) * (r.size + rows[0].source_size / len(rows)) / r.size for r in rows if 0 < r.rate < 2.999]
        assert max(lam, default=0) - min(lam, default=0) < 1e-6  # one multiplier for each source


def test_apply_mix_repeats_rows(documents):
    got = mixing.apply_mix(documents)
    assert got.columns == documents.columns
    want = {r.doc_id: r.copies for r in mixing.mix(documents).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == want


def test_chunk_ends_near_its_aim():
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"size": rng.integers(0, 4000, 500), "rate": rng.random(500) * 3, "_k1": range(500), "_k2": 0})
    out = mixing.round_chunk(rows)
    assert abs((out["copies"] * out["size"]).sum() - (rows["rate"] * rows["size"]).sum()) < 50
    assert out["copies"].max() <= 3 and (abs(out["copies"] - out["rate"]) < 2).all()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    mph = token_output.PerfectHash.build(keys)
    assert sorted(mph.slots(keys)) == list(range(len(keys)))
    assert not len(token_output.PerfectHash.build(keys[:0]).slots(keys[:0]))


def test_round_trip(documents, odd, empty, vocab):
    for df in (documents, odd):
        rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        want, at = [], 0
        for (i, _), ids in zip(rows, whole(vocab, [t for _, t in rows])):
            ids = np.asarray([*ids, 1], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = token_output.round_trip(df, vocab).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.round_trip(empty, vocab).count() == 0


def test_keyed_access(spark, documents, texts, vocab, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_output.write_tokens(documents, vocab, folder, shards=4)
    fs, base = token_output.open_folder(folder)
    shards = [token_output.Shard(fs, f"{base}/{r.name}") for r in manifest.collect()]
    want = dict(zip(texts, whole(vocab, texts.values())))
    found = {k: [s.get(k) for s in shards if s.get(k) is not None] for k in list(want)[::9]}
    assert all(len(x) == 1 and x[0].tolist() == want[k] + [1] for k, x in found.items())
    assert all(s.get(k) is None for s in shards for k in (-1, 10**12, 7**20))
    assert token_output.read_tokens(manifest, folder, ids=True).count() == len(want)


def test_keyed_access_by_dataset(spark, documents, texts, vocab, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_output.write_tokens(documents, vocab, folder, shards=4)
    data = token_output.Dataset(spark, folder)
    want = dict(zip(texts, whole(vocab, texts.values())))
    assert all(data.get(k).tolist() == want[k] + [1] for k in list(want)[::9])
    assert all(data.get(k) is None for k in (-1, 10**12, 7**20))
    got = {r.doc_id: r.ids for r in token_output.read_tokens(manifest, folder, ids=True).collect()}
    assert got == {k: [*x, 1] for k, x in want.items()}


def test_repeats_are_dealt_over_chunks_and_packers(spark, vocab):
    df = spark.range(20_000).selectExpr("1L AS doc_id", "'one row again and again' AS text", "'s' AS source")
    mixed = mixing.mix(df)
    assert mixed.agg({"taken": "sum"}).first()[0] == pytest.approx(100_000, rel=1e-3)
    packed = packing.pack(df, vocab, per_packer=1000)
    assert packed.count() == 20_000 and packed.selectExpr("shiftright(sequence_id, 40)").distinct().count() == 20


def test_a_lookup_reads_little_whatever_the_shard_holds(tmp_path):
    from pyarrow import fs as pafs

    fs, read = pafs.LocalFileSystem(), {}
    for n in (1_000, 200_000):
        keys = np.arange(n, dtype=np.int64) * 7 - 1000
        count = np.full(n, 3)
        (tmp_path / f"s{n}.idx").write_bytes(token_output.pack_index(keys, np.zeros(n, bool), np.cumsum(count) - count, count, 4))
        (tmp_path / f"s{n}.bin").write_bytes(np.arange(3 * n, dtype="<u4").tobytes())
        most = 0
        for k in range(0, n, n // 50):
            with token_output.Shard(fs, f"{tmp_path}/s{n}") as shard:
                assert shard.get(int(keys[k])).tolist() == [3 * k, 3 * k + 1, 3 * k + 2]
                most = max(most, shard.bytes_read)
                assert shard.get(int(keys[k]) + 1) is None
        read[n] = most
    assert max(read.values()) < 1500


def test_rows_of_one_id_lie_in_several_shards(spark, vocab, tmp_path):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "'one text' AS text")
    folder = f"file://{tmp_path}/hot"
    manifest = token_output.write_tokens(df, vocab, folder, shards=8)
    assert max(r.docs for r in manifest.collect()) < 600
    assert sorted(r.doc_id for r in token_output.read_tokens(manifest, folder).collect()) == sorted(r.doc_id for r in df.collect())
    assert token_output.Dataset(spark, folder).get(7) is not None


def test_other_vocabularies_are_encoded_whole(texts):
    import public_tokenizers

    other = public_tokenizers.path("byte_bpe_50k.json")
    some = [*ODD_TEXTS, "Hello World", *list(texts.values())[:20]]
    enc = tokenise.WordEncoder(other)
    assert not enc.by_words and [enc.encode(t) for t in some] == [np.asarray(x, "<u4").tobytes() for x in whole(other, some)]
