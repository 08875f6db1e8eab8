import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import components, fingerprints, line_dedup, near_copies, simhash


def brute_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots_of(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def brute_components(rows):
    """rows of (id, fingerprint) -> id and component, by all pairs."""
    n = len(rows)
    r = roots_of(n, [(i, j) for i in range(n) for j in range(i) if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2])
    low = defaultdict(list)
    for (i, _), k in zip(rows, r):
        low[k] += [i] if i is not None else []
    return sorted(((i, f"{f:016x}", min(low[k], default=None)) for (i, f), k in zip(rows, r)), key=str)


@pytest.mark.parametrize("text", ["", None, "A", "a B", "One two THREE", "É È a b c d", "w " * 2000 + "v u t", "a\x0bb\x1cc\u00a0d e f"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_simhash_on_table(documents, texts):
    got = sorted((tuple(r) for r in simhash.components(documents).collect()), key=str)
    assert got == brute_components([(i, brute_print(t)) for i, t in texts.items()])


def test_simhash_odd_rows(odd, empty):
    rows = [(r.doc_id, brute_print(r.text)) for r in odd.collect()]
    assert sorted((tuple(r) for r in simhash.components(odd).collect()), key=str) == brute_components(rows)
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2]
    assert kept.count() == len(set(roots_of(len(rows), pairs)))
    assert simhash.components(empty).count() == simhash.dedup(empty).count() == 0


@pytest.mark.parametrize("pair_limit", [64, 3, 0])
def test_links_join_what_all_pairs_join(spark, pair_limit):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):  # clusters with chains within them
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for k in rng.sample(range(64), rng.choice((1, 2, 3))):
                x ^= 1 << k
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    at = {simhash._signed(x): i for i, x in enumerate(fps)}
    got = [(at[r.a], at[r.b]) for r in simhash.links(df, pair_limit).collect()]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in pairs}
    assert roots_of(len(fps), got) == roots_of(len(fps), pairs)


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_by_hand(rows, least=0.8):
    """rows of (id, text) -> the smallest id of each group."""
    s = [shingle_set(t) for _, t in rows]
    like = lambda a, b: a == b or len(a & b) >= least * len(a | b) > 0
    r = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if like(s[i], s[j])])
    low = {}
    for (i, _), k in zip(rows, r):
        low[k] = min(low.get(k, i), i)
    return sorted(low.values())


def test_near_copies_stage_by_all_pairs(spark, documents, empty):
    """Against brute force on the fixture and on edited copies of known similarity."""
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(10_000)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    for i in range(60):
        base = [word() for _ in range(300)]
        rows.append((10_000 + 2 * i, " ".join(base)))
        for k in rng.sample(range(300), rng.randrange(1, 14)):  # each takes up to five shingles on either side
            base[k] = word()
        rows.append((10_001 + 2 * i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_by_hand(rows)
    assert len(want) < len(rows) - 20
    import corpus_pipeline

    assert sorted(r.doc_id for r in corpus_pipeline.remove_near_copies(spark, df, "").collect()) == want
    assert sorted(r.doc_id for r in near_copies.dedup(df, pair_limit=2).collect()) == want
    assert near_copies.dedup(empty).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Far more of one base than a key pairs off: all of them are one group still."""
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(10_000) for _ in range(300)]
    rows = []
    for i in range(1500):
        own = list(base)
        for k in rng.sample(range(300), 4):
            own[k] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows + [(5000, "quite another text " * 9)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.dedup(df).collect()) == [0, 5000]


def test_near_copies_stage_links_by_simhash(spark):
    """What op3 links is one group in the pipeline, though its sets of five words are unlike,
    and so is what hangs on it by similarity alone."""
    import corpus_pipeline

    rng = random.Random(5)
    words = lambda n: ["w%d" % rng.randrange(10_000) for _ in range(n)]
    rows, want = [], []
    for i in range(0, 60, 3):
        passage, tail = words(100), words(60)
        like = [*tail[:30], "other", *tail[31:]]
        texts = [" ".join(passage * 200 + words(60)), " ".join(passage * 200 + tail), " ".join(passage + like)]
        sets = [shingle_set(t) for t in texts]
        jaccard = lambda x, y: len(x & y) / len(x | y)
        assert jaccard(sets[0], sets[1]) < 0.8 and jaccard(sets[0], sets[2]) < 0.8 <= jaccard(sets[1], sets[2])
        rows += [(i + k, t) for k, t in enumerate(texts)]
        bits = bin(brute_print(texts[0]) ^ brute_print(texts[1])).count("1")
        want += [i] if bits <= 2 else [i, i + 1]
    assert len(want) < 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.remove_near_copies(spark, df, "").collect()]
    assert sorted(kept) == want
    named = simhash.components(df).where(F.col("doc_id").isin(kept))
    assert named.select("component_id").distinct().count() == len(kept)


def test_keys_beyond_the_pair_limit_lose_no_link(spark):
    """Pairs amid many texts that share keys with them but aren't near copies, with so few
    neighbours looked at that the order alone misses links."""
    rng = random.Random(8)
    base = ["w%d" % rng.randrange(10_000) for _ in range(300)]
    rows = []
    for i in range(120):
        own = list(base)
        for k in rng.sample(range(300), 7):
            own[k] = "x%d" % rng.randrange(10**6)
        rows.append((2 * i, " ".join(own)))
        for k in rng.sample(range(300), 6):
            own[k] = "x%d" % rng.randrange(10**6)
        rows.append((2 * i + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_by_hand(rows)
    assert len(want) == 120
    assert sorted(r.doc_id for r in near_copies.dedup(df, pair_limit=1, reach=1).collect()) == want


def edited(rng, words, n, fresh):
    """``words`` after ``n`` edits: words exchanged, put in or taken out."""
    own = list(words)
    for _ in range(n):
        at = rng.randrange(len(own))
        own[at : at + rng.choice((1, 1, 0, 2))] = rng.choice(([fresh()], [fresh()], [fresh(), fresh()]))
    return own


def kept_by_hand(rows, least=0.8):
    """rows of (id, text) -> the smallest id of each group by either kind of link."""
    s, f = [shingle_set(t) for _, t in rows], [brute_print(t) for _, t in rows]
    like = lambda i, j: (f[i] ^ f[j]).bit_count() <= 2 or len(s[i] & s[j]) >= least * len(s[i] | s[j])
    r = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if like(i, j)])
    return sorted({rows[k][0] for k in r})


@pytest.mark.parametrize("pair_limit", [1, 4, 16])
def test_open_pairs_join_what_all_pairs_join(spark, pair_limit):
    """Large keys of texts around the threshold, some bases akin, edits by rare and by common words."""
    rng = random.Random(21)
    rare = lambda: "x%d" % rng.randrange(10**6)
    common = lambda: "c%d" % rng.randrange(3)
    first = [rare() for _ in range(150)]
    bases = [first, edited(rng, first, 6, rare), first[:75] + [rare() for _ in range(75)], [rare() for _ in range(40)]]
    rows = []
    for k in range(600):
        own = edited(rng, bases[k % 7 % 4], rng.choice((0, 1, 2, 2, 3, 3, 4, 6, 12)), rng.choice((rare, common)))
        rows.append((2 * k, " ".join(own)))
        if k % 5 == 0:  # akin to one that is itself far from the rest
            rows.append((2 * k + 1, " ".join(edited(rng, own, 2, rare))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_hand(rows)
    assert 100 < len(want) < 600
    assert sorted(r.doc_id for r in near_copies.dedup(df, pair_limit=pair_limit, reach=1).collect()) == want


def test_open_pairs_grow_with_a_group_not_its_square(spark, monkeypatch):
    """Edited copies of one text, most of them beyond the threshold from all others."""
    rng = random.Random(4)
    base = ["w%d" % rng.randrange(10_000) for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice((1, 2, 3, 4, 5)), lambda: "x%d" % rng.randrange(10**6)))) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts, whole = [], near_copies.open_pairs

    def counted(*args):
        out = whole(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "open_pairs", counted)
    assert sorted(r.doc_id for r in near_copies.dedup(df).collect()) == kept_by_hand(rows)
    assert counts[0] < 10 * len(rows)


def test_near_copies_odd_rows(odd):
    kept = near_copies.dedup(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({frozenset(shingle_set(r.text)) for r in odd.collect()}) - 1  # the long one and its copy with an end


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (5, 4)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def lines_by_hand(rows, least=5):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\r\x0b\x0c"):
                sites[x] |= {s} - {None}
                if i is not None:
                    first[x] = min(first.get(x, i), i)
    bad = {x for x in sites if len(sites[x]) >= least}
    out = []
    for i, t, s in rows:
        keep = [x for x in (t or "").split("\n") if x not in bad or first.get(x) == i]
        out.append((i, None if t is None else "\n".join(keep)))
    return sorted(out, key=str)


def test_a_document_of_many_boilerplate_lines(spark):
    long = "\n".join(f"line {i}" for i in range(100_000))
    df = spark.createDataFrame([(i, long, f"s{i}") for i in range(5)] + [(9, "own", "s1")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df, counts=True).collect()}
    assert got == {0: (100_000, 0), **{i: (100_000, 100_000) for i in range(1, 5)}, 9: (1, 0)}


def test_small_ids_and_dotted_names(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, None)], "`doc.id` short, `the.text` string")
    out = fingerprints.edit_trial(df, "doc.id", "the.text")
    assert out.count() == 3 and dict(out.dtypes)["doc.id"] == "smallint"
    assert simhash.components(df, "doc.id", "the.text").count() == 3


@pytest.mark.parametrize("least", [2, 5])
def test_line_dedup(documents, odd, empty, least):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
        got = line_dedup.dedup_lines(df, min_sites=least)
        assert got.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == lines_by_hand(rows, least)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_sketches_decide_far_lines(spark):
    """Many sites: sketched, far from the threshold; few: exact."""
    rows = [(i, "common\nown %d" % i, "s%d" % i) for i in range(300)] + [(1000 + i, "rare", "s%d" % (i % 4)) for i in range(40)]
    rows += [(2000 + i, "edge", "s%d" % (i % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df, lg_k=8).collect()), key=str)
    assert got == lines_by_hand(rows)


def test_canonical_text_folds():
    same = ["Straße  ＡＢＣ\n", "strasse abc", " STRASSE\tabc "]
    assert len({fingerprints.fingerprint(t) for t in same}) == 1
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint(" \n") != fingerprints.fingerprint("a")
    assert fingerprints.canonical("e\u0301") == unicodedata.normalize("NFKC", "é")


def edits_by_hand(rows):
    import hashlib

    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        fp, fe, fn = map(fingerprints.fingerprint, (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp, fe, float(fp == fe), float(fp == fn)))
    return sorted(out, key=str)


def test_edit_trial(documents, odd, empty):
    for df in (documents, odd):
        got = fingerprints.edit_trial(df)
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted((tuple(r) for r in got.select(cols).collect()), key=str) == edits_by_hand(rows)
    assert fingerprints.edit_trial(empty).count() == 0


def test_equal_bytes_decide_groups(spark, monkeypatch):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "other"), (4, "a b"), (5, "third")], "doc_id long, text string")
    prints = spark.createDataFrame([(i, fingerprints.fingerprint(t)) for i, t in df.collect()], "_id long, fp string")
    got = sorted((r._id, r.same_as) for r in fingerprints.exact_groups(df, prints).collect())
    assert got == [(1, 1), (2, 1), (4, 1)]
