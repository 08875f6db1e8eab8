"""Quality rules: base rules, then gradient-boosted trees over document statistics.

One pass over the texts yields each document's statistics. Trees are fitted here on
the statistics of labelled documents (at most ``max_rows`` of them, those of the
smallest id hash), with histogram splits, logistic loss and monotonic constraints:
more symbols, repeated lines or repeated windows never raise a score. The trees are
flattened into numpy node arrays, and batches of documents walk them together.

Defined cases: a null text has no words and fails the base rules; labels that are
null or have no document are ignored; of several labels for a document the lowest
counts; without labels of both kinds every document that passes the base rules is
kept; repeated rows each get their row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column, deal, materialise, text_column

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.15, 64, 4
THRESHOLD = 0.5
#: Statistics the trees see, and the direction (-1: more is never better) of each.
FEATURES = {
    "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "log_words": 0, "mean_word": 0, "distinct_share": 0,
    "upper_share": -1, "digit_share": 0, "shout_share": -1, "stop_share": 0, "line_words": 0,
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, len(words))
    if len(number) > len(words) - 2:  # a second window needs `window` repeats
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    equal = s[1:] == s[:-1]
    if not equal.any():
        return 0
    a, b = order[:-1][equal], order[1:][equal]
    same = np.ones(len(a), bool)
    for k in range(window):
        same &= ids[a + k] == ids[b + k]
    if same.all():
        starts = np.union1d(a, b)
    else:  # hashes met by chance: count the windows themselves
        rows = [tuple(words[i : i + window]) for i in range(n)]
        seen = Counter(rows)
        starts = np.asarray([i for i, r in enumerate(rows) if seen[r] > 1], np.int64)
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


_SYMBOLS, _CAPITALS, _DIGITS = SYMBOLS.encode(), bytes(range(65, 91)), b"0123456789"


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then :data:`FEATURES`."""
    t = text or ""
    raw = t.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0, *[0.0] * len(FEATURES))
    joined = b"".join(words)
    chars = len(joined.decode())
    count = lambda which: len(joined) - len(joined.translate(None, which))
    symbols = count(_SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    sizes = list(map(len, words))
    return (
        n, chars, symbols, dup, repeat,
        symbols / chars, dup / len(lines), repeat / n, float(np.log1p(n)), chars / n, len(set(words)) / n,
        count(_CAPITALS) / chars, count(_DIGITS) / chars, count(b"!") / n, (sizes.count(1) + sizes.count(2)) / n, n / len(lines),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features...)``."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * (len(counts) + len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(c, pa.int64() if i < len(counts) else pa.float64()) for i, c in enumerate(cols)],
                names=["_id", *counts, *FEATURES],
            )

    schema = ", ".join([f"_id {dict(docs.dtypes)[id_col]}", *[f"{c} long" for c in counts], *[f"{c} double" for c in FEATURES]])
    return deal(docs.select(column(id_col).alias("_id"), text_column(text_col).alias("_text"))).mapInArrow(run, schema)


@dataclass
class Trees:
    """All trees in flat arrays; a node's children are ``left`` and ``left + 1``, a leaf
    points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.threshold[at]
            leaf = self.left[at] < 0
            at = np.where(leaf, at, self.left[at] + right)
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, leaf: int = LEAF) -> Trees:
    """Boosted trees for ``y`` in 0, 1. Splits that would break a sign are refused, and
    children are kept on their side of the middle between them, so scores are monotonic."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    feature, threshold, left, value, roots = [], [], [], [], []
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(n, base)
    ridge = 1.0

    def node(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(-1)
        value.append(v)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        root = node(0.0)
        roots.append(root)
        todo = [(root, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, d, lo, hi = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            v = float(np.clip(gs / (hs + ridge), lo, hi))
            value[at] = rate * v
            best = None
            if d < depth and len(rows) >= 2 * leaf:
                for j in range(m):
                    k = len(cuts[j]) + 1
                    if k < 2:
                        continue
                    b = binned[rows, j]
                    cg, ch, cn = (np.cumsum(np.bincount(b, w, minlength=k))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = np.clip(cg / (ch + ridge), lo, hi), np.clip((gs - cg) / (hs - ch + ridge), lo, hi)
                    gain = vl * cg - 0.5 * vl**2 * (ch + ridge) + vr * (gs - cg) - 0.5 * vr**2 * (hs - ch + ridge)
                    ok = (cn >= leaf) & (len(rows) - cn >= leaf)
                    if signs[j]:
                        ok &= signs[j] * (vr - vl) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    i = int(gain.argmax())
                    if gain[i] > (best[0] if best else gs * v - 0.5 * v * v * (hs + ridge) + 1e-6):
                        best = (float(gain[i]), j, i, float(vl[i]), float(vr[i]))
            if best is None:
                score[rows] += value[at]
                continue
            _, j, i, vl, vr = best
            goes = binned[rows, j] > i
            a = node(0.0)
            b = node(0.0)
            feature[at], threshold[at], left[at] = j, float(cuts[j][i]), a
            mid = (vl + vr) / 2
            bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[signs[j]]
            todo += [(a, rows[~goes], d + 1, *bounds[0]), (b, rows[goes], d + 1, *bounds[1])]
    return Trees(np.asarray(feature), np.asarray(threshold), np.asarray(left), np.asarray(value), np.asarray(roots), base, depth)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees | None:
    """Trees from a bounded sample of labelled documents; None without both kinds."""
    y = labels.where(column(label_col).isNotNull()).groupBy(column(id_col).alias("_lid")).agg(F.min(column(label_col).cast("int")).alias("_y"))
    rows = (
        stats.join(y, F.col("_id") == F.col("_lid"))
        .select("_id", "_y", *FEATURES)
        .dropDuplicates(["_id"])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
        .toPandas()
    )
    if rows["_y"].nunique() < 2:
        return None
    return fit(rows[list(FEATURES)].to_numpy(float), rows["_y"].to_numpy(float), list(FEATURES.values()))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = MAX_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, quality)`` for each row of ``docs``; ``quality`` is the trees' probability."""
    stats = materialise(measure(docs, id_col, text_col), "statistics")
    trees = train(stats, labels, id_col, label_col, max_rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    if trees is None:
        scored = stats.withColumn("quality", F.lit(1.0))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(trees)  # TREES * 2 ** (DEPTH + 1) nodes at most

        @F.pandas_udf("double")
        def score(*cols):
            return cols[0].__class__(shared.value.probability(np.stack([c.to_numpy(float) for c in cols], axis=1)))

        scored = stats.withColumn("quality", score(*FEATURES))
    return scored.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality",
    )
