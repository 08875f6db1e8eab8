"""Language ID: script ranges, per-word scores and Viterbi spans.

Learning: character n-gram counts of words (orders 1 to 4 with word ends, hashed to
``BUCKETS``) for each language, from a sample of at most about ``per_lang`` documents
for each, picked by id hash; partial counts are summed by aggregation. The model is a
matrix of languages by buckets, and the share of each script in each language. Every
labelled language is learned; the matrix grows with their number alone. A word is a
letter and the letters and marks that follow it.

Labelling: a word's letters fall into script ranges; only languages that use its
scripts are candidates for it. Each word gets a score for each language, remembered
for the next time it comes up. Viterbi over the words with a penalty for switching
labels spans; the language of most letters is the prediction. If no stretch of words
gains more than half the penalty by leaving the language that is best overall (a
maximum subarray, found by running sums), no path with switches can be better: one
with k other stretches gains at most k halves and pays k - 1 penalties or more. Then
the step-by-step search is skipped.

Defined cases: a null text or one without letters is ``und`` with score 0; words
without letters have no say; a null id is not held out and not learned from; ties go
to the first language by name; without any labelled text all is ``und``; repeated
rows each get their row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column, deal, materialise, text_column

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
PER_LANG = 3_000
SWITCH = 12.0
#: Words that a worker remembers at most, and bytes of their scores.
MEMORY, MEMORY_BYTES = 600_000, 64 << 20

#: First code points of script ranges; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
_FROM = [a for a, _ in SCRIPTS]
_ASCII = re.compile("[a-z]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text: a letter and what letters and marks follow it."""
    text = (text or "").lower()
    return _ASCII.findall(text) if text.isascii() else _LETTERS.findall(unicodedata.normalize("NFC", text))


def script_of(ch: str) -> str:
    return SCRIPTS[bisect.bisect_right(_FROM, ord(ch)) - 1][1]


def letters_only(word: str) -> str:
    """``word`` without its marks, which many scripts share."""
    return word if word.isascii() else "".join(c for c in word if unicodedata.category(c)[0] != "M")


def buckets_of(letters: str) -> list[int]:
    t = f"<{letters}>"
    return [zlib.crc32(t[i : i + k].encode()) % BUCKETS for k in ORDERS for i in range(len(t) - k + 1)]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # languages by buckets
    scripts: dict[str, np.ndarray]  # of each script: which languages use it

    def __post_init__(self):
        self.logp_t = np.ascontiguousarray(self.logp.T)
        self.none = np.zeros(len(self.langs), bool)
        self.even = -math.log(BUCKETS) / len(ORDERS)  # of an n-gram, if all were as frequent

    def uses(self, script: str) -> np.ndarray:
        return self.scripts.get(script, self.none)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    """A model from ``docs`` (pass only rows it may learn from)."""
    base = docs.select(column(id_col).cast("string").alias("_id"), text_column(text_col).alias("_text"), column(lang_col).cast("string").alias("_lang"))
    base = base.where("_id IS NOT NULL AND _text IS NOT NULL AND _lang IS NOT NULL")
    counts = {r[0]: r[1] for r in base.groupBy("_lang").count().collect()}  # one row for each language
    langs = sorted(counts)
    if not langs:
        return None
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / counts[lang]))])
    dice = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = base.where(F.col("_lang").isin(langs)).where(dice < share[F.col("_lang")])
    number = {x: i for i, x in enumerate(langs)}

    def count(batches):
        grams = np.zeros((len(langs), BUCKETS), np.int64)
        scripts: dict[tuple[int, str], int] = {}
        memory: dict[str, tuple] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = number[lang]
                for w, n in Counter(words_of(text)).items():
                    if w not in memory:
                        if len(memory) > MEMORY // 4:
                            memory.clear()
                        memory[w] = (np.asarray(buckets_of(w), np.int64), Counter(map(script_of, letters_only(w))))
                    at, of = memory[w]
                    np.add.at(grams[k], at, n)
                    for s, m in of.items():
                        scripts[k, s] = scripts.get((k, s), 0) + m * n
        for k in range(len(langs)):
            at = np.flatnonzero(grams[k])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array([""] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(grams[k, at], pa.int64())], names=["k", "script", "bucket", "n"])
        own = list(scripts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for (k, _), _ in own], pa.int32()), pa.array([s for (_, s), _ in own], pa.string()), pa.array([-1] * len(own), pa.int64()), pa.array([n for _, n in own], pa.int64())],
            names=["k", "script", "bucket", "n"],
        )

    got = deal(sample.select("_text", "_lang")).mapInArrow(count, "k int, script string, bucket long, n long")
    got = got.groupBy("k", "script", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages times buckets at most
    c = np.zeros((len(langs), BUCKETS))
    g = got[got["bucket"] >= 0]
    c[g["k"].to_numpy(), g["bucket"].to_numpy()] = g["n"].to_numpy()
    c += 0.5
    logp = (np.log(c / c.sum(axis=1, keepdims=True)) / len(ORDERS)).astype(np.float32)
    s = got[got["bucket"] < 0]
    total = s.groupby("k")["n"].sum()
    scripts = {}
    for k, script, n in zip(s["k"], s["script"], s["n"]):
        if n >= 0.01 * total[k]:
            scripts.setdefault(script, np.zeros(len(langs), bool))[k] = True
    return Model(langs, logp, scripts)


class Labeller:
    """Scores words by a model, remembering them, and labels texts. A word is a run of
    letters, lower-cased."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.bucket: dict[str, int] = {}
        self.script: dict[str, str] = {}
        self.memory = max(1000, min(MEMORY, MEMORY_BYTES // (8 * len(model.langs))))
        self._clear()

    def _clear(self):
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.langs)))
        self.letters = np.zeros(1024, np.int64)
        self.gain = np.zeros(1024)  # of the best language over even n-grams; -inf: a script of none

    def _learn(self, words: list[str]) -> None:
        """Remember ``words``, none of which is known."""
        first, k = len(self.number), len(words)
        while first + k > len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        if len(self.bucket) > MEMORY:
            self.bucket.clear()
        at, starts, known = [], [], self.bucket
        for w in words:
            starts.append(len(at))
            t = f"<{w}>"
            for g in [t[i : i + n] for n in ORDERS for i in range(len(t) - n + 1)]:
                x = known.get(g)
                if x is None:
                    x = known[g] = zlib.crc32(g.encode()) % BUCKETS
                at.append(x)
        rows = np.add.reduceat(self.model.logp_t[at], starts, axis=0)
        uses = np.tile(self.model.uses("latin"), (k, 1))
        for i, w in enumerate(words):
            if not w.isascii():
                uses[i] = self._uses(w)
        rows = np.where(uses, rows, -np.inf)
        grams = np.diff(np.asarray([*starts, len(at)]))
        self.gain[first : first + k] = rows.max(axis=1) - grams * self.model.even
        rows = np.maximum(rows - rows.max(axis=1, keepdims=True, initial=-1e9), -20.0)
        rows[~uses.any(axis=1)] = 0.0
        self.scores[first : first + k] = rows
        self.letters[first : first + k] = list(map(len, words))
        self.number.update(zip(words, range(first, first + k)))

    def _uses(self, word: str) -> np.ndarray:
        """Which languages use the scripts of ``word``."""
        out = np.zeros(len(self.model.langs), bool)
        for c in set(letters_only(word)):
            s = self.script.get(c)
            if s is None:
                s = self.script[c] = script_of(c)
            out |= self.model.uses(s)
        return out

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language for each word, given scores of words by languages."""
        best = int(s.sum(axis=0).argmax())
        run = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.concatenate([np.zeros((1, s.shape[1])), run[:-1]]), axis=0)
        if (run - low).max() <= self.switch / 2:
            return np.full(len(s), best)
        # Few languages: lists are faster than arrays of so few numbers.
        rows, switch = s.tolist(), self.switch
        score, before, limits, tops = rows[0], [], [], []
        for row in rows[1:]:
            most = max(score)
            limit = most - switch
            before.append(score)
            limits.append(limit)
            tops.append(most)
            score = [(x if x >= limit else limit) + y for x, y in zip(score, row)]
        at = score.index(max(score))
        out = [at]
        for prev, limit, most in zip(reversed(before), reversed(limits), reversed(tops)):
            if prev[at] < limit:
                at = prev.index(most)
            out.append(at)
        return np.asarray(out[::-1])

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of each span."""
        at = self._numbers(text)
        if not len(at) or not self.letters[at].any():
            return []
        p = self.path(self.scores[at])
        cut = np.flatnonzero(np.diff(p)) + 1
        ends = [0, *cut.tolist(), len(p)]
        return [(a, b, self.model.langs[p[a]]) for a, b in zip(ends, ends[1:])]

    def _numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64)
        if len(self.number) > self.memory:
            self._clear()
        new = set(words).difference(self.number)
        if new:
            self._learn(sorted(new))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def label(self, text: str | None) -> tuple[str, float]:
        """The language of most letters and its share of them; for a text of one language
        the share is times the odds against the others. The score of a text none of whose
        letters is in a script of a learned language is 0."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """:meth:`label`, and whether the text is of learned languages at all: half its
        letters or more are in their scripts, and over these its n-grams are likelier in its
        words' best languages than if all n-grams were as frequent. Neither depends on how
        many languages there are."""
        at = self._numbers(text)
        if not len(at):
            return "und", 0.0, False
        gain = self.gain[at]
        total = gain.sum()
        if total > -np.inf:  # every word is in a script of some language
            return *self._label(at), bool(total > 0)
        own = np.isfinite(gain)
        letters = self.letters[at]
        known = bool(2 * letters[own].sum() >= letters.sum() and gain[own].sum() > 0)
        lang, score = self._label(at)
        return lang, score if own.any() else 0.0, known

    def _label(self, at: np.ndarray) -> tuple[str, float]:
        letters = self.letters[at]
        s = self.scores[at]
        by = np.bincount(self.path(s), weights=letters, minlength=len(self.model.langs))
        best = int(by.argmax())
        share = by[best] / letters.sum()
        if share == 1.0:
            sums = s.sum(axis=0)
            share = 1 / np.exp(np.minimum(sums - sums[best], 50.0)).sum()
        return self.model.langs[best], float(min(1.0, share))


def identify(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, keep: list[str] | None = None
) -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` for each row of ``docs``. With ``keep``, the
    named columns of ``docs`` as ``_c0`` and so on instead of the id and held_out, and
    ``known`` besides (see :meth:`Labeller.judge`)."""
    carried = keep or [id_col]
    picked = docs.select(*[column(c).alias(f"_c{i}") for i, c in enumerate(carried)], text_column(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 128 KB for each language

    def run(batches):
        own = Labeller(shared.value, switch) if shared.value is not None else None
        for b in batches:
            out = [own.judge(t) if own else ("und", 0.0, False) for t in b.column(len(carried)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(carried)], pa.array([x for x, _, _ in out], pa.string()), pa.array([x for _, x, _ in out], pa.float64()), pa.array([x for _, _, x in out], pa.bool_())],
                names=[*b.schema.names[: len(carried)], "lang_pred", "score", "known"],
            )

    kinds = dict(docs.dtypes)
    out = deal(picked).mapInArrow(run, ", ".join([f"_c{i} {kinds[c]}" for i, c in enumerate(carried)] + ["lang_pred string", "score double", "known boolean"]))
    if keep:
        return out
    return out.select(F.col("_c0").alias(id_col), held_out(F.col("_c0")).alias("held_out"), "lang_pred", "score")


def learnable(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The rows that a model may learn from: labelled and not held out."""
    return docs.where(~held_out(column(id_col)) & column(id_col).isNotNull() & column(lang_col).isNotNull())


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are of learned languages (see :meth:`Labeller.judge`): texts
    without letters, of other scripts or of random letters go; a missing language is
    filled in."""
    model = learn(learnable(docs, id_col, lang_col), id_col, text_col, lang_col)
    out = identify(docs, model, id_col, text_col, keep=docs.columns).where("known")
    cols = []
    for i, c in enumerate(docs.columns):
        x = F.coalesce(f"_c{i}", "lang_pred") if c == lang_col else F.col(f"_c{i}")
        cols.append(x.alias(c))
    return out.select(cols)
