"""Best-fit packing of token sequences into fixed-length training sequences.

Documents are tokenised in place; only what describes a piece (no token ids) is
shuffled. Pieces are dealt by hash to packers of about ``per_packer`` pieces, so the
number of packers follows the input while each keeps enough pieces to fill gaps
well. A packer is bounded-space online best fit: at most ``open_bins`` sequences are
open; their free spaces are marked in an integer used as a bitset, so the smallest
space that fits a piece is found by masking and taking the lowest bit. When a new
sequence would exceed the bound, the fullest open one is closed.

Defined cases: a null or empty text has just the end id; a document of more ids
than a sequence holds is cut into whole sequences and a rest; repeated rows are
packed once each; null ids are ids like others; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import column, deal, materialise, text_column
from graphloom.llm.tokenise import encoder

LENGTH = 2048
OPEN_BINS = 2048
PER_PACKER = 250_000


class BestFit:
    """Places lengths one after the other; see the module's text."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit k: an open bin has k free places
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free places
        self.n_open = self.next_bin = 0

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        b = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        return b

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of ``1 <= length <= capacity``."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = self._take(space)
            self.n_open -= 1
        else:
            space, b = self.capacity, self.next_bin
            self.next_bin += 1
            if length < space and self.n_open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.n_open -= 1
        left = space - length
        if left:
            self.bins[left].append(b)
            self.free |= 1 << left
            self.n_open += 1
        return b, self.capacity - space


def pieces(docs: DataFrame, vocab_file: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(_id, piece, start, length, ids_crc32)`` for each piece of each row's ids."""
    kind = dict(docs.dtypes)[id_col]
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(vocab_file)
        for b in batches:
            rows, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["_id", "piece", "start", "length", "ids_crc32"],
            )

    return deal(docs.select(column(id_col).alias("_id"), text_column(text_col).alias("_text"))).mapInArrow(
        run, f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack(
    docs: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, end_id: int = 0, open_bins: int = OPEN_BINS, per_packer: int = PER_PACKER,
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece."""
    kind = dict(docs.dtypes)[id_col]
    cut = materialise(pieces(docs, vocab_file, length, end_id, id_col, text_col), "pieces")
    packers = max(1, math.ceil(cut.count() / per_packer))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_deal", "_id", "piece", "ids_crc32"], kind="stable")
        fit = BestFit(length, open_bins)
        placed = [fit.place(n) for n in pdf["length"].tolist()]
        first = int(pdf["packer"].iloc[0]) << 40
        return pdf[["_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=[first + b for b, _ in placed], offset=[o for _, o in placed])

    # By place as well, so that a row that repeats without end isn't dealt to one packer.
    dice = F.xxhash64("_id", "piece", "ids_crc32")
    return (
        cut.select("*", dice.alias("_deal"), F.pmod(F.xxhash64(F.lit(3), dice, F.monotonically_increasing_id()), F.lit(packers)).alias("packer"))
        .groupBy("packer")
        .applyInPandas(place, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
        .withColumnRenamed("_id", id_col)
    )
