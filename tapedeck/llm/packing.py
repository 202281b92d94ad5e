"""Hierarchical multi-length packing of documents into training sequences.

A document's ids, closed by id 0, are routed by length: whole windows of the longest
context are cut off first; what is left goes to the tier of the smallest context that holds
it (1024, 512, 256 or 128 tokens). Tiers are packed from the longest: each window is opened
by its tier's pieces, longest first, and its gap is filled with the pieces of shorter tiers,
the best fitting first, the last one cut to fit. Contexts are powers of two, so a full
window of any tier needs no padding. What a flush leaves at its end is cut into windows of
powers of two. Windows of a tier are numbered into step groups of equal token counts; the
last group of a tier in a task may be short.

Each task packs the rows it reads, in flushes of bounded size: no shuffle, no gathered
group, and a lost task is redone from its input alone. Ids of sequences hold the partition.
What waits is a copy of a document's remainder, never its whole ids, so a task holds at most
``FLUSH`` token places and the one text that it is encoding.

Defined results: a null or empty text is one piece, the id 0; equal rows are packed each; a
null doc_id stays null in its pieces; an empty table gives an empty one; other columns,
whatever their names, are not read; a very long text is encoded in pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_of
from .tokens import default_vocabulary, vocabulary

TIERS = (1024, 512, 256, 128)
#: Token places (of 4 bytes) that are held before they are packed, and what a piece itself takes.
FLUSH, PIECE = 1 << 20, 64
#: Tokens of a step group.
STEP = 8192

_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _SCHEMA.split(", ")])


class Packer:
    """Packs pieces (document, its ids from ``start`` on, start, all its tokens); ``rows``
    gathers what is placed."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step: int = STEP):
        self.tiers, self.step = tiers, step
        self.base = partition << 40
        self.sequences = 0
        self.of_tier = dict.fromkeys(tiers, 0)
        self.waiting: dict[int, list] = {t: [] for t in tiers}
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, at, n = self.tiers[0], 0, len(ids)
        while n - at >= top:
            self._window([(doc_id, ids[at : at + top], at, n)], top)
            at += top
        if at < n:
            left = ids[at:].copy()  # a view would keep the whole document
            self.waiting[min(t for t in self.tiers if t >= len(left))].append((doc_id, left, at, n))
            self.held += len(left) + PIECE

    def _window(self, pieces: list[tuple], tier: int) -> None:
        group = self.of_tier.get(tier, 0) * tier // self.step
        self.of_tier[tier] = self.of_tier.get(tier, 0) + 1
        offset = 0
        for doc_id, ids, start, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.base + self.sequences, offset, tier, self.base + (group << 12) + tier.bit_length()))
            offset += len(ids)
        self.sequences += 1

    def flush(self) -> None:
        """Place all that waits."""
        size = lambda p: len(p[1])
        for tier in self.tiers:
            own = sorted(self.waiting[tier], key=size, reverse=True)
            self.waiting[tier] = []
            shorter = sorted((p for t in self.tiers if t < tier for p in self.waiting[t]), key=size)
            for t in self.tiers:
                if t < tier:
                    self.waiting[t] = []
            below = max((t for t in self.tiers if t < tier), default=0)
            at = 0
            while True:
                if at < len(own):
                    first = own[at]
                    at += 1
                elif shorter and size(shorter[-1]) > below:  # what is left of a cut piece
                    first = shorter.pop()
                else:
                    break
                window, gap = [first], tier - size(first)
                while gap:
                    # The longest of the shorter tiers that fits, else a piece that is cut to fit.
                    low = bisect_right(shorter, gap, key=size)
                    if low:
                        piece = shorter.pop(low - 1)
                    elif shorter or at < len(own):
                        doc_id, ids, start, n = shorter.pop(0) if shorter else own.pop()
                        if len(ids) > gap:
                            self._keep(shorter, (doc_id, ids[gap:], start + gap, n))
                            ids = ids[:gap]
                        piece = (doc_id, ids, start, n)
                    else:
                        break
                    window.append(piece)
                    gap -= size(piece)
                if gap:
                    self._tail(window, tier)
                else:
                    self._window(window, tier)
            for p in shorter:
                self.waiting[min(t for t in self.tiers if t >= size(p))].append(p)
        self.held = 0

    @staticmethod
    def _keep(shorter: list, piece: tuple) -> None:
        shorter.insert(bisect_right(shorter, len(piece[1]), key=lambda p: len(p[1])), piece)

    def _tail(self, window: list[tuple], tier: int) -> None:
        """The last, short window of a flush: windows of powers of two, the longest first."""
        left = sum(len(ids) for _, ids, _, _ in window)
        queue = window[::-1]
        while left:
            length = 1 << (left.bit_length() - 1)
            pieces, need = [], length
            while need:
                doc_id, ids, start, n = queue.pop()
                pieces.append((doc_id, ids[:need], start, n))
                if len(ids) > need:
                    queue.append((doc_id, ids[need:], start + need, n))
                need -= len(pieces[-1][1])
            self._window(pieces, length)
            left -= length

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) or [[] for _ in _ARROW]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS, flush: int = FLUSH) -> DataFrame:
    """One row for each piece; every id of every document lies in exactly one."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, v = Packer(TaskContext.get().partitionId(), tiers), vocabulary(path)
        for batch in batches:
            for a, b in chunks(batch.column(1), 1 << 20):
                texts = batch.column(1)[a:b].to_pylist()
                for key, ids in zip(batch.column(0)[a:b].to_pylist(), v.ids(texts)):
                    packer.add(key, np.append(ids, np.uint32(0)))
                    if packer.held >= flush:
                        packer.flush()
                    if len(packer.rows) >= 20_000:
                        yield packer.batch()
        packer.flush()
        yield packer.batch()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, _SCHEMA)


def report(docs: DataFrame, **options) -> DataFrame:
    return pack(docs, **options)
