"""Hierarchical packing of documents into context windows of several sizes (operator 4).

Documents are cut into whole top-tier windows first; each rest goes to the smallest tier
that holds it.  Tiers are packed from the longest to the shortest: a piece opens a window
of its tier, the gap is filled with the longest pieces that fit (best fit, mostly from
shorter tiers), and a last gap is closed by cutting a piece.  Windows of one tier are
then dealt to step groups so that the groups' attention costs are alike.

Each task packs the documents it reads and keeps about ``BLOCK_TOKENS`` ids in memory, so
ids are never shuffled, a hot source needs no care, and a lost task packs the same again.
Only a task's very last window may stay unfilled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from paneltide.llm.common import arrow_session
from paneltide.llm.tokens import default_tokenizer, encoder

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Ids held before windows are written, and ids kept back to fill the next ones.
BLOCK_TOKENS, RESERVE_TOKENS = 1 << 20, 1 << 16
#: A gap of fewer ids in a top-tier window is padded, rather than cutting a piece for it.
SLACK = 16
#: Ids of a step group; it takes so many divided by the tier windows of a tier.
STEP_TOKENS = 1 << 16

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Packer:
    """One task's packing.  A piece is (length, number, doc_id, start, doc_tokens, ids)."""

    def __init__(self, tiers: tuple[int, ...], slack: int, step_tokens: int, base: int):
        self.tiers, self.top, self.slack, self.step_tokens = tiers, tiers[-1], slack, step_tokens
        self.pools: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.done: dict[int, list[list[tuple]]] = {t: [] for t in tiers}
        self.pooled = self.held = self.pieces = 0
        self.sequences = self.groups = base

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.top:
            self.done[self.top].append([self._piece(self.top, doc_id, at, total, ids)])
            at += self.top
        if at < total:
            self._put(self._piece(total - at, doc_id, at, total, ids))
        self.held += total

    def _piece(self, length: int, doc_id, start: int, total: int, ids: bytes) -> tuple:
        self.pieces += 1
        return (length, self.pieces, doc_id, start, total, ids)

    def _put(self, piece: tuple) -> None:
        tier = next(t for t in self.tiers if piece[0] <= t)
        insort(self.pools[tier], piece)
        self.pooled += piece[0]

    def _take(self, tier: int, at: int) -> tuple:
        piece = self.pools[tier].pop(at)
        self.pooled -= piece[0]
        return piece

    def _longest_within(self, gap: int) -> tuple | None:
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            if pool and pool[0][0] <= gap:
                return self._take(tier, bisect_right(pool, (gap, float("inf"))) - 1)
        return None

    def _cut(self, gap: int) -> tuple | None:
        """The head of the shortest piece longer than the gap; its rest goes back."""
        for tier in self.tiers:
            pool = self.pools[tier]
            if pool and pool[-1][0] > gap:
                length, _, doc_id, start, total, ids = self._take(tier, bisect_left(pool, (gap + 1,)))
                self._put(self._piece(length - gap, doc_id, start + gap, total, ids))
                return self._piece(gap, doc_id, start, total, ids)
        return None

    def pack(self, reserve: int) -> None:
        """Make windows until at most ``reserve`` ids are left to fill later ones."""
        for tier in reversed(self.tiers):
            while self.pools[tier] and self.pooled > reserve:
                window = [self._take(tier, len(self.pools[tier]) - 1)]
                gap = tier - window[0][0]
                while gap:
                    piece = self._longest_within(gap)
                    if piece is None and not (tier == self.top and gap < self.slack):
                        piece = self._cut(gap)
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= piece[0]
                self.done[tier].append(window)

    def rows(self, last: bool) -> list[tuple]:
        """Written pieces; step groups are full, except a task's last ones."""
        out = []
        for tier, windows in self.done.items():
            size = max(1, self.step_tokens // tier)
            now = len(windows) if last else len(windows) // size * size
            windows, self.done[tier] = windows[:now], windows[now:]
            groups = -(-now // size)
            windows.sort(key=lambda w: -sum(p[0] * p[0] for p in w))
            for i, window in enumerate(windows):
                lap, seat = divmod(i, groups)
                group = self.groups + (seat if lap % 2 == 0 else groups - 1 - seat)
                offset = 0
                for length, _, doc_id, start, total, ids in window:
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    out.append((doc_id, start, length, crc, total, self.sequences, offset, tier, group))
                    offset += length
                self.sequences += 1
            self.groups += groups
        self.held = self.pooled + sum(p[0] for ws in self.done.values() for w in ws for p in w)
        return out


def _pack_task(tokenizer: str, end_id: int, tiers: tuple[int, ...], slack: int, step_tokens: int):
    end = end_id.to_bytes(4, "little")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in SCHEMA.split(", ")]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        # Numbers of different tasks never meet: a task has 2**32 of its own.
        packer = Packer(tiers, slack, step_tokens, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encode(text.as_py()) + end)
                if packer.held >= BLOCK_TOKENS + RESERVE_TOKENS:
                    packer.pack(RESERVE_TOKENS)
                    if rows := packer.rows(last=False):
                        yield batch_of(rows)
        packer.pack(0)
        if rows := packer.rows(last=True):
            yield batch_of(rows)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    slack: int = SLACK,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece; every id of every document, end id included, is in one piece.

    ``sequence_id`` and ``step_group`` are unique over the whole result, ``offset`` is a
    piece's place in its window.  Windows of lower tiers are always full (unless one is a
    task's last), so they need no padding.  NULL and empty texts are their end id alone;
    NULL ids pass through; repeated rows are packed each; an empty table gives no rows;
    further columns are ignored.
    """
    if list(tiers) != sorted(set(tiers)) or not tiers or tiers[0] < 1:
        raise ValueError("tiers have to grow")
    arrow_session(docs.sparkSession)
    run = _pack_task(tokenizer or default_tokenizer(), end_id, tuple(tiers), slack, step_tokens)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
