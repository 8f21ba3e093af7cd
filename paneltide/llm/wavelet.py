"""Token ids in wavelet-matrix files, one per shard (operator 8).

A shard's ids are stored as bit planes, highest bit first; below each plane the ids are
reordered, those with a 0 before those with a 1, both in their order.  Planes are cut
into compressed blocks with the number of ones before each, so a reader answers

* ``access``  the id at a position,
* ``rank``    how often an id occurs before a position,
* ``select``  the position of its k-th occurrence

from one file, reading one or two blocks per plane, and ``tokens`` restores all ids.

File: magic, 8 bytes header size, header (JSON), then the sections it lists: documents
(ids, NULL marks, lengths), the block directory of every plane, and the blocks.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from paneltide.llm.common import arrow_session, cut_lineage, fresh_path, text_of
from paneltide.llm.tokens import default_tokenizer, encoder

MAGIC = b"WVLTSHD1"
END_ID = 2
#: Bits of a plane in one compressed block.
BLOCK_BITS = 1 << 16
#: Ids after which a task begins its next shard; bounds its memory (about 30 bytes an id).
SHARD_TOKENS = 1 << 22


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard: ids of its documents, one after another."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1).compress
    blocks: list[bytes] = []
    directory, zeros = [], []
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for bit in reversed(range(bits)):
        ones = (now & now.dtype.type(1 << bit)).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        counts = [int(np.count_nonzero(ones[a : a + BLOCK_BITS])) for a in range(0, len(ones), BLOCK_BITS)]
        zeros.append(len(ones) - sum(counts))
        before = 0
        for i, count in enumerate(counts):
            block = press(packed[i * BLOCK_BITS // 8 : (i + 1) * BLOCK_BITS // 8].tobytes())
            directory.append((len(block), before))
            blocks.append(block)
            before += count
        if bit:
            now = np.concatenate((now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))))
    table = np.array(directory, dtype="<u8").reshape(-1, 2).tobytes()
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    docs = press(names.tobytes() + nulls.tobytes() + np.array(lengths, dtype="<u8").tobytes())
    header = {
        "tokens": len(ids), "bits": bits, "block_bits": BLOCK_BITS, "zeros": zeros, "documents": len(doc_ids),
        "documents_bytes": len(docs), "directory_bytes": len(table),
    }
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, docs, table, *blocks])


class WaveletShard:
    """A shard file, read through ``read(offset, size)``; keeps a few blocks in memory."""

    def __init__(self, read: Callable[[int, int], bytes]):
        start = read(0, 16)
        if start[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(start[8:], "little")
        h = json.loads(read(16, size))
        self.n, self.bits, self.block_bits, self.zeros = h["tokens"], h["bits"], h["block_bits"], h["zeros"]
        at = 16 + size
        raw = zstandard.ZstdDecompressor().decompress(read(at, h["documents_bytes"]))
        d = h["documents"]
        names, nulls = np.frombuffer(raw, "<i8", d), np.frombuffer(raw, np.uint8, d, 8 * d)
        self.doc_ids = [None if z else int(x) for x, z in zip(names, nulls)]
        self.lengths = np.frombuffer(raw, "<u8", d, 9 * d).astype(np.int64)
        at += h["documents_bytes"]
        table = np.frombuffer(read(at, h["directory_bytes"]), "<u8").reshape(-1, 2).astype(np.int64)
        self.per_plane = len(table) // self.bits
        self.sizes, self.before = table[:, 0], table[:, 1]
        self.offsets = at + h["directory_bytes"] + np.concatenate(([0], np.cumsum(self.sizes)))
        self.read = read
        self.block = functools.lru_cache(maxsize=64)(self._block)

    def _block(self, plane: int, i: int) -> np.ndarray:
        k = plane * self.per_plane + i
        raw = zstandard.ZstdDecompressor().decompress(self.read(int(self.offsets[k]), int(self.sizes[k])))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return bits[: self.n - i * self.block_bits]

    def _ones(self, plane: int, position: int) -> int:
        """Ones of a plane before a position."""
        i, rest = divmod(position, self.block_bits)
        if i == self.per_plane:
            return self.n - self.zeros[plane]
        before = int(self.before[plane * self.per_plane + i])
        return before + (int(np.count_nonzero(self.block(plane, i)[:rest])) if rest else 0)

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        first = plane * self.per_plane
        ones = self.before[first : first + self.per_plane]
        before = ones if bit else np.arange(self.per_plane) * self.block_bits - ones
        i = int(np.searchsorted(before, k, side="right")) - 1
        return i * self.block_bits + int(np.flatnonzero(self.block(plane, i) == bit)[k - int(before[i])])

    def access(self, position: int) -> int:
        if not 0 <= position < self.n:
            raise IndexError(position)
        value = 0
        for plane in range(self.bits):
            i, rest = divmod(position, self.block_bits)
            ones = self._ones(plane, position)
            bit = int(self.block(plane, i)[rest])
            value = value << 1 | bit
            position = self.zeros[plane] + ones if bit else position - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Below the last plane: where the token's run begins, and its length up to ``end``."""
        low, high = 0, max(0, min(end, self.n))
        if token < 0 or token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._ones(plane, low), self._ones(plane, high)
            if token >> (self.bits - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return low, high - low

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before position ``end`` (all of the shard if None)."""
        return self._range(token, self.n if end is None else end)[1]

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        low, count = self._range(token, self.n)
        if not 0 <= k < count:
            raise IndexError(k)
        position = low + k
        for plane in reversed(range(self.bits)):
            if token >> (self.bits - 1 - plane) & 1:
                position = self._place(plane, 1, position - self.zeros[plane])
            else:
                position = self._place(plane, 0, position)
        return position

    def tokens(self) -> np.ndarray:
        """All ids, restored plane by plane from the lowest."""
        now = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        inflate = zstandard.ZstdDecompressor().decompress
        for plane in reversed(range(self.bits)):
            k = plane * self.per_plane
            whole = self.read(int(self.offsets[k]), int(self.offsets[k + self.per_plane] - self.offsets[k]))
            cuts = self.offsets[k : k + self.per_plane + 1] - self.offsets[k]
            raw = b"".join(inflate(whole[a:b]) for a, b in zip(cuts[:-1], cuts[1:]))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~ones)] = now[: self.zeros[plane]]
            above[np.flatnonzero(ones)] = now[self.zeros[plane] :] | now.dtype.type(1 << (self.bits - 1 - plane))
            now = above
        return now


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI of the shared folder."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def open_shard(path: str) -> WaveletShard:
    system, name = _open(path)
    handle = system.open_input_file(name)
    return WaveletShard(lambda offset, size: handle.read_at(size, offset))


def _writer(folder: str, tokenizer: str, end_id: int, shard_tokens: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(tokenizer).encode, TaskContext.get()
        part, number = context.partitionId(), 0
        system, base = _open(folder)
        doc_ids, raw, held = [], [], 0

        def write() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raw), "<u4")
            content = encode_shard(ids, doc_ids, [len(r) // 4 for r in raw])
            name = f"part-{part:06d}-{number:06d}.wavelet"
            # Readers only see whole files: a retried task replaces its own file by the same.
            temporary = f"{base}/.{name}.{context.taskAttemptId()}"
            with system.open_output_stream(temporary) as out:
                out.write(content)
            system.move(temporary, f"{base}/{name}")
            row = [part, number, f"{folder}/{name}", len(ids), len(doc_ids), len(content)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], list(MANIFEST))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw.append(encode(text.as_py()) + end)
                doc_ids.append(doc_id)
                held += len(raw[-1]) // 4
                if held >= shard_tokens:
                    yield write()
                    number += 1
                    doc_ids, raw, held = [], [], 0
        if doc_ids:
            yield write()

    return run


#: Columns of the manifest, one row per file.
MANIFEST = {"part": "long", "number": "long", "path": "string", "tokens": "long", "documents": "long", "bytes": "long"}


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents in ascending id order; the manifest, with ``base``, the ids before a file.

    The rows are range-partitioned by id (a hash of the text spreads a repeated id) and
    each task writes its range as one or more files below the shared folder.  NULL texts
    are empty and have their end id only; NULL ids come first; rows that repeat an id
    stand next to each other in the order of the texts' hashes; an empty table writes
    nothing and gives an empty manifest.
    """
    spark = arrow_session(docs.sparkSession)
    folder = (folder or fresh_path(spark, "wavelet")).rstrip("/")
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{k} {v}" for k, v in MANIFEST.items())
    run = _writer(folder, tokenizer or default_tokenizer(), end_id, shard_tokens)
    manifest = cut_lineage(sorted_rows.mapInArrow(run, schema))
    # One row per file: this window orders file names, not documents.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard = open_shard(path)
            raw = memoryview(shard.tokens().astype("<u4")).cast("B")
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            columns = [shard.doc_ids, starts + base, shard.lengths, crc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    files = manifest.select("path", "base")
    # Files are dealt out one by one; a task has one of them in memory.
    spread = files.repartition(max(1, files.count()), "path")
    return spread.mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
