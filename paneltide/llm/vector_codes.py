"""Vector code compression by product quantization in exact integers (operator 13).

Components become integers, vectors are cut into equal parts, and every part position gets
a small codebook refined in rounds.  The points of a part position are sorted along a Hilbert
curve and stored in flat blocks, each with the box (smallest and largest component) and the
sum of its points.  A round never looks at all entries for all points: for a block, an entry
whose least distance to the box exceeds another entry's largest distance to it is nearest to
no point of the block.  A block left with one entry adds its stored sum; the others run a
small integer kernel over the entries left.  Ties go to the lower index, as all entries that
can tie stay listed.

Per round the tasks send sums of ``parts * entries`` entries, combined by Spark, and the next
codebooks travel with the function; both have the size of the codebooks, not of the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paneltide.llm.common import arrow_session, fresh_path

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Points of a block.
BLOCK_POINTS = 256
#: Blocks read at once by a task.
BLOCKS_AT_ONCE = 64
#: Bits of a Hilbert key.
KEY_BITS = 62


def hilbert_keys(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of each point on a Hilbert curve through the box from ``low`` to ``high``.

    Axes are rounded to as many bits as fit a key; beyond ``KEY_BITS`` axes, the first count.
    The curve only orders points for storage, so rounding changes no result.
    """
    axes = min(points.shape[1], KEY_BITS)
    keys = np.zeros(len(points), dtype=np.int64)
    if not axes:
        return keys
    bits = min(16, KEY_BITS // axes)
    span = np.maximum(high[:axes] - low[:axes], 1).astype(np.float64)
    x = np.clip((points[:, :axes] - low[:axes]) / span * ((1 << bits) - 1), 0, (1 << bits) - 1).astype(np.int64)
    # From axes to the curve's transposed index: undo the rotations from the highest bit down.
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(axes):
            inverted = (x[:, i] & q) != 0
            swapped = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(inverted, q - 1, swapped)
            x[:, i] ^= swapped
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[:, -1] & q, q - 1, 0)
    x ^= turn[:, None]
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            keys = keys << 1 | (x[:, i] >> b & 1)
    return keys


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width).astype(np.int64)


def _rows(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def _bounds(width: int):
    """Arrow function over (rid, ints): smallest and largest value of every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            m = _matrix(batch.column(1), width)
            if len(m):
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], ["at", "low", "high"])

    return run


def _cut(parts: int, width: int, low: np.ndarray, high: np.ndarray):
    """Arrow function over (rid, ints): one row per part with its Hilbert key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), parts * width)
            for part in range(parts):
                own = slice(part * width, (part + 1) * width)
                keys = hilbert_keys(m[:, own], low[own], high[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(m), part, np.int32)), pa.array(keys), batch.column(0), _rows(m[:, own])],
                    ["part", "key", "rid", "point"],
                )

    return run


def _blocks(width: int, size: int):
    """Arrow function over sorted (part, key, rid, point): flat blocks with box and sum."""

    def block(part: int, rids: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        one = lambda x: _rows(x.reshape(1, -1))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), one(points.min(0)), one(points.max(0)), one(points.sum(0)), one(rids), one(points)],
            ["part", "low", "high", "total", "rids", "flat"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rids, points = -1, np.empty(0, np.int64), np.empty((0, width), np.int64)
        for batch in batches:
            parts = batch.column(0).to_numpy()
            new_rids, new_points = batch.column(2).to_numpy(), _matrix(batch.column(3), width)
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for start, end in zip(edges[:-1], edges[1:]):
                if start == end:
                    continue
                if parts[start] != part:
                    if len(rids):
                        yield block(part, rids, points)
                    part, rids, points = int(parts[start]), rids[:0], points[:0]
                rids, points = np.concatenate((rids, new_rids[start:end])), np.concatenate((points, new_points[start:end]))
                while len(rids) >= size:
                    yield block(part, rids[:size], points[:size])
                    rids, points = rids[size:], points[size:]
        if len(rids):
            yield block(part, rids, points)

    return run


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Indexes of the entries that can be nearest, or tie, for a point of the box."""
    under, over = low - entries, entries - high
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(points: np.ndarray, entries: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry among those listed, and the squared distance."""
    distances = ((points[:, None, :] - entries[listed][None, :, :]) ** 2).sum(2)
    first = distances.argmin(1)
    return listed[first], distances[np.arange(len(points)), first]


def _each_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for batch in batches:
        part = batch.column("part").to_pylist()
        low, high, total = (_matrix(batch.column(c), width) for c in ("low", "high", "total"))
        for i in range(len(part)):
            rids = batch.column("rids")[i].values.to_numpy()
            yield part[i], low[i], high[i], total[i], rids, lambda b=batch, i=i: b.column("flat")[i].values.to_numpy().reshape(-1, width)


def _sums(books: np.ndarray):
    """Arrow function over blocks: per part and entry, number and sum of its points."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros(books.shape, np.int64)
        for part, low, high, total, rids, points in _each_block(batches, width):
            listed = shortlist(low, high, books[part])
            if len(listed) == 1:
                counts[part, listed[0]] += len(rids)
                sums[part, listed[0]] += total
                continue
            own = points()
            index, _ = nearest(own, books[part], listed)
            counts[part] += np.bincount(index, minlength=entries)
            np.add.at(sums[part], index, own)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), _rows(sums[part, entry])], ["part", "entry", "n", "total"]
            )

    return run


def _codes(books: np.ndarray):
    """Arrow function over blocks: entry and squared distance of every point."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, low, high, _, rids, points in _each_block(batches, width):
            index, error = nearest(points(), books[part], shortlist(low, high, books[part]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids), pa.array(np.full(len(rids), part, np.int32)), pa.array(index.astype(np.int32)), pa.array(error)],
                ["rid", "part", "entry", "error"],
            )

    return run


class VectorCodes:
    """Points in blocks and their codebooks (``books``: part, entry, component)."""

    def __init__(
        self, vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int, block_points: int, id_col: str, vector_col: str,
        label_col: str,
    ):
        self.spark = arrow_session(vectors.sparkSession)
        self.parts = parts
        vector = F.col(vector_col)
        bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
        usable = vectors.where(vector.isNotNull() & ~bad).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), ints.alias("ints"))
        order = [F.col("vec_id").asc_nulls_last(), "ints"]
        first = usable.orderBy(*order).limit(entries).collect()
        self.size = len(first[0].ints) if first else 0
        if self.size % parts:
            raise ValueError(f"vectors of {self.size} components cannot be cut into {parts} equal parts")
        usable = usable.where(F.size("ints") == self.size)
        if any(len(r.ints) != self.size for r in first):
            first = usable.orderBy(*order).limit(entries).collect()
        self.width = self.size // parts
        path = fresh_path(self.spark, "vectors")
        usable.withColumn("rid", F.monotonically_increasing_id()).write.parquet(path)
        #: One row per vector kept; ``rid`` is its number, fixed by the written table.
        self.points = self.spark.read.parquet(path)
        self.books = np.array([r.ints for r in first], dtype=np.int64).reshape(len(first), parts, self.width).transpose(1, 0, 2).copy()
        self.blocks: DataFrame | None = None
        if self.size:
            self._store(block_points)
            for _ in range(rounds):
                self.books = self._refined()

    def _store(self, block_points: int) -> None:
        narrow = self.points.select("rid", "ints")
        found = narrow.mapInArrow(_bounds(self.size), "at long, low long, high long").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        low, high = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for r in found:  # one row per component
            low[r["at"]], high[r["at"]] = r["low"], r["high"]
        reach = max(abs(int(low.min())), abs(int(high.max())))
        if (2 * reach) ** 2 * self.size >= 1 << 63:
            raise ValueError("components are too large for exact 64-bit distances")
        cut = narrow.mapInArrow(_cut(self.parts, self.width, low, high), "part int, key long, rid long, point array<long>")
        # The number of a vector divides keys that many equal points share.
        placed = cut.repartitionByRange("part", "key", "rid").sortWithinPartitions("part", "key", "rid")
        path = fresh_path(self.spark, "blocks")
        schema = "part int, low array<long>, high array<long>, total array<long>, rids array<long>, flat array<long>"
        placed.mapInArrow(_blocks(self.width, block_points), schema).write.parquet(path)
        self.blocks = self.spark.read.parquet(path)

    def _over_blocks(self, function: Callable, schema: str) -> DataFrame:
        return self.blocks.mapInArrow(function, schema)

    def _refined(self) -> np.ndarray:
        """Codebooks after one round; an entry without points stays."""
        sums = self._over_blocks(_sums(self.books), "part long, entry long, n long, total array<long>")
        each = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
        totals = each.groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        books = self.books.copy()
        for r in totals.collect():  # at most one row per component of the codebooks
            books[r["part"], r["entry"], r["at"]] = int(r["x"]) // r["n"]
        return books

    def digest(self) -> str:
        """SHA-256 of all final entries by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """``rid, code, error`` of every vector."""
        placed = self._over_blocks(_codes(self.books), "rid long, part int, entry int, error long")
        entry = [F.max(F.when(F.col("part") == p, F.col("entry"))).alias(f"e{p}") for p in range(self.parts)]
        code = F.concat(*[F.lpad(F.lower(F.hex(f"e{p}")), 2, "0") for p in range(self.parts)])
        return placed.groupBy("rid").agg(F.sum("error").alias("error"), *entry).select("rid", code.alias("code"), "error")


def encode_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    block_points: int = BLOCK_POINTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector kept.

    Vectors that are NULL or hold NULL, NaN or infinite components are dropped, as are those
    of another length than the one of the smallest id.  Rows that repeat an id are vectors of
    their own (of equal ids the smaller vector comes first); NULL ids come last and NULL
    labels are one label.  With fewer vectors than entries, the codebooks are that short.
    Further columns are ignored; an empty table gives no rows.  A length that ``parts`` does
    not divide, or components whose distances exceed 64 bits, raise ``ValueError``.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    state = VectorCodes(vectors, parts, entries, rounds, scale, block_points, id_col, vector_col, label_col)
    if not state.size:
        # No vector, or vectors without components: nothing differs from entry 0.
        coded = state.points.select("vec_id", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        # Written once: the rows are read for the labels' sums and for the result.
        path = fresh_path(state.spark, "codes")
        state.points.select("rid", "vec_id", "label").join(state.codes(), "rid").drop("rid").write.parquet(path)
        coded = state.spark.read.parquet(path)
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(state.digest()).alias("codebooks_sha256")
    )


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same over the table ``embeddings`` in SQL, all entries against all points."""
    steps = [
        f"""kept AS (
            SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""points AS MATERIALIZED (
            SELECT rid, p AS part, j AS pos, ints[p * len(ints) // {parts} + j + 1] AS x
            FROM kept, unnest(range({parts})) AS a(p), unnest(range(len(ints) // {parts})) AS b(j)
        )""",
        f"""starting AS (SELECT rid, row_number() OVER (ORDER BY vec_id, ints) - 1 AS entry FROM kept QUALIFY entry < {entries})""",
        "book0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM points JOIN starting USING (rid))",
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
            SELECT rid, part, min(d) AS d, arg_min(entry, d * {entries} + entry) AS entry
            FROM (SELECT rid, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM points JOIN book{i} USING (part, pos) GROUP BY ALL)
            GROUP BY rid, part
        )""")
        if i < rounds:
            steps.append(f"""book{i + 1} AS MATERIALIZED (
                SELECT b.part, b.entry, b.pos, coalesce(s.c, b.c) AS c FROM book{i} AS b LEFT JOIN (
                    SELECT part, entry, pos, CAST(floor((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) / count(*)) AS BIGINT) AS c
                    FROM points JOIN near{i} USING (rid, part) GROUP BY ALL
                ) AS s USING (part, entry, pos)
            )""")
    return f"""WITH {", ".join(steps)}, coded AS (
        SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY rid
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
    FROM kept JOIN coded USING (rid)"""
