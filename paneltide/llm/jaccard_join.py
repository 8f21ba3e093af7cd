"""Exact Jaccard join of documents as a metric-space join (operator 1).

Jaccard distance is a metric on shingle sets; documents link within ``1 - threshold``.
Equal sets are one point.  Two levels of pivots are used:

* Level 1.  Documents as pivots would not divide unrelated texts, which are all at
  distance 1 from each other, so the pivots are the single-shingle sets {s}, put in one
  order that all tasks share (frequent shingles last, else by hash).  A document's cell is
  that of its first shingle.  The window of a document are the pivots whose cells can hold
  a point within the distance: its first ``n - ceil(threshold*n) + 1`` shingles, because
  two sets that agree in ``ceil(threshold*n)`` shingles cannot both miss all of the other's
  window.  A document is replicated to the regions of its window and nowhere else.  This is
  a prefix filter.
* Level 2.  A region of few documents compares those pairs that sizes and the number of
  common pivots in their windows allow.  A larger one is joined in a loop over document pivots, without regions of
  their own: all members are
  measured against a pivot; those in its ball are connected through it, and only members
  that are not yet connected, and whose distances to the region's first pivot differ by no
  more than the join distance (triangle inequality), go on to the next pivots.  Before a
  pair with these is measured, bit parities of both sets bound their distance from below.

Components need no pair inside a ball, so a group of near copies costs its size, not its
square.  All measured distances are exact set intersections; nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paneltide.llm.common import arrow_session, cut_lineage, free_name, free_worker_state, text_of, written
from paneltide.llm.shingles import shingle_sets

#: Least similarity of a link, in hundredths.
PERCENT = 75
#: Members of a region that are compared pair by pair; larger regions use document pivots.
#: Also what makes a shingle frequent.  Results do not depend on it.
FEW = 32
#: Bits of the table of frequent shingles (its size is fixed: 512 KB).  A shingle that only
#: shares a bit with a frequent one also goes last, in all tasks alike.
TABLE_BITS = 22
#: Growth of the number of pivots of a region from one round to the next.
MORE_PIVOTS = 64
#: 64-bit words of a set's parity sketch.
SKETCH_WORDS = 8
#: Tables of the loops are written plainly, so that the planner broadcasts none whose file is only small by compression.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def _window(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _bits(table: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").view(bool)


def _bit_table(longs: DataFrame) -> bytes | None:
    """Bits of the leading ``TABLE_BITS`` bits of the values of a one-column table; None if empty."""
    bucket = F.shiftrightunsigned(longs.columns[0], 64 - TABLE_BITS).alias("bucket")
    # At most 2**TABLE_BITS numbers, packed into at most 2**(TABLE_BITS - 6) words before they leave.
    words = longs.select(bucket).distinct().groupBy(F.shiftright("bucket", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bucket & 63 AS INT))")).alias("bits")
    )
    got = words.collect()
    if not got:
        return None
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    table[[r["word"] for r in got]] = [r["bits"] for r in got]
    return table.astype("<i8").tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in arrays]))), pa.int32())
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def _sign(own: np.ndarray) -> bytes | None:
    """Signature of a set: 128 bits, so different sets do not meet."""
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of ``64 * SKETCH_WORDS`` buckets, as 64-bit words.

    Bits that differ between two sets come from different shingles that only one of them
    has, so their number is at most the size of the symmetric difference.
    """
    bits = np.bincount((own & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _windows(percent: int, table: bytes | None):
    """Arrow function over (id, text hash, text): size, signature, sketch, window keys and where the window ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_state()
        bits = None if table is None else _bits(table)
        for batch in batches:
            sizes, signs, sketches, keys, last = [], [], [], [], []
            for own in shingle_sets(batch.column(2).to_pylist()):
                n = len(own)
                sizes.append(n)
                signs.append(_sign(own))
                sketches.append(_sketch(own))
                late = False
                if n:
                    if bits is not None:
                        frequent = bits[own >> np.uint64(64 - TABLE_BITS)]
                        rare = own[~frequent]
                        late = len(rare) < _window(n, percent)
                        own = np.concatenate((rare, own[frequent]))
                    own = own[: _window(n, percent)]
                keys.append(own.view(np.int64))
                # The order as one number (two hash bits are lost; equal numbers decide nothing).
                last.append((int(own[-1]) >> 2) + (late << 62) if n else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), _lists(sketches),
                 _lists(keys), pa.array(last, pa.int64())],
                ["doc_id", "text_hash", "n", "sign", "sketch", "keys", "last"],
            )

    return run


def _whole_sets(table: bytes | None):
    """Arrow function over (text hash, text): signature and whole set of the texts in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_state()
        bits = None if table is None else _bits(table)
        for batch in batches:
            if bits is not None:
                hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                batch = batch.filter(pa.array(bits[hashes >> np.uint64(64 - TABLE_BITS)]))
            own = list(shingle_sets(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_sign(x) for x in own], pa.binary()), _lists([x.view(np.int64) for x in own])], ["sign", "members"]
            )

    return run


def frequent_table(windows: DataFrame, few: int = FEW) -> bytes | None:
    """Bit table of shingles that more than ``few`` windows hold; None if there are none."""
    keys = windows.select(F.explode("keys").alias("key"))
    often = keys.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > few)
    return _bit_table(often.select("key"))


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """Least number of common shingles of a link."""
    return F.ceil((na + nb) * percent / F.lit(100.0 + percent) - 1e-9)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Can two members of a region link, if this region is the first they share?"""
    na, nb, pa_, pb = (F.col(f"{x}.{c}") for c in ("n", "at") for x in (a, b))
    return F.least(na - pa_, nb - pb) >= _needed(na, nb, percent)


def _alike(a: str, b: str, percent: int) -> Column:
    """Do the sketches of two members leave room for a link?"""
    differ = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return differ <= both - 2 * _needed(F.col(f"{a}.n"), F.col(f"{b}.n"), percent)


class JaccardJoin:
    """State of one join: points (distinct sets), and where their texts are."""

    def __init__(self, docs: DataFrame, percent: int, few: int, id_col: str, text_col: str):
        self.spark: SparkSession = arrow_session(docs.sparkSession)
        self.percent, self.few = percent, few
        self.rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
        self.hashed = self.rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        kind = docs.schema[id_col].dataType.simpleString()
        schema = f"doc_id {kind}, text_hash long, n long, sign binary, sketch array<long>, keys array<long>, last long"
        plain = self.hashed.mapInArrow(_windows(percent, None), schema)
        table = frequent_table(plain, few)
        windows = self.hashed.mapInArrow(_windows(percent, table), schema)
        #: One row per document.  The windows are hashed anew below rather than kept twice.
        self.documents = cut_lineage(plain.select("doc_id", "text_hash", "n", "sign"))
        points = windows.where("n > 0").groupBy("sign").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"),
            *[F.any_value(c).alias(c) for c in ("n", "last", "sketch", "keys")],
        )
        #: One row per distinct set; ``node`` is its number, fixed by the checkpoint.
        self.points = cut_lineage(
            points.select(
                F.monotonically_increasing_id().alias("node"), "sign", "first.doc_id", "first.text_hash", "n", "last", "sketch", "keys"
            )
        )

    def regions(self) -> DataFrame:
        """``key, node, n, at, c``: members of all regions with two members or more."""
        entries = self.points.select("node", "n", F.posexplode("keys").alias("at", "key"))
        # Counts are combined before the shuffle; the join splits a hot region by itself.
        shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        return cut_lineage(entries.join(shared, "key"))

    def small_pairs(self, regions: DataFrame) -> DataFrame:
        """Pairs that share a region of few members and may link.

        All common keys of a pair in such regions are counted.  Beyond the window that ends
        first, no more shingles can be common than that document has left; keys in larger
        regions may all be common.
        """
        small = regions.where(F.col("c") <= self.few)
        a, b = small.alias("a"), small.alias("b")
        alike = 100 * F.least("a.n", "b.n") >= self.percent * F.greatest("a.n", "b.n")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & alike)
        counted = met.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.count("*").alias("met"))
        large = regions.where(F.col("c") > self.few).groupBy("node").agg(F.count("*").alias("large"))
        about = self.points.select("node", "n", "last", F.size("keys").alias("w")).join(large, "node", "left").select(
            "node", "n", "last", (F.col("n") - F.col("w")).alias("left"), F.coalesce("large", F.lit(0)).alias("large")
        )

        def side(name: str) -> DataFrame:
            return about.select(*[F.col(c).alias(name if c == "node" else f"{c}_{name}") for c in about.columns])

        pairs = counted.join(side("a"), "a").join(side("b"), "b")
        rest = (
            F.when(F.col("last_a") < F.col("last_b"), F.col("left_a")).when(F.col("last_a") > F.col("last_b"), F.col("left_b"))
            .otherwise(F.greatest("left_a", "left_b"))
        )
        most = F.col("met") + F.least("large_a", "large_b") + rest
        return pairs.where(most >= _needed(F.col("n_a"), F.col("n_b"), self.percent)).select("a", "b")

    def measure(self, pairs: DataFrame) -> DataFrame:
        """``a, b, common, union``: exact intersection of each pair; checkpointed.

        Only texts that the pairs ask for are hashed again; a table of bits of fixed size
        finds them (others that share a bit are dropped by the join).
        """
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = self.points.join(nodes, "node", "left_semi").select("text_hash")
        sets = (
            self.hashed.select("text_hash", "text").mapInArrow(_whole_sets(_bit_table(wanted)), "sign binary, members array<long>")
            .groupBy("sign").agg(F.any_value("members").alias("members"))
        )
        signs = self.points.select("node", "sign")
        named = pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b")
        both = named.join(sets.toDF("sign_b", "of_b"), "sign_b").join(sets.toDF("sign_a", "of_a"), "sign_a")
        common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
        sized = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b") - common).alias("union"))
        return cut_lineage(sized)

    def linked(self, measured: DataFrame) -> DataFrame:
        return measured.where(100 * F.col("common") >= self.percent * F.col("union")).select("a", "b")

    def components(self) -> DataFrame:
        """``node, label`` of all points that link with another; equal labels are connected."""
        regions = self.regions()
        pairs = self.small_pairs(regions)
        large = distinct_regions(regions.where(F.col("c") > self.few)).join(self.points.select("node", "sketch"), "node").withColumns(
            {"first": F.lit(None).cast("long"), "d": F.lit(None).cast("double")}
        )
        links: DataFrame | None = None
        labels: DataFrame | None = None
        pivots = 1
        while True:
            known = large if labels is None else large.join(labels, "node", "left")
            label = F.col("node") if labels is None else F.coalesce("label", "node")
            marked = known.withColumn("group", label)
            open_ = marked.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
            # What a round hands to the next is written: the sizes guessed for checkpoints multiply in
            # the rounds' joins, to numbers whose digits fill the driver.
            members = written(marked.join(open_, "key", "left_semi").drop("label"), "members", **PLAIN)
            if labels is not None and members.isEmpty():
                return labels
            more, large = self._by_pivots(members, pivots)
            asked = more if labels is not None else pairs.unionByName(more)
            measured = self.measure(cut_lineage(asked.distinct()))
            found = self.linked(measured)
            links = written(thinned(found if links is None else links.unionByName(found)), "links", **PLAIN)
            labels = connect(links)
            large = self._with_distance(large, measured)
            pivots *= MORE_PIVOTS

    def _by_pivots(self, members: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
        """Pairs of the next pivots of each region with its members, and the members left."""
        order = Window.partitionBy("key").orderBy("node")
        # A rank limit is applied by every task before the shuffle.  Written once, so that the
        # join below can split a hot region among tasks.
        chosen = cut_lineage(members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots))
        last = chosen.groupBy("key").agg(F.max("node").alias("last"), F.min("node").alias("pivot"))
        p, m = chosen.drop("rank").alias("p"), members.alias("m")
        near = F.coalesce(F.abs(F.col("p.d") - F.col("m.d")) <= 1 - self.percent / 100 + 1e-9, F.lit(True))
        allowed = (
            (F.col("p.key") == F.col("m.key")) & (F.col("p.node") < F.col("m.node")) & (F.col("p.group") != F.col("m.group"))
            & ~F.coalesce(F.col("p.before") == F.col("m.before"), F.lit(False)) & near & _may_link("p", "m", self.percent)
        )
        if pivots > 1:
            # The distances to the first pivot are all measured: later rounds divide by them.
            allowed = allowed & _alike("p", "m", self.percent)
        pairs = p.join(m, allowed).select(F.col("p.node").alias("a"), F.col("m.node").alias("b"))
        left = members.join(last, "key").where(F.col("node") > F.col("last"))
        first = F.coalesce("first", "pivot").alias("first")
        return pairs, left.select("key", "node", "n", "at", "before", "sketch", first, "d")

    def _with_distance(self, large: DataFrame, measured: DataFrame) -> DataFrame:
        """Members with their distance to the region's first pivot, once it was measured."""
        d = (1 - F.col("common") / F.col("union")).alias("measured_d")
        known = measured.select(F.col("a").alias("first"), F.col("b").alias("node"), d)
        joined = large.join(known, ["first", "node"], "left")
        return joined.withColumn("d", F.coalesce("d", "measured_d")).drop("measured_d")


def distinct_regions(large: DataFrame) -> DataFrame:
    """``key, node, n, at, before``: large regions that hold a pair no other large region holds.

    ``before`` is the member's preceding key among large regions.  Members with the same one
    meet there already, so a region need not join them, and one whose members all have the
    same lies within that region and is left out.
    """
    before = F.lag("key").over(Window.partitionBy("node").orderBy("at"))
    entries = cut_lineage(large.select("key", "node", "n", "at", before.alias("before")))
    own = entries.groupBy("key").agg(F.min("before").alias("low"), F.max("before").alias("high"), F.count_if(F.col("before").isNull()).alias("first"))
    return entries.join(own.where("first > 0 OR low < high").select("key"), "key", "left_semi")


def thinned(links: DataFrame) -> DataFrame:
    """``a, b``: fewer links that connect the same nodes.

    A node ``b`` that links with several ``a`` keeps the smallest; the others are linked
    with that one instead, which many ``b`` have in common.
    """
    low = F.min("a").over(Window.partitionBy("b")).alias("low")
    ends = links.select("a", "b", low)
    kept = F.array(F.struct(F.col("low").alias("a"), "b"), F.struct(F.col("low").alias("a"), F.col("a").alias("b")))
    return ends.select(F.inline(kept)).where("a < b").distinct()


def connect(links: DataFrame) -> DataFrame:
    """``node, label``: connected components of a kept table of links, the label being the smallest node.

    Every round takes the smallest label among neighbours and then that label's own label,
    so chains halve; rounds end when nothing changes.
    """
    edges = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", **PLAIN)
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("further"))
        new = written(
            lower.join(jump, "lower").select("node", F.least("lower", "further").alias("label"), (F.least("lower", "further") < F.col("label")).alias("changed")),
            "labels", **PLAIN,
        )
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels


def _groups(docs: DataFrame, percent: int, few: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, hash of its text, size, smallest (no id, id, text hash) of its component."""
    join = JaccardJoin(docs, percent, few, id_col, text_col)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("first")
    points = join.points.select("node", "sign", first).join(join.components(), "node", "left")
    smallest = points.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("least"))
    groups = points.join(smallest, "label", "left").select("sign", F.coalesce("least", "first").alias("least"))
    return join.documents.drop("keys").join(groups, "sign", "left")


def jaccard_components(
    docs: DataFrame, percent: int = PERCENT, few: int = FEW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    ``component_id`` is the smallest id that links reach, NULL ids not counted (a component
    of NULL ids has none).  A row without words links with nothing and is its own component.
    Rows that repeat an id are documents of their own; an empty table gives no rows; further
    columns are ignored.
    """
    groups = _groups(docs, percent, few, id_col, text_col)
    return groups.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, few: int = FEW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, with the columns of ``docs``.

    NULL ids come last.  Rows without words all stay; rows that repeat both id and text are
    the same document and stay or go together.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    lost = _groups(docs, percent, few, id_col, text_col).where((F.col("n") > 0) & (F.col("least") != own))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).distinct()
    hashed = free_name(docs, "text_hash_")
    rows = docs.withColumn(hashed, F.xxhash64(text_of(F.col(text_col))))
    same = rows[id_col].eqNullSafe(lost["lost_id"]) & (rows[hashed] == lost["lost_hash"])
    return rows.join(lost, same, "left_anti").select(*docs.columns)
