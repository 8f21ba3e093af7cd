"""Filter interaction audit by a stream with retractions (operator 11).

Five filters fail a document or not; four look at its text alone, the fifth (E) at all texts:
a document fails it if a smaller id has the identical text.  The table's files are processed
as available-now micro-batches.  A batch becomes one narrow row per document, then one row
per task and text; a keyed state holds each text's smallest id so far and which documents
have it.  Documents are counted under their mask of failed filters at once; when a smaller id
arrives later, the state retracts the earlier holders' count and adds it to the mask with E.
Only the changes of counters leave a batch, and their sums give every report:
120 orders of the filters need no further look at the documents.

A text that a third of the rows share costs one row per task and batch, and its state has one
entry per language and label.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paneltide.llm.common import arrow_session, fresh_path, slices
from paneltide.streaming.runner import keep_state_on_disk, stream_table

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in itertools.permutations(FILTERS)]
#: Bit of the filter that compares texts.
TWICE = 1 << FILTERS.index("E")
#: Micro-batches the files are divided into.
BATCHES = 4
#: Texts that share one entry of the state store (their number grows with the rows).
TEXTS_A_GROUP = 64
#: Texts per state partition beyond which state moves from memory to disk.  A store on disk
#: takes some MB of files for each partition, however little it holds.
TEXTS_IN_MEMORY = 50_000
#: Texts a task combines before it hands them on.
HELD = 50_000
#: Bytes of text worked on at once.
PIECE = 1 << 24

_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # white space of bytes is ASCII white space
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), symbols > 0)
    return sum(1 << i for i, x in enumerate(failed) if x)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, text) to one row per id, part and text of a batch: digest, mask and number."""
    for whole in batches:
        for batch in slices(whole, "text", PIECE):
            counts: dict[tuple, int] = {}
            for doc_id, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text"))):
                text = text or ""
                key = doc_id, part or "", hashlib.sha256(text.encode()).hexdigest(), text_mask(text)
                counts[key] = counts.get(key, 0) + 1
            columns = list(zip(*counts)) if counts else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field("doc_id").type), *[pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.string(), pa.int32()))],
                 pa.array(list(counts.values()), pa.int64())],
                ["doc_id", "part", "digest", "mask", "n"],
            )


def _combined(groups: int):
    """Arrow function over labelled rows: one row per text, its documents with the least id apart."""

    def flush(held: dict) -> pa.RecordBatch:
        rows = [(int(d[:12], 16) % groups, d, m, least, json.dumps([[*k, n] for k, n in at.items()]), json.dumps([[*k, n] for k, n in later.items()]))
                for d, (m, least, at, later) in held.items()]
        columns = list(zip(*rows))
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["grp", "digest", "mask", "least", "at_least", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for doc_id, part, digest, mask, n, code in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "digest", "mask", "n", "code"))):
                entry = held.setdefault(digest, [mask, None, {}, {}])
                _meet(entry, doc_id, {(part, code): n})
            if len(held) > HELD:
                yield flush(held)
                held.clear()
        if held:
            yield flush(held)

    return run


def _add(to: dict, counts: dict) -> None:
    for k, n in counts.items():
        to[k] = to.get(k, 0) + n


def _meet(entry: list, doc_id: int | None, counts: dict) -> None:
    """Adds documents of one id to (mask, least id, documents with it, documents with larger ids)."""
    if doc_id is None or (entry[1] is not None and doc_id > entry[1]):
        # A document without id comes neither before nor after another.
        _add(entry[3], {(p, c, doc_id is None): n for (p, c), n in counts.items()})
    elif doc_id == entry[1]:
        _add(entry[2], counts)
    else:
        _add(entry[3], {(p, c, False): n for (p, c), n in entry[2].items()})
        entry[1], entry[2] = doc_id, dict(counts)


def _keep_least(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New rows of a group of texts: changes of the counters.

    The state lists, per text, the least id and the documents that have it.
    """
    known: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    changes: dict[tuple, int] = {}

    def change(mask: int, counts: dict, sign: int = 1) -> None:
        _add(changes, {(p, c, mask): sign * n for (p, c), n in counts.items()})

    for frame in frames:
        for digest, mask, least, at_least, later in zip(frame.digest, frame["mask"], frame.least, frame.at_least, frame.later):
            mask = int(mask)
            for part, code, no_id, n in json.loads(later):
                change(mask if no_id else mask | TWICE, {(part, code): n})
            if pd.isna(least):
                continue
            least, new = int(least), {(p, c): n for p, c, n in json.loads(at_least)}
            if digest not in known or least < known[digest][0]:
                if digest in known:
                    earlier = {(p, c): n for p, c, n in known[digest][1]}
                    change(mask, earlier, -1)
                    change(mask | TWICE, earlier)
                change(mask, new)
                known[digest] = [least, [[*k, n] for k, n in new.items()]]
            elif least == known[digest][0]:
                held = {(p, c): n for p, c, n in known[digest][1]}
                _add(held, new)
                change(mask, new)
                known[digest][1] = [[*k, n] for k, n in held.items()]
            else:
                change(mask | TWICE, new)
    state.update((json.dumps(known),))
    rows = [(p, c, m, n) for (p, c, m), n in changes.items() if n]
    yield pd.DataFrame(rows, columns=["part", "code", "mask", "n"]).astype({"code": "int32", "mask": "int32", "n": "int64"})


def mask_counts(
    spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """``part, code, mask, n``: documents per part, labels and failed filters, from a Parquet table's files.

    ``code`` has 1 for good and 2 for toxic documents, ``mask`` bit i for filter i.
    """
    arrow_session(spark)
    table = spark.read.parquet(path)
    files, rows_in = len(table.inputFiles()), table.count()
    groups = rows_in // TEXTS_A_GROUP + 1
    if rows_in > TEXTS_IN_MEMORY * int(spark.conf.get("spark.sql.shuffle.partitions")):
        keep_state_on_disk(spark)
    stream = stream_table(spark, path, table.schema, max(1, -(-files // batches)))
    rows = stream.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(part_col).cast("string").alias("part"), F.col(text_col).cast("string").alias("text")
    )
    narrow = rows.mapInArrow(_documents, "doc_id long, part string, digest string, mask int, n long")
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of_doc")).agg(
        (flag("quality", 1) + flag("toxic", 2)).alias("code")
    )
    # Rows without id meet no label; the second key keeps them from sharing a partition.
    spread = F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise("")
    on = (F.col("doc_id") == F.col("of_doc")) & (F.col("spread") == F.col("no_spread"))
    labelled = narrow.withColumn("spread", spread).join(known.withColumn("no_spread", F.lit("")), on, "left").select(
        "doc_id", "part", "digest", "mask", "n", F.coalesce("code", F.lit(0)).alias("code")
    )
    combined = labelled.mapInArrow(_combined(groups), "grp long, digest string, mask int, least long, at_least string, later string")
    changes = combined.groupBy("grp").applyInPandasWithState(
        _keep_least, "part string, code int, mask int, n long", "texts string", "update", GroupStateTimeout.NoTimeout
    )
    root = fresh_path(spark, "audit")

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is replayed overwrites its own folder.
        batch.groupBy("part", "code", "mask").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    (
        changes.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write)
        .trigger(availableNow=True).start().awaitTermination()
    )
    schema = "part string, code int, mask int, n long"
    empty = spark.createDataFrame([], schema)
    seen = empty if not files else spark.read.schema(f"{schema}, batch long").parquet(f"{root}/changes").drop("batch")
    return seen.groupBy("part", "code", "mask").agg(F.sum("n").alias("n")).where("n <> 0")


def report(counts: DataFrame) -> DataFrame:
    """What each filter removes at each step of every order, from counts per mask."""
    plan = [(order, step + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[:step])) for order in ORDERS for step, f in enumerate(order)]
    # A fixed list of 600 (order, step) in place: counters are at most 128 per part.
    steps = F.from_json(
        F.lit(json.dumps([dict(zip(("filter_order", "step", "own", "before"), x)) for x in plan])),
        "array<struct<filter_order:string,step:int,own:int,before:int>>",
    )
    each = counts.select("part", "code", "mask", "n", F.inline(steps))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier

    def total(when: Column, value: Column = F.col("n")) -> Column:
        return F.sum(F.when(when, value).otherwise(F.lit(0))).cast("long")

    # Of all orders, a filter comes before the other failing ones in an equal share.
    share = F.floor(F.col("n") * len(ORDERS) / F.greatest(F.bit_count("mask"), F.lit(1)))
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(removed & (F.col("code").bitwiseAND(1) != 0)).alias("good_lost"),
        total(removed & (F.col("code").bitwiseAND(2) != 0)).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per part, order of the five filters and step; zeros included.

    NULL texts count as empty and NULL languages as the part ``''``; ids that repeat are
    documents of their own; a NULL id is neither smaller nor larger than another, so it never
    fails E; a document with several labels is good or toxic if one of them says so.  Further
    columns are ignored; a table without rows gives none.
    """
    return report(mask_counts(spark, path, labels, batches))


#: The same by SQL over ``documents`` and ``labels``.
ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
    FROM documents
), label AS (
    SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, list_filter([
        CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
        CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) THEN 'C' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN least < doc_id THEN 'E' END
    ], lambda x: x IS NOT NULL) AS f
    FROM words LEFT JOIN label AS l USING (doc_id)
), masks AS (
    SELECT part, f, count(*) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM failed GROUP BY part, f
), orders AS (
    SELECT '' AS o UNION ALL SELECT o || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(o, x)
), steps AS (
    SELECT o AS filter_order, CAST(s AS INT) AS step, substr(o, s, 1) AS own, string_split(substr(o, 1, s - 1), '') AS before
    FROM orders, unnest([1, 2, 3, 4, 5]) AS u(s) WHERE length(o) = 5
), each AS (
    SELECT part, n, good, toxic, f, filter_order, step, own, list_contains(f, own) AS fails, list_has_any(f, before) AS earlier FROM masks, steps
)
SELECT part, filter_order, step,
       CAST(sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN f = [own] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN fails THEN n * 120 // len(f) ELSE 0 END) AS BIGINT) AS shapley
FROM each GROUP BY part, filter_order, step
"""
