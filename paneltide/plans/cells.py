"""User functions: per cell, per chunk, over history, switched, named."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.operators import run
from paneltide.operators.attribute import run_attribute
from paneltide.operators.ordered import time_slice
from paneltide.plans import panels as p
from paneltide.plans.registry import query

KEYS = ["full_name", "attribute_name", "clone_num", "tr_start", "tr_end"]

# The functions below are what a user would pass in.


def scaled(clone_num, time_range, value):
    """Whole hundreds of the value, shifted by the scenario."""
    return int(value // 100) * 10 + clone_num


def picky(clone_num, time_range, value):
    if value > 300:
        raise ValueError(f"too large: {value:.2f}")
    print(f"scenario {clone_num}")
    return int(value)


def half(pdf):
    return (pdf["amount"] * 100).round().astype("int64") // 2


def lines(text):
    yield from text.split("\n")


def decayed(state, row):
    """A fold that is not a plain sum: each step keeps a third of the past, in cents."""
    before = state
    return before // 3 + round(row["value"] * 100), before


def counted(state, row):
    before = state
    return before + 1, before


def summed(clone_num, time_range, inputs):
    """Cents of both inputs; at least one has to be there."""
    found = [v for v in (inputs or {}).values() if v is not None]
    if not found:
        raise ValueError("no input")
    return sum(round(v * 100) for v in found)


@query(
    "attribute_run",
    f"""WITH {p.EVENT_LATEST}, {p.EVENT_GRID},
    k AS (SELECT * FROM event_grid WHERE full_name = 'purchase'),
    j AS (
      SELECT k.clone_num, k.tr_start, k.tr_end, c.value AS c, v.value AS v, CAST(round(s.value * 100) AS BIGINT) AS stored,
             s.full_name IS NOT NULL AS has_stored
      FROM k
      LEFT JOIN event_latest c ON c.full_name = 'click' AND c.clone_num = k.clone_num AND c.tr_start = k.tr_start
      LEFT JOIN event_latest v ON v.full_name = 'view' AND v.clone_num = k.clone_num AND v.tr_start = k.tr_start
      LEFT JOIN event_latest s ON s.full_name = 'purchase' AND s.clone_num = k.clone_num AND s.tr_start = k.tr_start)
    SELECT clone_num, tr_start, clone_num = 0 AS lock_value,
      CAST(CASE WHEN clone_num = 0 THEN -stored WHEN c IS NULL AND v IS NULL THEN stored
           ELSE coalesce(CAST(round(c * 100) AS BIGINT), 0) + coalesce(CAST(round(v * 100) AS BIGINT), 0) END AS DOUBLE) AS value
    FROM j WHERE clone_num = 0 OR c IS NOT NULL OR v IS NOT NULL OR has_stored""",
)
def attribute_run(t):
    """Purchases from clicks and views: gathered, run, locked for scenario 0, restamped."""
    keys = p.event_grid(t).where("full_name = 'purchase'")
    deps = t.spark.createDataFrame(
        [("purchase", "data", k, "data") for k in ("click", "view")],
        "full_name string, attribute_name string, input_full_name string, input_attribute_name string",
    )
    latest = p.event_latest(t)
    old = latest.where("full_name = 'purchase'").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    stored = old.withColumn("lock_value", F.lit(False)).unionByName(
        old.where("clone_num = 0").withColumns({"value": -F.col("value"), "lock_value": F.lit(True)})
    )
    locks = keys.where("clone_num = 0").select("clone_num", "tr_start", "tr_end")
    blocks, _ = run_attribute(
        keys, deps, latest, stored, summed, T.LongType(), F.lit("2024-06-01").cast("timestamp"), locks=locks
    )
    return blocks.select("clone_num", "tr_start", F.col("value").cast("double").alias("value"), "lock_value")


@query(
    "map_cells",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, clone_num, tr_start, CAST(floor(value / 100) AS BIGINT) * 10 + clone_num AS value, FALSE AS failed,
           '' AS combined_output FROM order_latest""",
)
def map_cells(t):
    keys = p.order_latest(t).select(*KEYS, "value")
    out = run.map_cells(keys, scaled, T.LongType(), ["value"])
    return out.select("full_name", "clone_num", "tr_start", "value", "failed", "combined_output")


@query(
    "map_cells_vectorized",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, clone_num, tr_start, CAST(CAST(round(value * 100) AS BIGINT) // 2 AS BIGINT) AS result FROM order_latest""",
)
def map_cells_vectorized(t):
    keys = p.order_latest(t).select("full_name", "clone_num", "tr_start", F.col("value").alias("amount"))
    halved = run.map_cells_vectorized(keys, half, T.LongType())
    return halved.select("full_name", "clone_num", "tr_start", F.col("value").alias("result"))


@query(
    "captured",
    f"""WITH {p.EVENT_BLOCKS}
    SELECT event_id, CASE WHEN value > 300 THEN NULL ELSE trunc(value) END AS value, value > 300 AS failed,
           CASE WHEN value > 300 THEN '' ELSE 'scenario ' || clone_num END AS stdout_output,
           CASE WHEN value > 300 THEN 'ValueError: too large: ' || printf('%.2f', value) ELSE '' END AS last_error_line,
           CASE WHEN value > 300 THEN '[stderr]' ELSE '[stdout]' END AS stream
    FROM event_blocks""",
)
def captured(t):
    out = run.map_cells(p.event_blocks(t).select(*KEYS, "event_id", "value"), picky, T.LongType(), ["value"])
    return out.select(
        "event_id", F.col("value").cast("double").alias("value"), "failed", "stdout_output",
        F.element_at(F.split("stderr_output", "\n"), -1).alias("last_error_line"),
        F.substring("combined_output", 1, 8).alias("stream"),
    )


@query(
    "carry_forward",
    f"""WITH {p.EVENT_BLOCKS}
    SELECT event_id, CASE WHEN value > 300 THEN CAST(event_id AS BIGINT) ELSE CAST(trunc(value) AS BIGINT) END AS value
    FROM event_blocks""",
)
def carry_forward(t):
    """Failed cells fall back to the last stored value."""
    blocks = p.event_blocks(t)
    out = run.map_cells(blocks.select(*KEYS, "event_id", "value"), picky, T.LongType(), ["value"])
    stored = blocks.select("event_id", F.col("event_id").alias("value"))
    return run.carry_forward(out, stored, ["event_id"]).select("event_id", "value")


@query(
    "map_chunks",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_num, lines[i] AS value FROM (
         SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)""",
)
def map_chunks(t):
    out = run.map_chunks(t.documents.select("doc_id", "text"), lines, T.StringType(), ["text"], ["doc_id"])
    return run.drop_failed(out, ["doc_id"]).select("doc_id", "chunk_num", "value")


@query(
    "map_chunks_sql",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_num, lines[i] AS value, FALSE AS failed FROM (
         SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)""",
)
def map_chunks_sql(t):
    """The generator of map_chunks as a table function in SQL."""
    run.register_chunks(t.spark, "paneltide_lines", lines, T.StringType(), ["text"], ["doc_id"])
    return t.spark.sql(
        "SELECT doc_id, chunk_num, value, failed FROM paneltide_lines(TABLE(SELECT doc_id, text FROM {documents}))", documents=t.documents
    )


@query(
    "fold_history",
    f"""WITH RECURSIVE {p.EVENT_LATEST.strip()}, s AS (
      SELECT full_name, clone_num, tr_start, CAST(round(value * 100) AS BIGINT) AS cents,
             row_number() OVER (PARTITION BY full_name, clone_num ORDER BY tr_start) AS rn FROM event_latest),
    f(full_name, clone_num, tr_start, rn, value, state) AS (
      SELECT full_name, clone_num, tr_start, rn, CAST(0 AS BIGINT), cents FROM s WHERE rn = 1
      UNION ALL
      SELECT s.full_name, s.clone_num, s.tr_start, s.rn, f.state, CAST(f.state // 3 + s.cents AS BIGINT)
      FROM f JOIN s ON s.full_name = f.full_name AND s.clone_num = f.clone_num AND s.rn = f.rn + 1)
    SELECT full_name, clone_num, tr_start, value FROM f""",
)
def fold_history(t):
    cells = p.event_latest(t).select("full_name", "clone_num", "tr_start", "value")
    return run.fold_history(cells, decayed, int, T.LongType(), ["full_name", "clone_num"], ["tr_start"])


@query(
    "fold_history_merged",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, clone_num, tr_start,
           row_number() OVER (PARTITION BY full_name, clone_num ORDER BY tr_start) - 1 AS value FROM order_latest""",
)
def fold_history_merged(t):
    """A mergeable fold: yearly slices of one series run in parallel."""
    cells = p.order_latest(t).select("full_name", "clone_num", "tr_start")
    return run.fold_history(
        cells, counted, int, T.LongType(), ["full_name", "clone_num"], ["tr_start"],
        merge=lambda a, b: a + b, slice_by=time_slice(F.col("tr_start"), 360 * 86_400),
    )


@query(
    "train_predict_switch",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, clone_num, tr_start, CASE WHEN tr_start >= TIMESTAMP '1998-01-01' THEN -1.0 ELSE value END AS value
    FROM order_latest""",
)
def train_predict_switch(t):
    at = F.lit("1998-01-01").cast("timestamp")
    return p.order_latest(t).select(
        "full_name", "clone_num", "tr_start", run.train_predict_switch(at, F.col("value"), F.lit(-1.0)).alias("value")
    )


@query(
    "switch_tables",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, clone_num, tr_start, CASE WHEN tr_start >= TIMESTAMP '1998-01-01' THEN 'predicted' ELSE 'normal' END AS kind
    FROM order_latest""",
)
def switch_tables(t):
    at = F.lit("1998-01-01").cast("timestamp")
    mark = lambda kind: lambda df: df.select("full_name", "clone_num", "tr_start", F.lit(kind).alias("kind"))
    return run.switch_tables(p.order_latest(t), at, mark("normal"), mark("predicted"))


@query("named_functions", "SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS doubled FROM part")
def named_functions(t):
    run.register_functions(t.spark, {"twice_and_one": (lambda s: s.astype("int64") * 2 + 1, T.LongType()), "nothing": (None, T.LongType())})
    t.part.createOrReplaceTempView("paneltide_part")
    return t.spark.sql("SELECT p_partkey, twice_and_one(p_size) AS doubled FROM paneltide_part")
