"""Grids, versions, history, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import blocks, grid, history, joins, profile, sets
from paneltide.operators.ordered import Measure
from paneltide.plans import panels as p
from paneltide.plans.registry import query
from paneltide.session import fresh_path
from paneltide.sources import store

KEYS = ["full_name", "attribute_name", "clone_num", "tr_start", "tr_end"]


def _at(text: str):
    return F.lit(text).cast("timestamp")


def _money(c):
    return c.cast("decimal(18,2)")


# --- scans and sinks -------------------------------------------------------------------


@query(
    "read_blocks",
    f"""WITH {p.ORDER_BLOCKS}
    SELECT full_name, '00' || clone_num AS attribute_name, clone_num, tr_start, tr_end, version, value, order_id
    FROM order_blocks WHERE clone_num IN (1, 2, 3) AND tr_start >= TIMESTAMP '1996-01-01' AND tr_end <= TIMESTAMP '1999-01-01'""",
)
def read_blocks(t):
    path = fresh_path(t.spark, "blocks")
    named = F.concat(F.lit("00"), F.col("clone_num").cast("string"))
    blocks.write_blocks(p.order_blocks(t).withColumn("attribute_name", named), path)
    out = blocks.read_blocks(
        t.spark, path, clone_nums=[1, 2, 3], time_range=(_at("1996-01-01"), _at("1999-01-01"))
    )
    return out.select("full_name", "attribute_name", "clone_num", "tr_start", "tr_end", "version", "value", "order_id")


@query(
    "write_blocks",
    f"""WITH {p.ORDER_BLOCKS}, written AS (
      SELECT * FROM order_blocks
      UNION ALL
      SELECT full_name, attribute_name, clone_num, tr_start, tr_end, chunk_num, version + INTERVAL 1 DAY,
             value + 1, order_id
      FROM order_blocks WHERE value > 250000)
    SELECT full_name, clone_num, tr_start, tr_end, version, value, order_id
    FROM (SELECT *, row_number() OVER (PARTITION BY full_name, clone_num, tr_start ORDER BY version DESC, order_id) AS rn
          FROM written) WHERE rn = 1""",
)
def write_blocks(t):
    path = fresh_path(t.spark, "blocks")
    first = p.order_blocks(t)
    blocks.write_blocks(first, path)
    again = first.where("value > 250000").withColumns(
        {"version": F.col("version") + F.expr("INTERVAL 1 DAY"), "value": F.col("value") + 1}
    )
    blocks.write_blocks(again, path)
    out = blocks.latest_version(blocks.read_blocks(t.spark, path), tie_break=F.col("order_id"))
    return out.select("full_name", "clone_num", "tr_start", "tr_end", "version", "value", "order_id")


@query(
    "drop_version",
    f"""WITH {p.ORDER_BLOCKS}
    SELECT full_name, clone_num, tr_start, version, value, order_id FROM order_blocks
    WHERE version <> (SELECT max(o_orderdate) FROM orders)""",
)
def drop_version(t):
    newest = t.orders.agg(F.max(F.col("o_orderdate").cast("timestamp"))).scalar()
    out = blocks.drop_version(p.order_blocks(t), newest)
    return out.select("full_name", "clone_num", "tr_start", "version", "value", "order_id")


@query(
    "store_drop_version",
    f"""WITH {p.ORDER_BLOCKS}
    SELECT full_name, '00' || clone_num AS attribute_name, clone_num, tr_start, version, value, order_id FROM order_blocks
    WHERE version <> (SELECT max(o_orderdate) FROM orders)""",
)
def store_drop_version(t):
    path = fresh_path(t.spark, "store")
    store.append(_by_clone(p.order_blocks(t)), path)
    store.drop_version(t.spark, path, t.orders.agg(F.max(F.col("o_orderdate").cast("timestamp"))).scalar())
    return store.read_store(t.spark, path).select("full_name", "attribute_name", "clone_num", "tr_start", "version", "value", "order_id")


@query(
    "store_compact",
    f"""WITH {p.ORDER_BLOCKS}, written AS (
      SELECT * FROM order_blocks
      UNION ALL
      SELECT full_name, attribute_name, clone_num, tr_start, tr_end, chunk_num, version + INTERVAL 1 DAY,
             value + 1, order_id
      FROM order_blocks WHERE value > 250000),
    kept AS (
      SELECT * FROM written WHERE clone_num IN (1, 2, 3, 4)
        AND tr_start >= TIMESTAMP '1995-01-01' AND tr_end <= TIMESTAMP '2000-01-01'),
    ranked AS (SELECT *, rank() OVER (PARTITION BY full_name, clone_num, tr_start ORDER BY version DESC) AS rk FROM kept)
    SELECT full_name, '00' || clone_num AS attribute_name, clone_num, tr_start, tr_end, order_id, value,
           TIMESTAMP '2024-06-01' AS version FROM ranked WHERE rk = 1""",
)
def store_compact(t):
    path = fresh_path(t.spark, "store")
    first = _by_clone(p.order_blocks(t))
    store.append(first, path)
    store.append(
        first.where("value > 250000").withColumns(
            {"version": F.col("version") + F.expr("INTERVAL 1 DAY"), "value": F.col("value") + 1}
        ),
        path,
    )
    store.compact(t.spark, path, _at("2024-06-01"), [1, 2, 3, 4], (_at("1995-01-01"), _at("2000-01-01")))
    return store.read_store(t.spark, path).select(*KEYS, "order_id", "value", "version")


def _by_clone(df):
    """One partition per scenario, under a name that looks like a number."""
    return df.withColumn("attribute_name", F.concat(F.lit("00"), F.col("clone_num").cast("string")))


# --- grids ----------------------------------------------------------------------------


@query(
    "time_ranges_daily",
    """WITH b AS (SELECT user_id, min(ts) AS s, max(ts) AS e FROM events GROUP BY user_id),
    r AS (SELECT user_id, e, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS b0 FROM b WHERE s < e)
    SELECT user_id, date_trunc('milliseconds', b0) AS tr_start,
           date_trunc('milliseconds', least(b0 + INTERVAL 1 DAY, e)) AS tr_end
    FROM r WHERE b0 < e""",
)
def time_ranges_daily(t):
    bounds = t.events.groupBy("user_id").agg(F.min("ts").alias("s"), F.max("ts").alias("e"))
    return grid.explode_ranges(bounds, "s", "e", "daily")


_CUSTOMER_BOUNDS = "SELECT o_custkey, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY o_custkey"


def _customer_bounds(t):
    bounds = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    return grid.spread(bounds)


@query(
    "time_ranges_weekly",
    f"""WITH b AS ({_CUSTOMER_BOUNDS}),
    r AS (SELECT o_custkey, e, unnest(generate_series(s, e, INTERVAL 7 DAY)) AS b0 FROM b WHERE s < e)
    SELECT o_custkey, b0 AS tr_start, least(b0 + INTERVAL 7 DAY, e) AS tr_end FROM r WHERE b0 < e""",
)
def time_ranges_weekly(t):
    return grid.explode_ranges(_customer_bounds(t), "s", "e", "weekly")


@query(
    "time_ranges_monthly",
    f"""WITH RECURSIVE b AS ({_CUSTOMER_BOUNDS}),
    r(o_custkey, b0, e) AS (
      SELECT o_custkey, s, e FROM b WHERE s < e
      UNION ALL
      SELECT o_custkey, b0 + INTERVAL 1 MONTH, e FROM r WHERE b0 + INTERVAL 1 MONTH < e)
    SELECT o_custkey, b0 AS tr_start, least(b0 + INTERVAL 1 MONTH, e) AS tr_end FROM r""",
)
def time_ranges_monthly(t):
    return grid.explode_ranges(_customer_bounds(t), "s", "e", "monthly")


@query(
    "time_ranges_yearly",
    """WITH RECURSIVE z AS (SELECT max(l_shipdate) AS e FROM lineitem),
    r(o_orderkey, b0, e) AS (
      SELECT o_orderkey, o_orderdate, e FROM orders, z WHERE o_orderdate < e
      UNION ALL
      SELECT o_orderkey, b0 + INTERVAL 1 YEAR, e FROM r WHERE b0 + INTERVAL 1 YEAR < e)
    SELECT o_orderkey, b0 AS tr_start, least(b0 + INTERVAL 1 YEAR, e) AS tr_end FROM r""",
)
def time_ranges_yearly(t):
    end = t.lineitem.agg(F.max("l_shipdate")).scalar()
    bounds = t.orders.select("o_orderkey", F.col("o_orderdate").alias("s"), end.alias("e")).where("s < e")
    return grid.explode_ranges(grid.spread(bounds), "s", "e", "yearly")


@query("context_grid", f"WITH {p.EVENT_GRID} SELECT DISTINCT clone_num, tr_start, tr_end FROM event_grid")
def context_grid(t):
    return grid.context_grid(p.event_ranges(t), p.CLONES)


@query(
    "run_keys",
    f"""WITH {p.ORDER_GRID}
    SELECT full_name, attribute_name, clone_num, tr_start, tr_end FROM order_grid WHERE clone_num IN (1, 2, 3)""",
)
def run_keys(t):
    keys = grid.run_keys(p.customer_attributes(t), p.range_list(p.order_ranges(t)), p.PRIORITIES, [1, 2, 3])
    return keys.select(*KEYS)


_DOCS_SQL = """
docs AS (
  SELECT 'r' || r_regionkey AS doc_id, r_name AS full_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name FROM customer),
attributes AS (
  SELECT doc_id, full_name, 'data' AS attribute_name, TRUE AS runnable, FALSE AS empty_body FROM docs
  UNION ALL
  SELECT doc_id, full_name, 'notes', substr(doc_id, 1, 1) <> 'r', full_name LIKE '%5' FROM docs),
edges AS (
  SELECT 'n' || n_nationkey AS doc_id, 'r' || n_regionkey AS input_doc_id FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


def document_graph(t):
    """Documents, attributes and edges of the region > nation > customer hierarchy."""

    def doc(df, letter, key, name):
        return df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("doc_id"), F.col(name).alias("full_name"))

    docs = doc(t.region, "r", "r_regionkey", "r_name").unionAll(doc(t.nation, "n", "n_nationkey", "n_name"))
    docs = docs.unionAll(doc(t.customer, "c", "c_custkey", "c_name"))
    kinds = F.array(
        F.struct(F.lit("data").alias("attribute_name"), F.lit(True).alias("runnable"), F.lit(False).alias("empty_body")),
        F.struct(F.lit("notes").alias("attribute_name"), (F.substring("doc_id", 1, 1) != "r").alias("runnable"),
                 F.endswith("full_name", F.lit("5")).alias("empty_body")),
    )
    attributes = docs.select("doc_id", "full_name", F.inline(kinds)).withColumns(
        {"new_version": F.lit(2), "old_version": F.lit(1)}
    )
    link = lambda df, a, key, b, up: df.select(
        F.concat(F.lit(a), F.col(key).cast("string")).alias("doc_id"), F.lit("data").alias("attribute_name"),
        F.lit("parent").alias("var_name"), F.concat(F.lit(b), F.col(up).cast("string")).alias("input_doc_id"),
    )
    edges = link(t.nation, "n", "n_nationkey", "r", "n_regionkey").unionAll(
        link(t.customer, "c", "c_custkey", "n", "c_nationkey")
    )
    return docs, attributes, edges


@query(
    "expand_dependencies",
    f"""WITH {_DOCS_SQL}
    SELECT a.doc_id, a.full_name, a.attribute_name, i.full_name AS input_full_name,
           i.attribute_name AS input_attribute_name
    FROM attributes a
    LEFT JOIN edges e ON e.doc_id = a.doc_id AND a.attribute_name = 'data'
    LEFT JOIN attributes i ON i.doc_id = e.input_doc_id AND i.runnable
    WHERE a.runnable AND NOT a.empty_body""",
)
def expand_dependencies(t):
    docs, attributes, edges = document_graph(t)
    out = grid.expand_dependencies(docs, edges, attributes)
    return out.select("doc_id", "full_name", "attribute_name", "input_full_name", "input_attribute_name")


_ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"


@query(
    "block_key",
    f"""WITH {p.EVENT_BLOCKS}
    SELECT event_id,
      clone_num || '_' || strftime(tr_start, {_ISO}) || '_' || strftime(tr_end, {_ISO}) || '_' || chunk_num || '_' ||
        strftime(version, {_ISO}) AS block_key,
      clone_num || '_' || strftime(tr_start, {_ISO}) || '_' || strftime(tr_end, {_ISO}) || '_' AS group_key
    FROM event_blocks""",
)
def block_key(t):
    return p.event_blocks(t).select(
        "event_id", grid.block_key().alias("block_key"), grid.block_key(with_chunk=False).alias("group_key")
    )


@query(
    "valid_cells",
    f"""WITH {p.ORDER_GRID}, v AS (
      SELECT 'c' || o_custkey AS full_name, min(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) AS valid_start,
             max(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) AS valid_end,
             list(DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS valid_clones
      FROM orders GROUP BY o_custkey)
    SELECT full_name, attribute_name, clone_num, tr_start, tr_end FROM order_grid JOIN v USING (full_name)
    WHERE tr_start >= valid_start AND tr_end <= valid_end AND list_contains(valid_clones, clone_num)""",
)
def valid_cells(t):
    limits = p.order_blocks(t).groupBy("full_name").agg(
        F.min("tr_start").alias("valid_start"), F.max("tr_start").alias("valid_end"),
        F.collect_set("clone_num").alias("valid_clones"),
    )
    # Limits join the attributes, before these become keys: planners take keys for no more than the attributes
    # and would send them all through the driver.  Neither table is small enough to be sent either.
    attributes = p.customer_attributes(t).join(limits.hint("merge"), "full_name")
    keys = grid.run_keys(attributes, p.range_list(p.order_ranges(t)), p.PRIORITIES)
    return grid.valid_cells(keys).select(*KEYS)


# --- versions -------------------------------------------------------------------------


@query(
    "latest_version",
    f"""WITH {p.EVENT_LATEST}
    SELECT full_name, clone_num, tr_start, tr_end, version, value, event_id FROM event_latest""",
)
def latest_version(t):
    return p.event_latest(t).select("full_name", "clone_num", "tr_start", "tr_end", "version", "value", "event_id")


@query(
    "latest_version_orders",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, clone_num, tr_start, tr_end, version, value, order_id FROM order_latest""",
)
def latest_version_orders(t):
    return p.order_latest(t).select("full_name", "clone_num", "tr_start", "tr_end", "version", "value", "order_id")


@query(
    "compact",
    f"""WITH {p.ORDER_BLOCKS}, kept AS (
      SELECT * FROM order_blocks WHERE clone_num IN (1, 2, 3, 4)
        AND tr_start >= TIMESTAMP '1995-01-01' AND tr_end <= TIMESTAMP '2000-01-01'),
    ranked AS (SELECT *, rank() OVER (PARTITION BY full_name, clone_num, tr_start ORDER BY version DESC) AS rk FROM kept)
    SELECT full_name, attribute_name, clone_num, tr_start, tr_end, order_id, value,
           TIMESTAMP '2024-06-01' AS version FROM ranked WHERE rk = 1""",
)
def compact(t):
    out = blocks.compact(
        p.order_blocks(t), _at("2024-06-01"), valid_clones=[1, 2, 3, 4],
        valid_range=(_at("1995-01-01"), _at("2000-01-01")),
    )
    return out.select(*KEYS, "order_id", "value", "version")


@query(
    "first_value",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, arg_min(value, (clone_num, tr_start, tr_end)) AS first_value,
           arg_max(value, (clone_num, tr_start, tr_end)) AS last_value
    FROM order_latest GROUP BY full_name""",
)
def first_value(t):
    latest = p.order_latest(t)
    first = blocks.first_value(latest, ["full_name"]).withColumnRenamed("value", "first_value")
    last = blocks.first_value(latest, ["full_name"], latest=True).withColumnRenamed("value", "last_value")
    return first.join(last, "full_name")


@query(
    "slice_values",
    f"""WITH {p.EVENT_LATEST}, {p.EVENT_GRID}
    SELECT g.full_name, g.clone_num, g.tr_start, g.tr_end, l.value, l.version
    FROM event_grid g LEFT JOIN event_latest l USING (full_name, attribute_name, clone_num, tr_start, tr_end)
    WHERE g.clone_num IN (0, 2, 5) AND g.tr_start >= TIMESTAMP '2024-01-05' AND g.tr_end <= TIMESTAMP '2024-01-25'""",
)
def slice_values(t):
    out = blocks.slice_values(
        p.event_blocks(t), p.event_grid(t), [0, 2, 5], (_at("2024-01-05"), _at("2024-01-25")), F.col("event_id")
    )
    return out.select("full_name", "clone_num", "tr_start", "tr_end", "value", "version")


@query(
    "assemble_chunks",
    """SELECT conv_id, CAST(turn // 4 AS BIGINT) AS segment, count(*) AS n_pieces,
              string_agg(text, chr(10) ORDER BY turn) AS body
       FROM conversations GROUP BY conv_id, turn // 4""",
)
def assemble_chunks(t):
    out = blocks.assemble_chunks(t.conversations, ["conv_id"], "text", "turn", segment_size=4)
    return out.select("conv_id", "segment", F.size("pieces").cast("long").alias("n_pieces"),
                      F.array_join("pieces", "\n").alias("body"))


@query(
    "split_chunks",
    """SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS INTEGER)
              AS chunk_num, length(text) AS n_chars
       FROM documents""",
)
def split_chunks(t):
    out = blocks.split_chunks(t.documents.select("source", "doc_id", "text"), ["source"], ["doc_id"], 8, "text")
    return out.select("source", "doc_id", "chunk_num", F.char_length("text").cast("long").alias("n_chars"))


# --- history --------------------------------------------------------------------------

_HISTORY_SQL = """
    SELECT full_name, clone_num, tr_start,
      count(*) OVER w AS n_history, CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER w AS DOUBLE) AS sum_history,
      min(value) OVER w AS min_history, max(value) OVER w AS max_history, last_value(value) OVER w AS last_value
    FROM {0} WINDOW w AS (PARTITION BY full_name, clone_num ORDER BY tr_start
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("history_asof", f"WITH {p.ORDER_LATEST} {_HISTORY_SQL.format('order_latest')}")
def history_asof(t):
    latest = p.order_latest(t)
    out = history.history_asof(latest.select(*KEYS, "value"), exact=_money(F.col("value")))
    return out.select(
        "full_name", "clone_num", "tr_start", "n_history", F.col("sum_history").cast("double").alias("sum_history"),
        "min_history", "max_history", "last_value",
    )


@query(
    "history_asof_grid",
    f"""WITH {p.EVENT_LATEST}, {p.EVENT_GRID}
    SELECT c.full_name, c.clone_num, c.tr_start, count(b.full_name) AS n_history,
           CAST(sum(CAST(b.value AS DECIMAL(18, 2))) AS DOUBLE) AS sum_history, arg_max(b.value, b.tr_end) AS last_value
    FROM event_grid c LEFT JOIN event_latest b
      ON b.full_name = c.full_name AND b.clone_num = c.clone_num AND b.tr_end <= c.tr_start
    GROUP BY c.full_name, c.clone_num, c.tr_start""",
)
def history_asof_grid(t):
    """Cells of the whole grid against stored blocks, gaps included."""
    out = history.history_asof(p.event_grid(t), p.event_latest(t), exact=_money(F.col("value")))
    return out.select("full_name", "clone_num", "tr_start", "n_history",
                      F.col("sum_history").cast("double").alias("sum_history"), "last_value")


@query(
    "history_asof_overlapping",
    """WITH spans AS (
         SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate AS tr_start,
                l_shipdate + to_days(CAST(l_linenumber * 30 AS INTEGER)) AS tr_end FROM lineitem),
       line AS (
         SELECT l_suppkey, tr_end AS t0, 0 AS kind, l_quantity AS q, NULL AS l_orderkey, NULL AS l_linenumber,
                NULL AS l_partkey FROM spans
         UNION ALL
         SELECT l_suppkey, tr_start, 1, NULL, l_orderkey, l_linenumber, l_partkey FROM spans),
       run AS (
         SELECT *, count(q) OVER w AS n_history, coalesce(sum(CAST(q AS BIGINT)) OVER w, 0) AS sum_history FROM line
         WINDOW w AS (PARTITION BY l_suppkey ORDER BY t0, kind ROWS UNBOUNDED PRECEDING))
       SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(n_history AS BIGINT) AS n_history,
              CAST(sum_history AS DOUBLE) AS sum_history FROM run WHERE kind = 1""",
)
def history_asof_overlapping(t):
    spans = t.lineitem.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("value"),
        F.col("l_shipdate").cast("timestamp").alias("tr_start"),
        F.timestamp_micros(
            F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * F.lit(30 * 86_400_000_000)
        ).alias("tr_end"),
    )
    out = history.history_asof(spans, keys=["l_suppkey"], slice_seconds=None)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "n_history",
                      F.coalesce("sum_history", F.lit(0.0)).alias("sum_history"))


@query(
    "running_fold",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, clone_num, tr_start, value, count(value) OVER w AS n_before,
           CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER w AS DOUBLE) AS sum_before, max(value) OVER w AS max_before
    FROM order_latest WINDOW w AS (PARTITION BY full_name, clone_num ORDER BY tr_start
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_fold(t):
    measures = [
        Measure("n_before", "count", F.col("value")),
        Measure("sum_before", "sum", _money(F.col("value"))),
        Measure("max_before", "max", F.col("value")),
    ]
    out = history.running_fold(p.order_latest(t), measures, keys=["full_name", "clone_num"])
    return out.select("full_name", "clone_num", "tr_start", "value", "n_before",
                      F.col("sum_before").cast("double").alias("sum_before"), "max_before")


@query(
    "prior_clones",
    f"""WITH {p.EVENT_LATEST}, {p.EVENT_GRID}
    SELECT c.full_name, c.clone_num, c.tr_start, count(b.full_name) AS n_prior,
           CAST(sum(CAST(b.value AS DECIMAL(18, 2))) AS DOUBLE) AS sum_prior, max(b.value) AS max_prior,
           arg_max(b.value, b.clone_num) AS last_prior
    FROM event_grid c LEFT JOIN event_latest b
      ON b.full_name = c.full_name AND b.tr_start = c.tr_start AND b.tr_end = c.tr_end AND b.clone_num < c.clone_num
    GROUP BY c.full_name, c.clone_num, c.tr_start""",
)
def prior_clones(t):
    out = history.prior_clones(p.event_grid(t), p.event_latest(t), clones_per_slice=3, exact=_money(F.col("value")))
    return out.select("full_name", "clone_num", "tr_start", "n_prior",
                      F.col("sum_prior").cast("double").alias("sum_prior"), "max_prior", "last_prior")


@query(
    "clones",
    f"""WITH {p.EVENT_LATEST} SELECT full_name, clone_num, tr_start, tr_end, value FROM event_latest
    WHERE clone_num < 6 AND tr_start >= TIMESTAMP '2024-01-10' AND tr_end <= TIMESTAMP '2024-01-17'""",
)
def clones(t):
    out = history.clones(p.event_latest(t), 6, (_at("2024-01-10"), _at("2024-01-17")))
    return out.select("full_name", "clone_num", "tr_start", "tr_end", "value")


@query(
    "result_rows",
    f"""WITH {p.EVENT_LATEST}
    SELECT 'iterator' AS kind, clone_num, tr_start, tr_end, full_name, value FROM event_latest
    UNION ALL SELECT 'clones', clone_num, NULL, NULL, NULL, value FROM event_latest
    UNION ALL SELECT 'series', -1, tr_start, tr_end, NULL, value FROM event_latest""",
)
def result_rows(t):
    """The three row shapes of a read, spread over columns."""
    latest = p.event_latest(t)
    none, when = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    whole = history.iterator_rows(latest).select(
        F.lit("iterator").alias("kind"), "key.clone_num", "key.time_range.tr_start", "key.time_range.tr_end", "key.full_name", "value"
    )
    scenarios = history.clone_rows(latest).select(F.lit("clones"), "clone_num", when, when, none, "value")
    series = history.time_series_rows(latest).select(
        F.lit("series"), F.lit(-1), "time_range.tr_start", "time_range.tr_end", none, "value"
    )
    return whole.unionAll(scenarios).unionAll(series)


# --- windows, sorts, limits -----------------------------------------------------------


@query(
    "order_blocks",
    f"WITH {p.EVENT_BLOCKS} SELECT clone_num, tr_start, tr_end, chunk_num, full_name, version, value FROM event_blocks",
)
def order_blocks(t):
    return blocks.order_blocks(p.event_blocks(t)).select(
        "clone_num", "tr_start", "tr_end", "chunk_num", "full_name", "version", "value"
    )


_ALIGNED = f"""WITH {p.EVENT_LATEST}, {p.EVENT_GRID}, aligned AS (
    SELECT g.full_name, g.attribute_name, g.clone_num, g.tr_start, g.tr_end, l.value
    FROM event_grid g LEFT JOIN event_latest l USING (full_name, attribute_name, clone_num, tr_start, tr_end))"""


def _aligned(t):
    return joins.align_to_grid(p.event_latest(t).select(*KEYS, "value"), p.event_grid(t))


@query(
    "time_series_full",
    _ALIGNED + """ SELECT full_name, clone_num, tr_start, tr_end, value FROM aligned
    WHERE tr_start > (SELECT min(tr_start) FROM aligned) AND tr_start < (SELECT max(tr_start) FROM aligned)
      AND tr_end <= TIMESTAMP '2024-01-20'""",
)
def time_series_full(t):
    out = history.time_series(_aligned(t), p.event_ranges(t), as_of=_at("2024-01-20"))
    return out.select("full_name", "clone_num", "tr_start", "tr_end", "value")


@query(
    "time_series_valid",
    _ALIGNED + """ SELECT full_name, clone_num, tr_start, tr_end, value FROM aligned
    WHERE tr_start > (SELECT min(tr_start) FROM aligned) AND tr_start < (SELECT max(tr_start) FROM aligned)
      AND tr_start >= TIMESTAMP '2024-01-08' AND tr_end <= TIMESTAMP '2024-01-15'""",
)
def time_series_valid(t):
    out = history.time_series(
        _aligned(t), p.event_ranges(t), mode="valid", valid_range=(_at("2024-01-08"), _at("2024-01-15"))
    )
    return out.select("full_name", "clone_num", "tr_start", "tr_end", "value")


@query(
    "head_n",
    """SELECT o_custkey, o_orderkey, o_orderdate, CAST(rn AS INTEGER) AS rn
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       WHERE rn <= 5""",
)
def head_n(t):
    out = profile.head_rows(t.orders, ["o_orderdate", "o_orderkey"], 5, by=["o_custkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderdate", F.col("rn").cast("int").alias("rn"))


@query("head_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def head_table(t):
    return profile.head_rows(
        t.orders.select("o_orderkey", "o_custkey", "o_totalprice", (-F.col("o_totalprice")).alias("x")), ["x", "o_orderkey"]
    ).drop("x")


# --- sets -----------------------------------------------------------------------------

_SIDE = "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = '{0}'"


def _side(t, status):
    return t.orders.where(F.col("o_orderstatus") == status).select("o_custkey", "o_orderpriority")


@query(
    "diff_elements_both",
    f"""(({_SIDE.format('F')}) EXCEPT ({_SIDE.format('O')})) UNION ALL (({_SIDE.format('O')}) EXCEPT ({_SIDE.format('F')}))""",
)
def diff_elements_both(t):
    return sets.diff_elements(_side(t, "F"), _side(t, "O"))


@query("diff_elements_new", f"({_SIDE.format('F')}) EXCEPT ({_SIDE.format('O')})")
def diff_elements_new(t):
    return sets.diff_elements(_side(t, "F"), _side(t, "O"), "new")


@query("diff_elements_old", f"({_SIDE.format('O')}) EXCEPT ({_SIDE.format('F')}) ")
def diff_elements_old(t):
    return sets.diff_elements(_side(t, "F"), _side(t, "O"), "old")


@query(
    "intersect_clones",
    """SELECT full_name, array_to_string(list_sort(list_intersect(requested, valid)), ',') AS clones FROM (
         SELECT 'c' || o_custkey AS full_name,
           coalesce(list(DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) FILTER (o_orderstatus = 'F'), []) AS requested,
           coalesce(list(DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) FILTER (o_orderstatus = 'O'), []) AS valid
         FROM orders GROUP BY o_custkey)""",
)
def intersect_clones(t):
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    per = t.orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("full_name")).agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", number)).alias("requested"),
        F.collect_set(F.when(F.col("o_orderstatus") == "O", number)).alias("valid"),
    )
    both = sets.intersect_clones(F.col("requested"), F.col("valid"))
    return per.select("full_name", F.array_join(both.cast("array<string>"), ",").alias("clones"))


@query("dedup_sets", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def dedup_sets(t):
    return sets.dedup_sets(t.lineitem, ["l_suppkey", "l_returnflag", "l_linestatus"])
