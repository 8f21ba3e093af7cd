"""Two panels derived from the sample tables, in Spark and as SQL fragments.

``event_*``: node = event type, scenario = user modulo 8, range = day, version = time.
``order_*``: node = customer, scenario = priority, range = month, version = order date;
this one grows with the tables in every dimension but time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paneltide.operators.blocks import latest_version
from paneltide.operators.grid import run_keys, time_ranges
from paneltide.plans.registry import Tables

CLONES = range(0, 8)
PRIORITIES = range(1, 6)


def event_blocks(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", ts)
    return t.events.select(
        F.col("event_type").alias("full_name"),
        F.lit("data").alias("attribute_name"),
        (F.col("user_id") % 8).cast("int").alias("clone_num"),
        day.alias("tr_start"),
        (day + F.expr("INTERVAL 1 DAY")).alias("tr_end"),
        F.lit(0).alias("chunk_num"),
        ts.alias("version"),
        "value",
        "event_id",
    )


def event_latest(t: Tables) -> DataFrame:
    return latest_version(event_blocks(t), tie_break=F.col("event_id"))


def event_ranges(t: Tables) -> DataFrame:
    """All days from the first to the last event."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    ends = t.events.agg(F.min(day).alias("lo"), (F.max(day) + F.expr("INTERVAL 1 DAY")).alias("hi"))
    return ends.select(F.inline(time_ranges(F.col("lo"), F.col("hi"), "daily")))


def range_list(ranges: DataFrame):
    """The ranges of a run as one array value, computed once."""
    return ranges.agg(F.sort_array(F.collect_list(F.struct("tr_start", "tr_end"))).alias("r")).scalar()


def event_grid(t: Tables) -> DataFrame:
    nodes = t.events.select(F.col("event_type").alias("full_name")).distinct().withColumn("attribute_name", F.lit("data"))
    keys = run_keys(nodes, range_list(event_ranges(t)), CLONES)
    return keys.select("full_name", "attribute_name", "clone_num", "tr_start", "tr_end")


def order_blocks(t: Tables) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    month = F.date_trunc("month", at)
    return t.orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("full_name"),
        F.lit("data").alias("attribute_name"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("clone_num"),
        month.alias("tr_start"),
        (month + F.expr("INTERVAL 1 MONTH")).alias("tr_end"),
        F.lit(0).alias("chunk_num"),
        at.alias("version"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("order_id"),
    )


def order_latest(t: Tables) -> DataFrame:
    return latest_version(order_blocks(t), tie_break=F.col("order_id"))


def order_ranges(t: Tables) -> DataFrame:
    """All months from the first to the last order."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    ends = t.orders.agg(F.min(month).alias("lo"), (F.max(month) + F.expr("INTERVAL 1 MONTH")).alias("hi"))
    return ends.select(F.inline(time_ranges(F.col("lo"), F.col("hi"), "monthly")))


def customer_attributes(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("full_name"), F.lit("data").alias("attribute_name"),
    )


def order_grid(t: Tables) -> DataFrame:
    keys = run_keys(customer_attributes(t), range_list(order_ranges(t)), PRIORITIES)
    return keys.select("full_name", "attribute_name", "clone_num", "tr_start", "tr_end")


EVENT_BLOCKS = """
event_blocks AS (
  SELECT event_type AS full_name, 'data' AS attribute_name, CAST(user_id % 8 AS INTEGER) AS clone_num,
         CAST(date_trunc('day', ts) AS TIMESTAMP) AS tr_start,
         CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS tr_end,
         0 AS chunk_num, ts AS version, value, event_id
  FROM events)"""

EVENT_LATEST = EVENT_BLOCKS + """,
event_latest AS (
  SELECT full_name, attribute_name, clone_num, tr_start, tr_end, chunk_num, version, value, event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY full_name, clone_num, tr_start
                                     ORDER BY version DESC, event_id) AS rn FROM event_blocks)
  WHERE rn = 1)"""

EVENT_GRID = """
event_days AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP) AS tr_start
  FROM (SELECT min(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS lo, max(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS hi
        FROM events)),
event_grid AS (
  SELECT full_name, 'data' AS attribute_name, CAST(c AS INTEGER) AS clone_num, tr_start,
         tr_start + INTERVAL 1 DAY AS tr_end
  FROM (SELECT DISTINCT event_type AS full_name FROM events), range(8) AS r(c), event_days)"""

ORDER_BLOCKS = """
order_blocks AS (
  SELECT 'c' || o_custkey AS full_name, 'data' AS attribute_name,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS clone_num,
         CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS tr_start,
         CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 1 MONTH AS tr_end,
         0 AS chunk_num, o_orderdate AS version, o_totalprice AS value, o_orderkey AS order_id
  FROM orders)"""

ORDER_LATEST = ORDER_BLOCKS + """,
order_latest AS (
  SELECT full_name, attribute_name, clone_num, tr_start, tr_end, chunk_num, version, value, order_id
  FROM (SELECT *, row_number() OVER (PARTITION BY full_name, clone_num, tr_start
                                     ORDER BY version DESC, order_id) AS rn FROM order_blocks)
  WHERE rn = 1)"""

ORDER_GRID = """
order_months AS (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS TIMESTAMP) AS tr_start
  FROM (SELECT min(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) AS lo,
               max(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) AS hi FROM orders)),
order_grid AS (
  SELECT 'c' || c_custkey AS full_name, 'data' AS attribute_name, CAST(c AS INTEGER) AS clone_num, tr_start,
         tr_start + INTERVAL 1 MONTH AS tr_end
  FROM customer, range(1, 6) AS r(c), order_months)"""
