"""Streams over the sample tables, each equal to its batch twin once it has caught up."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.operators.ordered import Measure
from paneltide.plans import panels as p
from paneltide.plans.cells import decayed
from paneltide.plans.profiles import MESSAGE_SQL, messages
from paneltide.plans.registry import Tables, query
from paneltide.session import fresh_path
from paneltide.sources.changes import read_change_feed
from paneltide.streaming import changes, keyed, periods, runner


class _Streamed(Tables):
    """The same tables, read as streams."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, t.path)
        self._schemas = {"events": t.events.schema, "orders": t.orders.schema}

    def __getattr__(self, name):
        return runner.stream_table(self.spark, self.location(name), self._schemas[name])


@query(
    "stream_changes",
    f"WITH {MESSAGE_SQL} SELECT graph_id, id, collection, operation, is_deleted, CAST(NULL AS VARCHAR) AS error FROM msgs",
)
def stream_changes(t):
    feed = fresh_path(t.spark, "feed")
    messages(t).select("data").repartition(4).write.json(feed)
    out, checkpoint = runner.scratch(t.spark, "changes")
    stream = changes.stream_changes(read_change_feed(t.spark, feed, streaming=True))
    runner.append_to(stream, out, checkpoint)
    return t.spark.read.parquet(out).select("graph_id", "id", "collection", "operation", "is_deleted", "error")


@query(
    "apply_changes",
    f"""WITH {MESSAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS rn FROM msgs)
    SELECT id, graph_id, collection, operation, event_id AS sequence FROM r
    WHERE rn = 1 AND operation <> 'delete' AND NOT is_deleted""",
)
def apply_changes(t):
    feed = fresh_path(t.spark, "feed")
    messages(t).select("data").repartition(4).write.json(feed)
    runner.keep_state_on_disk(t.spark)
    out, checkpoint = runner.scratch(t.spark, "state")
    stream = read_change_feed(t.spark, feed, streaming=True)
    sequenced = stream.withColumn("sequence", F.get_json_object("data", "$.sequence").cast("long"))
    state = changes.apply_changes(changes.stream_changes(sequenced), F.col("sequence"))
    runner.update_log(state, out, checkpoint)
    current = changes.current_state(t.spark.read.parquet(out), ["id"])
    return changes.live(current).select("id", "graph_id", "collection", "operation", "sequence")


@query(
    "latest_stream",
    f"""WITH {p.ORDER_LATEST}
    SELECT full_name, clone_num, tr_start, tr_end, version, value, order_id FROM order_latest""",
)
def latest_stream(t):
    runner.keep_state_on_disk(t.spark)
    out, checkpoint = runner.scratch(t.spark, "latest")
    stream = changes.latest_stream(p.order_blocks(_Streamed(t)), F.col("order_id"))
    runner.update_log(stream, out, checkpoint)
    keys = ["full_name", "attribute_name", "clone_num", "tr_start", "tr_end"]
    current = changes.current_state(t.spark.read.parquet(out), keys)
    return current.select("full_name", "clone_num", "tr_start", "tr_end", "version", "value", "order_id")


def _closed_sql(unit: str, length: str) -> str:
    start = f"CAST(date_trunc('{unit}', ts) AS TIMESTAMP)"
    return f"""SELECT event_type, {start} AS tr_start, {start} + INTERVAL {length} AS tr_end, count(*) AS n,
      CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM events GROUP BY event_type, date_trunc('{unit}', ts)
    HAVING {start} + INTERVAL {length} <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)"""


_CLOSED = _closed_sql("day", "1 DAY")


def _daily():
    return [F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")]


@query("period_agg_stream", _CLOSED)
def period_agg_stream(t):
    out, checkpoint = runner.scratch(t.spark, "periods")
    stream = periods.period_aggregate(_Streamed(t).events, "ts", ["event_type"], _daily())
    runner.append_to(stream, out, checkpoint)
    return t.spark.read.parquet(out).select("event_type", "tr_start", "tr_end", "n", "total")


@query("period_agg_batch", _CLOSED)
def period_agg_batch(t):
    out = periods.closed_periods(t.events, "ts", ["event_type"], _daily())
    return out.select("event_type", "tr_start", "tr_end", "n", "total")


@query("period_agg_weekly", _closed_sql("week", "7 DAY"))
def period_agg_weekly(t):
    out = periods.closed_periods(t.events, "ts", ["event_type"], _daily(), period="weekly")
    return out.select("event_type", "tr_start", "tr_end", "n", "total")


def _calendar(period: str, unit: str) -> None:
    start = f"CAST(date_trunc('{unit}', o_orderdate) AS TIMESTAMP)"
    sql = f"""SELECT o_orderpriority, {start} AS tr_start, {start} + INTERVAL 1 {unit} AS tr_end, count(*) AS n,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM orders GROUP BY o_orderpriority, date_trunc('{unit}', o_orderdate)
    HAVING {start} + INTERVAL 1 {unit} <= (SELECT CAST(max(o_orderdate) AS TIMESTAMP) - INTERVAL 1 DAY FROM orders)"""

    @query(f"period_agg_{period}", sql)
    def closed(t):
        total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
        out = periods.closed_periods(t.orders, "o_orderdate", ["o_orderpriority"], [F.count("*").alias("n"), total], period=period)
        return out.select("o_orderpriority", "tr_start", "tr_end", "n", "total")

    @query(f"period_agg_stream_{period}", sql)
    def streamed(t):
        """The same as a stream: timers at the calendar's ends."""
        runner.keep_state_on_disk(t.spark)
        out, checkpoint = runner.scratch(t.spark, period)
        measures = [Measure("n", "count", F.lit(1)), Measure("total", "sum", F.col("o_totalprice").cast("decimal(18,2)"))]
        stream = keyed.calendar_aggregate(_Streamed(t).orders, "o_orderdate", ["o_orderpriority"], measures, period)
        runner.append_to(stream, out, checkpoint)
        return t.spark.read.parquet(out).withColumn("total", F.col("total").cast("double"))


# Events span less than a month, so calendar periods are those of orders.
_calendar("monthly", "month")
_calendar("yearly", "year")


@query("period_agg_stream_weekly", _closed_sql("week", "7 DAY"))
def period_agg_stream_weekly(t):
    out, checkpoint = runner.scratch(t.spark, "weeks")
    stream = periods.period_aggregate(_Streamed(t).events, "ts", ["event_type"], _daily(), "weekly")
    runner.append_to(stream, out, checkpoint)
    return t.spark.read.parquet(out).select("event_type", "tr_start", "tr_end", "n", "total")


@query(
    "fold_history_stream",
    f"""WITH RECURSIVE {p.EVENT_LATEST.strip()}, s AS (
      SELECT full_name, clone_num, tr_start, CAST(round(value * 100) AS BIGINT) AS cents,
             row_number() OVER (PARTITION BY full_name, clone_num ORDER BY tr_start) AS rn FROM event_latest),
    f(full_name, clone_num, tr_start, rn, value, state) AS (
      SELECT full_name, clone_num, tr_start, rn, CAST(0 AS BIGINT), cents FROM s WHERE rn = 1
      UNION ALL
      SELECT s.full_name, s.clone_num, s.tr_start, s.rn, f.state, CAST(f.state // 3 + s.cents AS BIGINT)
      FROM f JOIN s ON s.full_name = f.full_name AND s.clone_num = f.clone_num AND s.rn = f.rn + 1)
    SELECT full_name, clone_num, tr_start, value FROM f WHERE tr_start <= (SELECT max(tr_start) - INTERVAL 5 DAY FROM s)""",
)
def fold_history_stream(t):
    """The fold of fold_history, fed by cells that arrive up to four days out of order."""
    cells = p.event_latest(t).select("full_name", "clone_num", "tr_start", "value")
    feed = fresh_path(t.spark, "cells")
    delay = F.pmod(F.xxhash64("full_name", "clone_num", "tr_start"), F.lit(4))
    arrival = F.floor((F.unix_date(F.to_date("tr_start")) + delay) / 8).alias("arrival")
    arrived = cells.select("*", arrival).repartition(2)
    arrived.write.partitionBy("arrival").parquet(f"{feed}/all")
    stored = t.spark.read.parquet(f"{feed}/all")
    first, last = stored.agg(F.min("arrival"), F.max("arrival")).first()
    for at in range(first, last + 1) if first is not None else []:
        stored.where(F.col("arrival") == at).drop("arrival").coalesce(1).write.mode("append").parquet(f"{feed}/feed")
    runner.keep_state_on_disk(t.spark)
    out, checkpoint = runner.scratch(t.spark, "fold")
    stream = runner.stream_table(t.spark, f"{feed}/feed", cells.schema, 1)
    folded = keyed.fold_stream(stream, decayed, int, T.LongType(), ["full_name", "clone_num"], ["tr_start"], "5 days")
    runner.append_to(folded, out, checkpoint)
    return t.spark.read.parquet(out).where("NOT late").select("full_name", "clone_num", "tr_start", F.col("value"))
