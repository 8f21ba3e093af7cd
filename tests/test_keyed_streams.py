"""Timers and keyed folds against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.operators.ordered import Measure
from paneltide.streaming import keyed, periods, runner

DAY = dt.datetime(2020, 1, 1)


def feed(spark, path, batches, schema):
    for rows in batches:  # one file a batch, in this order
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return runner.stream_table(spark, path, spark.read.parquet(path).schema, 1)


def test_fold_stream_orders_rows_and_keeps_late_ones(spark, tmp_path):
    runner.keep_state_on_disk(spark)
    rng = random.Random(4)
    rows = [(k, DAY + dt.timedelta(days=i), i, "x") for k in ("a", "b", None) for i in range(24)]
    batches = []
    for start in range(0, 24, 6):  # shuffled within six days, which the lateness allows
        batch = [r for r in rows if start <= r[2] < start + 6]
        rng.shuffle(batch)
        batches.append(batch)
    batches.append([("a", DAY + dt.timedelta(days=2), 900, "x"), ("a", None, 901, "x"), ("a", DAY + dt.timedelta(days=40), 40, "x")])
    schema = "k string, at timestamp, value int, note string"
    stream = feed(spark, f"{tmp_path}/in", batches, schema)

    def step(state, row):
        return state * 3 % 1009 + row["value"], state

    out = keyed.fold_stream(stream, step, int, T.LongType(), ["k"], ["at"], "7 days")
    runner.append_to(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = set()
    for k in ("a", "b", None):
        state = 0
        for _, at, v, _ in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want.add((k, at, state, False))
            state = state * 3 % 1009 + v
    # The last row waits for a later one; the two others came too late.
    assert {(r.k, r["at"], r.value, r.late) for r in got if not r.late} == want
    assert sorted(((r["at"], r.value) for r in got if r.late), key=str) == sorted([(DAY + dt.timedelta(days=2), None), (None, None)], key=str)


@pytest.mark.parametrize("period", ["monthly", "yearly"])
def test_calendar_stream_equals_batch(spark, tmp_path, period):
    runner.keep_state_on_disk(spark)
    rows = [(k, DAY + dt.timedelta(hours=h), h % 50 if h % 7 else None) for k in ("a", "b") for h in range(0, 24 * 800, 31)]
    rows.append(("a", dt.datetime(2022, 4, 2), 5))  # the watermark is the end of March exactly
    schema = "k string, at timestamp, v int"
    stream = feed(spark, f"{tmp_path}/in", [[r for i, r in enumerate(rows) if i * 4 // len(rows) == b] for b in range(4)], schema)
    v = F.col("v")
    measures = [Measure("n", "count", v), Measure("total", "sum", v), Measure("low", "min", v), Measure("high", "max", v)]
    # One key is fed after the other: their times overlap by more than any lateness.
    runner.append_to(keyed.calendar_aggregate(stream, "at", ["k"], measures, period, "1000 days"), f"{tmp_path}/a", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 0
    ordered = sorted(rows, key=lambda r: r[1])
    stream = feed(spark, f"{tmp_path}/in2", [[r for i, r in enumerate(ordered) if i * 5 // len(rows) == b] for b in range(5)], schema)
    runner.append_to(keyed.calendar_aggregate(stream, "at", ["k"], measures, period), f"{tmp_path}/b", f"{tmp_path}/d")
    aggregates = [F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")]
    batch = periods.closed_periods(spark.createDataFrame(rows, schema), "at", ["k"], aggregates, period=period)
    got = spark.read.parquet(f"{tmp_path}/b").select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.count() > 2
    if period == "monthly":
        assert got.agg(F.max("tr_end")).first()[0] == dt.datetime(2022, 4, 1)
