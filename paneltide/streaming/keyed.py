"""Keyed state with event-time timers: calendar periods and folds over a series' own past."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from paneltide.operators.ordered import Measure
from paneltide.streaming.periods import UNITS


def _later(a, b, kind: str):
    if a is None or b is None:
        return b if a is None else a
    return {"min": min, "max": max}.get(kind, lambda x, y: x + y)(a, b)


class _Periods(StatefulProcessor):
    """Adds up partial aggregates of a period until the watermark reaches its end."""

    def __init__(self, keys: list[str], measures: list[tuple[str, str]]):
        self.keys, self.measures = keys, measures

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("partial", "partial binary")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else [None] * len(self.measures)
        for row in rows:
            held = [_later(h, row[name], kind) for h, (name, kind) in zip(held, self.measures)]
            self.handle.registerTimer(row["__end_ms"])  # the same for all rows of the key
        self.state.update((pickle.dumps(held),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = pickle.loads(self.state.get()[0])
        self.state.clear()
        yield Row(**dict(zip(self.keys, key)), **{name: x for (name, _), x in zip(self.measures, held)})

    def close(self) -> None:
        pass


def calendar_aggregate(
    stream: DataFrame, time: str, keys: list[str], measures: list[Measure], period: str = "monthly", late: str = "1 day"
) -> DataFrame:
    """``keys, tr_start, tr_end`` and the measures of every closed month or year (append mode, UTC).

    Rows are first combined by day, by Spark's own windowed aggregate; a keyed state per period
    adds up its days, and a timer at the calendar end emits it once the watermark is there.
    A row later than ``late`` is dropped with its day.  Days are emitted before the period
    they end, so a period never misses one.
    """
    if period not in ("monthly", "yearly"):
        raise ValueError("period must be one of: monthly, yearly")
    unit, length = UNITS[period]
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    daily = timed.groupBy(F.window(time, "1 day").alias("__day"), *keys).agg(*[m.fold(m.input()).alias(m.name) for m in measures])
    start = F.date_trunc(unit, F.col("__day.start"))
    end = start + F.expr(length)
    partial = daily.select(*keys, start.alias("tr_start"), end.alias("tr_end"), F.unix_millis(end).alias("__end_ms"), *[m.name for m in measures])
    by = [*keys, "tr_start", "tr_end"]
    output = T.StructType([partial.schema[c] for c in [*by, *[m.name for m in measures]]])
    return partial.groupBy(*by).transformWithState(
        statefulProcessor=_Periods(by, [(m.name, m.kind) for m in measures]), outputStructType=output, outputMode="Append", timeMode="EventTime"
    )


class _Fold(StatefulProcessor):
    """Buffers rows until the watermark passes them, then folds them in order."""

    def __init__(self, columns: list[str], order_by: list[str], step: Callable, initial: Callable):
        self.columns, self.order_by, self.step, self.initial = columns, order_by, step, initial

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state binary")
        #: Rows by their time and arrival number; sorted when they are due.
        self.waiting = handle.getMapState("waiting", "us long, number long", "row binary")
        #: Arrivals so far, and the time of the next timer.
        self.about = handle.getValueState("about", "number long, timer long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        number, timer = self.about.get() if self.about.exists() else (0, None)
        for row in rows:
            us = row["__us"]
            if us is None or us <= watermark:
                yield Row(**{**{c: row[c] for c in self.columns}, "value": None, "late": True})
                continue
            self.waiting.updateValue((us, number), (pickle.dumps(tuple(row[c] for c in self.columns)),))
            number += 1
            due = -(-us // 1000)
            if timer is None or due < timer:
                timer = due
                self.handle.registerTimer(timer)
        self.about.update((number, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        number, timer = self.about.get()
        if timer is not None and timer * 1000 > watermark:
            return  # an earlier timer's call has folded these rows
        due, rest = [], None
        for k in self.waiting.keys():
            if k[0] <= watermark:
                due.append(tuple(k))
            else:
                rest = k[0] if rest is None else min(rest, k[0])
        held = []
        for k in due:
            held.append(dict(zip(self.columns, pickle.loads(self.waiting.getValue(k)[0]))))
            self.waiting.removeKey(k)
        held.sort(key=lambda row: tuple(row[c] for c in self.order_by))
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self.initial()
        for row in held:
            state, value = self.step(state, row)
            yield Row(**{**row, "value": value, "late": False})
        self.state.update((pickle.dumps(state),))
        timer = None if rest is None else -(-rest // 1000)
        if timer is not None:
            self.handle.registerTimer(timer)
        self.about.update((number, timer))

    def close(self) -> None:
        pass


def fold_stream(
    stream: DataFrame,
    step: Callable[[object, dict], tuple],
    initial: Callable[[], object],
    value: T.DataType,
    keys: list[str],
    order_by: list[str],
    late: str = "1 day",
) -> DataFrame:
    """``fold_history`` over a stream whose rows come out of order: its columns, ``value`` and ``late``.

    ``order_by`` starts with the event time.  A row waits in its key's state until the watermark
    passes it; then all rows due are folded in order and the next timer is set.  A row that comes
    after the watermark, or has no time, cannot take part any more: it is given back at once
    with ``late`` true and no value.  State per key is the fold's own state and the rows within
    the lateness.
    """
    time = order_by[0]
    columns = list(stream.columns)
    timed = stream.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    # Without the event-time column Spark drops no late row before the state sees it.
    rows = timed.withColumn("__us", F.unix_micros("__time")).drop("__time")
    # As in fold_history, the result takes the place of an input column of its name.
    fields = {f.name: f for f in [*stream.schema, T.StructField("value", value), T.StructField("late", T.BooleanType())]}
    output = T.StructType(list(fields.values()))
    return rows.groupBy(*keys).transformWithState(
        statefulProcessor=_Fold(columns, order_by, step, initial), outputStructType=output, outputMode="Append", timeMode="EventTime"
    )
