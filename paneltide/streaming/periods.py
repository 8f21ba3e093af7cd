"""Period aggregates that appear only once their period is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Window lengths by period name; windows of weeks start on Mondays.
PERIODS = {"daily": ("1 day", None), "weekly": ("7 days", "4 days")}
# Calendar units of the batch twin, and their lengths as intervals.
UNITS = {"daily": ("day", "INTERVAL 1 DAY"), "weekly": ("week", "INTERVAL 7 DAYS"), "monthly": ("month", "INTERVAL 1 MONTH"), "yearly": ("year", "INTERVAL 1 YEAR")}


def period_aggregate(
    stream: DataFrame, time: str, keys: list[str], aggregates: list[Column], period: str = "daily", late: str = "1 day"
) -> DataFrame:
    """Aggregates per key and closed period.

    In append mode a window is emitted when the watermark passes its end: the same rule
    by which a range becomes readable only when it is complete.
    """
    if period not in PERIODS:
        raise ValueError("period must be one of: daily, weekly")
    length, start = PERIODS[period]
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, length, start) if start else F.window(time, length)
    grouped = timed.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return grouped.select(
        *keys, F.col("w.start").alias("tr_start"), F.col("w.end").alias("tr_end"),
        *[c for c in grouped.columns if c not in ("w", *keys)],
    )


def closed_periods(
    batch: DataFrame, time: str, keys: list[str], aggregates: list[Column], late_seconds: int = 86_400, period: str = "daily"
) -> DataFrame:
    """Batch twin: aggregates per period, without those the final watermark leaves open.

    Weeks start on Mondays; months and years are those of the calendar, in UTC.
    """
    if period not in UNITS:
        raise ValueError(f"period must be one of: {', '.join(UNITS)}")
    unit, length = UNITS[period]
    start = F.date_trunc(unit, F.col(time).cast("timestamp"))
    end = start + F.expr(length)
    grouped = batch.groupBy(*keys, start.alias("tr_start"), end.alias("tr_end")).agg(*aggregates)
    newest = batch.agg(F.max(F.unix_micros(F.col(time).cast("timestamp"))).alias("m"))
    watermark = newest.select(F.floor(F.col("m") / 1000) * 1000 - late_seconds * 1_000_000).scalar()
    return grouped.where(F.unix_micros("tr_end") <= watermark)
