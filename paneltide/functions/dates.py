"""Date and time columns (UTC, millisecond comparisons).

Everything here is a JVM expression: it stays inside code generation and costs no
shuffle.  Naive timestamps mean UTC, so the session time zone has to be UTC
(``paneltide.session.prepare``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paneltide.functions.binding import let_sql
from paneltide.schema import DATETIME_MAX, DATETIME_MIN, MAX_SECONDS, MIN_SECONDS

# Output and input formats.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

# Zone names of mail dates, hours from UTC.
ZONE_HOURS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -4, "ADT": -3,
    "EST": -5, "EDT": -4,
    "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7,
}
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Calendar dates yyyy-MM-dd or yyyyMMdd, or ISO weeks; then one separator character and
# a time in extended or basic form; then an offset.
_ISO = (
    r"(?s)^(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})-?W(\d{2})(?:-?([1-7]))?)"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:([+-])(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?)?)?$"
)
_PLAIN = r"^(?!0000)\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
_MAIL = (
    r"(?i)^\s*(?:[a-z]+,?\s+)?(\d{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*,?"
    r"\s+(\d{2}|\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[a-z]+))?.*$"
)
_MIN_SECOND, _MAX_SECOND = -62135596800.0, 253402300799.999


def ensure_utc(c: Column) -> Column:
    """Naive timestamps are UTC already; aware ones are instants."""
    return c.cast("timestamp")


def to_milli(c: Column) -> Column:
    return F.date_trunc("MILLISECOND", ensure_utc(c))


def to_iso(c: Column) -> Column:
    return F.date_format(ensure_utc(c), ISO_FORMAT)


def datetime_min() -> Column:
    return F.lit(DATETIME_MIN).cast("timestamp")


def datetime_max() -> Column:
    return F.lit(DATETIME_MAX).cast("timestamp")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of a matching text from one pass, as an array (NULL: no match)."""
    joined = F.regexp_replace(text, pattern, "\x01".join(f"${i}" for i in range(1, n + 1)))
    return F.when(text.rlike(pattern), F.split(joined, "\x01", -1))


def _part(i: int) -> str:
    return f"nullif(get(p, {i - 1}), '')"


def _num(i: int, default: int = 0) -> str:
    return f"coalesce(CAST({_part(i)} AS INT), {default})"


def _iso_sql() -> str:
    """Instant of the groups ``p`` of ISO text; NULL for dates or times that do not exist."""
    year, month, day = (f"coalesce({_part(i)}, {_part(i + 3)})" for i in (1, 2, 3))
    # Week 1 holds 4 January; weekday() counts from Monday = 0.  28 December always lies
    # in the last week of its year.
    week = f"""CASE WHEN {_num(8)} BETWEEN 1 AND weekofyear(try_cast(concat(get(p, 6), '-12-28') AS DATE)) THEN
      get(transform(array(try_cast(concat(get(p, 6), '-01-04') AS DATE)), j ->
        date_add(date_sub(j, weekday(j)), ({_num(8)} - 1) * 7 + {_num(9, 1)} - 1)), 0) END"""
    date = f"""CASE WHEN {year} >= '0001' THEN try_cast(concat_ws('-', {year}, {month}, {day}) AS DATE)
      WHEN {_part(7)} IS NOT NULL THEN {week} END"""
    micros = f"CAST(rpad(substr(coalesce(get(p, 12), ''), 1, 6), 6, '0') AS BIGINT)"
    clock = f"CAST({_num(10)} * 3600 + {_num(11)} * 60 + {_num(12)} AS BIGINT) * 1000000 + {micros}"
    offset = f"CAST({_num(15)} * 3600 + {_num(16)} * 60 + {_num(17)} AS BIGINT) * IF(get(p, 13) = '-', -1, 1)"
    fits = " AND ".join(
        [f"{_num(i)} <= {top}" for i, top in ((10, 23), (11, 59), (12, 59), (15, 23), (16, 59), (17, 59))]
    )
    return f"""CASE WHEN p IS NOT NULL AND {fits} THEN
      timestamp_micros(unix_date({date}) * 86400000000L + {clock} - ({offset}) * 1000000) END"""


def _mail_sql() -> str:
    """Instant of the groups ``p`` of a mail date."""
    months = ", ".join(f"'{m}'" for m in MONTH_NAMES)
    year = f"""CASE WHEN length(get(p, 2)) = 4 THEN {_num(3)} WHEN {_num(3)} > 68 THEN {_num(3)} + 1900
      ELSE {_num(3)} + 2000 END"""
    date = f"""try_cast(concat_ws('-', lpad({year}, 4, '0'),
      lpad(array_position(array({months}), lower(get(p, 1))), 2, '0'), lpad(get(p, 0), 2, '0')) AS DATE)"""
    named = " ".join(f"WHEN '{name}' THEN {hours * 60}" for name, hours in ZONE_HOURS.items())
    zone = f"""get(transform(array(upper(coalesce({_part(7)}, 'UTC'))), z ->
      CASE WHEN z RLIKE '^[+-][0-9]{{4}}$' THEN IF(z LIKE '-%', -1, 1) * (CAST(substr(z, 2, 2) AS INT) * 60
        + CAST(substr(z, 4, 2) AS INT)) ELSE CASE z {named} ELSE 0 END END), 0)"""
    clock = f"{_num(4)} * 3600 + {_num(5)} * 60 + {_num(6)} - {zone} * 60"
    return f"""CASE WHEN p IS NOT NULL AND {_num(4)} <= 23 AND {_num(5)} <= 59 AND {_num(6)} <= 59 THEN
      timestamp_seconds(unix_date({date}) * 86400L + {clock}) END"""


def _parse_iso(text: Column) -> Column:
    parts = _groups(F.replace(text, F.lit("Z"), F.lit("+00:00")), _ISO, 17)
    # Plain extended times need no groups: the built-in cast reads them.
    return F.when(text.rlike(_PLAIN), text.try_cast("timestamp")).otherwise(let_sql(parts, "p", _iso_sql()))


def _parse_mail(text: Column) -> Column:
    return let_sql(_groups(text, _MAIL, 7), "p", _mail_sql())


def parse_datetime(text: Column) -> Column:
    """ISO text first (``Z`` accepted), then mail dates, else NULL."""
    return F.coalesce(_parse_iso(text), _parse_mail(text))


def datetimes_close(a: Column, b: Column) -> Column:
    """True when two instants lie within one millisecond."""
    return F.abs(F.unix_micros(ensure_utc(a)) - F.unix_micros(ensure_utc(b))) <= 1000


def to_epoch_seconds(c: Column, low: float = MIN_SECONDS, high: float = MAX_SECONDS) -> Column:
    """Seconds since 1970; the open bounds become ``low`` and ``high``."""
    seconds = F.unix_micros(ensure_utc(c)) / F.lit(1e6)
    return (
        F.when(datetimes_close(c, datetime_min()), F.lit(float(low)))
        .when(datetimes_close(c, datetime_max()), F.lit(float(high)))
        .when(c.isNotNull(), F.greatest(F.least(seconds, F.lit(float(high))), F.lit(float(low))))
    )


def normalize_epoch(c: Column) -> Column:
    """Seconds from a number that may count seconds, milliseconds or microseconds."""
    x = c.cast("double")
    return F.when(F.abs(x) > 1e14, x / 1e6).when(F.abs(x) > 1e11, x / 1e3).otherwise(x)


def from_epoch(c: Column, low: float = MIN_SECONDS, high: float = MAX_SECONDS) -> Column:
    """A number as UTC time at millisecond precision; out of range gives an open bound."""
    x = c.cast("double")
    seconds = normalize_epoch(x)
    inside = seconds.between(_MIN_SECOND, _MAX_SECOND)
    # The guard also covers the cast: NULL instead of overflow for values out of range.
    micros = F.when(inside, F.rint(seconds * 1e6)).cast("long")
    return (
        F.when((x <= low) | (seconds < _MIN_SECOND), datetime_min())
        .when((x >= high) | (seconds > _MAX_SECOND), datetime_max())
        .when(inside, F.date_trunc("MILLISECOND", F.timestamp_micros(micros)))
    )
