"""Scalar column functions: times, dates, calendar features, intervals.

All of them return ``Column`` expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftspark import constants as K

ColumnOrName = Column | str

# A time is 5 characters "H:M" in which each side is an optionally signed
# integer with blanks allowed around it.  No range check: 99:99 -> 6039.
_TIME_RE = r"^\s*([+-]?[0-9]+)\s*:\s*([+-]?[0-9]+)\s*$"

MICROS_PER_MINUTE = 60 * 1_000_000
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR
BYTES_PER_MB = 1024.0 * 1024.0


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# F1 / F2: clock text <-> minutes since midnight
# --------------------------------------------------------------------------
def time_to_minutes(c: ColumnOrName) -> Column:
    """``'HH:MM'`` -> minutes as double; anything unreadable -> 0.0."""
    c = _c(c)
    ok = (F.length(c) == 5) & c.rlike(_TIME_RE)
    hours = F.regexp_extract(c, _TIME_RE, 1).try_cast("int")
    minutes = F.regexp_extract(c, _TIME_RE, 2).try_cast("int")
    return F.when(ok, (hours * 60 + minutes).cast("double")).otherwise(F.lit(0.0))


def minutes_to_time(c: ColumnOrName) -> Column:
    """Minutes -> ``'HH:MM'``; <= 0 gives ``00:00``; half-even rounding; hours may pass 24."""
    c = _c(c)
    # try_cast: NaN or a value beyond a long gives null rather than an error.
    total = F.bround(c, 0).try_cast("long")
    text = F.format_string("%02d:%02d", F.floor(total / 60).cast("long"), total % 60)
    return F.when(c <= 0, F.lit("00:00")).when(total.isNotNull(), text)


# --------------------------------------------------------------------------
# dates
# --------------------------------------------------------------------------
def parse_date(c: ColumnOrName, fmt: str) -> Column:
    """Exact-format date parse; null when it does not match or is out of range."""
    d = F.try_to_date(_c(c), fmt)
    in_range = d.between(F.lit(K.MIN_DATE).cast("date"), F.lit(K.MAX_DATE).cast("date"))
    return F.when(in_range, d)


def display_date(c: ColumnOrName) -> Column:
    """Date -> ``dd/MM/yyyy`` text."""
    return F.date_format(_c(c), K.DISPLAY_DATE_FORMAT)


# --------------------------------------------------------------------------
# Calendar features
# --------------------------------------------------------------------------
def day_of_week(c: ColumnOrName) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(c)).cast("int")


def day_of_year(c: ColumnOrName) -> Column:
    return F.dayofyear(_c(c)).cast("int")


def iso_week(c: ColumnOrName) -> Column:
    """ISO-8601 week number (late December may be week 1)."""
    return F.weekofyear(_c(c)).cast("int")


def month(c: ColumnOrName) -> Column:
    return F.month(_c(c)).cast("int")


def week_of_month(c: ColumnOrName) -> Column:
    """0-based week of the month: ceil((day + weekday of the 1st) / 7) - 1."""
    c = _c(c)
    first_wd = F.weekday(F.trunc(c, "month"))
    return (F.ceil((F.dayofmonth(c) + first_wd) / F.lit(7.0)) - 1).cast("int")


def weekday_name(c: ColumnOrName) -> Column:
    """Locale-free weekday name, ``mon`` .. ``sun``."""
    names = F.array(*[F.lit(n) for n in K.WEEKDAY_NAMES])
    return F.element_at(names, F.weekday(_c(c)) + 1)


def date_features(c: ColumnOrName) -> Column:
    """(day_of_week, day_of_year) as a struct."""
    return F.struct(day_of_week(c).alias(K.DAY_OF_WEEK), day_of_year(c).alias(K.DAY_OF_YEAR))


# --------------------------------------------------------------------------
# Interval arithmetic on timestamps
# --------------------------------------------------------------------------
def whole_units_between(start: ColumnOrName, end: ColumnOrName, unit_micros: int) -> Column:
    """(end - start) in whole units, truncated toward zero, exact in integers."""
    diff = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    # Java remainder keeps the sign of the dividend, so diff - rem is an exact
    # multiple of the unit and the quotient is truncated toward zero.
    return ((diff - diff % F.lit(unit_micros)) / F.lit(unit_micros)).cast("long")


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return whole_units_between(start, end, MICROS_PER_DAY)


def hours_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return whole_units_between(start, end, MICROS_PER_HOUR)


def minutes_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return whole_units_between(start, end, MICROS_PER_MINUTE)


def ts_literal(ts: str) -> Column:
    """A wall-clock timestamp literal (timestamp without zone)."""
    return F.lit(ts).cast("timestamp_ntz")


_EPOCH = "1970-01-01 00:00:00"


def wall_clock_to_instant(c: ColumnOrName) -> Column:
    """timestamp_ntz -> timestamp read as UTC, whatever the session time zone."""
    micros = F.timestamp_diff("MICROSECOND", ts_literal(_EPOCH), _c(c))
    return F.timestamp_micros(micros)


def instant_to_wall_clock(c: ColumnOrName) -> Column:
    """timestamp -> its UTC wall clock as timestamp_ntz, whatever the session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(c)), ts_literal(_EPOCH))


def minus_hours(c: ColumnOrName, hours: int) -> Column:
    return _c(c) - F.make_dt_interval(hours=F.lit(hours))


def minus_days(c: ColumnOrName, days: int) -> Column:
    return _c(c) - F.make_dt_interval(days=F.lit(days))


def plus_hours(c: ColumnOrName, hours: int) -> Column:
    return _c(c) + F.make_dt_interval(hours=F.lit(hours))


def expiry_from_creation(c: ColumnOrName, days: int = K.SESSION_LIFETIME_DAYS) -> Column:
    """expires_at = created_at + 365 days."""
    return _c(c) + F.make_dt_interval(days=F.lit(days))


# --------------------------------------------------------------------------
# Small helpers
# --------------------------------------------------------------------------
def ip_status(is_banned: ColumnOrName, banned_until: ColumnOrName,
              violations: ColumnOrName, now: Column,
              warning_at: int = K.SUSPICIOUS_WARNING_VIOLATIONS) -> Column:
    """BANNED / WARNING / NORMAL, as the suspicious-ip view states it."""
    return (F.when(_c(is_banned) & (_c(banned_until) > now), F.lit("BANNED"))
            .when(_c(violations) >= warning_at, F.lit("WARNING"))
            .otherwise(F.lit("NORMAL")))


def json_object(**fields: ColumnOrName) -> Column:
    """a compact JSON object from named columns (key order kept, nulls as null)."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def json_text(c: ColumnOrName) -> Column:
    """A text as a JSON string with its quotes and escapes; null as ``null``."""
    whole = json_object(v=_c(c).cast("string"))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def is_valid_json(c: ColumnOrName) -> Column:
    """null or parseable JSON."""
    c = _c(c)
    return c.isNull() | F.try_parse_json(c).isNotNull()


def floor_zero_decrement(c: ColumnOrName) -> Column:
    """x - 1, never below zero."""
    return F.greatest(_c(c) - 1, F.lit(0))


def window_dates(target: ColumnOrName, window_size: ColumnOrName) -> Column:
    """the days target +/- (size // 2); empty for negative sizes.

    Use with ``explode``.  Python floor division is reproduced with ``floor``;
    negative sizes give an empty array because ``sequence`` would otherwise
    count backwards.
    """
    half = F.floor(_c(window_size) / 2).cast("int")
    days = F.sequence(F.date_sub(_c(target), half), F.date_add(_c(target), half))
    return F.when(_c(window_size) >= 0, days).otherwise(F.array().cast("array<date>"))


def bytes_to_mb(c: ColumnOrName) -> Column:
    """F25."""
    return _c(c) / F.lit(BYTES_PER_MB)


def is_na_token(c: ColumnOrName) -> Column:
    """null, or text a pandas CSV reader treats as missing."""
    c = _c(c)
    return c.isNull() | F.trim(c).isin(*K.NA_TOKENS)


def clean_header(name: str) -> str:
    """Strip, then blanks to underscores."""
    return name.strip().replace(" ", "_")
