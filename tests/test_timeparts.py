"""Truth tables for the scalar functions (FIXTURES.md section 3)."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiftspark.functions import timeparts as T


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


TIMES = [("08:30", 510.0), (" 8:30", 510.0), ("8:30 ", 510.0), ("-1:30", -30.0),
         ("+8:30", 510.0), ("99:99", 6039.0), ("123:4", 7384.0), ("08:-5", 475.0),
         ("8:30", 0.0), ("08:30:00", 0.0), ("8:3:0", 0.0), (":0830", 0.0),
         ("12:3a", 0.0), (None, 0.0), ("1_0:5", 0.0)]


def test_time_to_minutes(spark):
    got = one_col(spark, [t for t, _ in TIMES], T.time_to_minutes)
    assert got == [m for _, m in TIMES]


def test_minutes_to_time(spark):
    vals = [0.0, -5.0, 479.5, 480.5, 2.5, 6039.0, 510.0, float("nan"), 1e300, None]
    got = one_col(spark, vals, T.minutes_to_time, "double")
    assert got == ["00:00", "00:00", "08:00", "08:00", "00:02", "100:39", "08:30", None, None, None]


@settings(max_examples=1, deadline=None)
@given(st.just(None))
def test_round_trip_whole_minutes(spark, _):
    df = spark.range(1, 1440).select(F.col("id").cast("double").alias("m"))
    back = df.select("m", T.time_to_minutes(T.minutes_to_time("m")).alias("b"))
    assert back.where(F.col("m") != F.col("b")).count() == 0


ISO = [("2025-01-15", dt.date(2025, 1, 15)), ("2025-1-5", dt.date(2025, 1, 5)),
       ("20250115", None), (" 2025-01-15", None), ("2025-01-15 ", None),
       ("2025-01-15 08:00", None), ("2025-01", None), ("2025-02-30", None),
       ("15/01/2025", None)]
DMY = [("15/01/2025", dt.date(2025, 1, 15)), ("5/1/2025", dt.date(2025, 1, 5)),
       ("15/01/25", None), ("31/02/2025", None), (" 15/01/2025", None),
       ("15-01-2025", None)]


@pytest.mark.parametrize("fmt,cases", [("yyyy-M-d", ISO), ("d/M/yyyy", DMY)])
def test_parse_date(spark, fmt, cases):
    got = one_col(spark, [v for v, _ in cases], lambda c: T.parse_date(c, fmt))
    assert got == [d for _, d in cases]


def test_week_of_month_cases(spark):
    days = ["2025-01-05", "2025-01-06", "2025-06-01", "2025-06-02", "2025-06-30"]
    got = one_col(spark, days, lambda c: T.week_of_month(c.cast("date")))
    assert got == [0, 1, 0, 1, 5]


def _wom(d: dt.date) -> int:
    return int(math.ceil((d.day + d.replace(day=1).weekday()) / 7.0)) - 1


def test_calendar_features_match_python(spark):
    start = dt.date(2020, 12, 20)
    days = [start + dt.timedelta(days=i) for i in range((dt.date(2026, 1, 10) - start).days + 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select("d", T.day_of_week("d"), T.day_of_year("d"), T.iso_week("d"),
                     T.month("d"), T.week_of_month("d"), T.weekday_name("d")).collect()
    names = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    for d, wd, yd, wk, mo, wm, nm in rows:
        assert (wd, yd, wk, mo, wm, nm) == (d.weekday(), d.timetuple().tm_yday,
                                            d.isocalendar()[1], d.month, _wom(d), names[d.weekday()])


def test_window_dates(spark):
    df = spark.createDataFrame([(s,) for s in [31, 30, 1, 0, -1, -2]], "s int")
    got = [r[0] for r in df.select(F.size(T.window_dates(F.lit(dt.date(2024, 1, 25)), "s"))).collect()]
    assert got == [31, 31, 1, 1, 0, 0]


def test_whole_units_truncate_toward_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 2, 23, 0)),
                                (dt.datetime(2024, 1, 2, 23, 0), dt.datetime(2024, 1, 1, 0, 0))],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [tuple(r) for r in df.select(T.days_between("a", "b"), T.hours_between("a", "b")).collect()]
    assert got == [(1, 47), (-1, -47)]


def test_json_validity_and_status(spark):
    got = one_col(spark, ['{"a":1}', "{'a': 1}", None, "[1,2]", "x"], T.is_valid_json)
    assert got == [True, False, True, True, False]


def test_date_features_pair(spark):
    """(weekday Monday=0, day of year) as one struct."""
    df = spark.createDataFrame([(dt.date(2024, 12, 31),), (dt.date(2025, 1, 6),)], "d date")
    got = [tuple(r[0]) for r in df.select(T.date_features("d")).collect()]
    assert got == [(1, 366), (0, 6)]
