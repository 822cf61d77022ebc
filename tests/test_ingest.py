"""CSV layouts (S1-S4, P1-P4, Q1-Q5, Q22) and the schedule store."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shiftspark.sources import csv_ingest as C
from shiftspark.sources import store


def write(tmp_dir, name, text):
    path = os.path.join(tmp_dir, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def rows(df):
    return sorted((r.id, r.date, r.start_time_by_minutes, r.end_time_by_minutes)
                  for r in df.collect())


BODY = [("1", "2025-01-15", "08:30", "17:00"), ("2", "2025-01-16", "09:00", "18:15")]
EXPECTED = [("1", dt.date(2025, 1, 15), 510.0, 1020.0), ("2", dt.date(2025, 1, 16), 540.0, 1095.0)]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_each_separator(spark, tmp_dir, sep):
    text = sep.join(["ID", "Date", "Start Time", "End Time"]) + "\n"
    text += "".join(sep.join(r) + "\n" for r in BODY)
    path = write(tmp_dir, "up.csv", text)
    assert rows(C.load_schedule_csv(spark, path)) == EXPECTED


def test_header_blanks_are_cleaned(spark, tmp_dir):
    text = " ID ;Date;Start Time;End Time\n" + "".join(";".join(r) + "\n" for r in BODY)
    path = write(tmp_dir, "up.csv", text)
    assert rows(C.load_schedule_csv(spark, path)) == EXPECTED


def test_custom_mapping(spark, tmp_dir):
    text = "who,day,in,out,extra\n1,15/01/2025,08:30,17:00,x\n"
    path = write(tmp_dir, "up.csv", text)
    m = C.ColumnMapping(id="who", date="day", start_time="in", end_time="out")
    assert rows(C.load_schedule_csv(spark, path, m)) == [EXPECTED[0]]


def test_three_columns_is_an_error(spark, tmp_dir):
    path = write(tmp_dir, "up.csv", "ID,Date,Start Time\n1,2025-01-15,08:30\n")
    with pytest.raises(C.InvalidCsvError, match="End_Time"):
        C.load_schedule_csv(spark, path)


def test_missing_column_is_named(spark, tmp_dir):
    path = write(tmp_dir, "up.csv", "ID,Day,Start Time,End Time\n1,2025-01-15,08:30,17:00\n")
    with pytest.raises(C.InvalidCsvError, match="missing columns: Date"):
        C.load_schedule_csv(spark, path)


def test_header_only_is_an_error(spark, tmp_dir):
    path = write(tmp_dir, "up.csv", "ID,Date,Start Time,End Time\n")
    with pytest.raises(C.InvalidCsvError):
        C.load_schedule_csv(spark, path)


def test_all_rows_invalid_is_an_error(spark, tmp_dir):
    path = write(tmp_dir, "up.csv", "ID,Date,Start Time,End Time\n1,2025-01-15,00:00,17:00\n")
    with pytest.raises(C.InvalidCsvError):
        C.load_schedule_csv(spark, path)


def test_no_date_format_is_an_error(spark, tmp_dir):
    path = write(tmp_dir, "up.csv", "ID,Date,Start Time,End Time\n1,15-01-2025,08:00,17:00\n")
    with pytest.raises(C.InvalidCsvError, match="supported formats"):
        C.load_schedule_csv(spark, path)
    # Lazily, such a file has no row with a date.
    assert C.load_schedule_csv(spark, path, validate=False).count() == 0


def test_date_format_check_stops_early(spark, tmp_dir):
    raw = C.read_raw_csv(spark, write(tmp_dir, "up.csv", "ID,Date,Start Time,End Time\n"
                                      "1,2025-01-15,08:00,17:00\n"))
    plan = C.clean_schedule(raw)._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" in plan or "Limit" in plan


def test_row_filters_and_ids(spark, tmp_dir):
    text = ("ID,Date,Start Time,End Time\n"
            ",2025-01-15,08:00,17:00\n"          # empty id: dropped
            "NA,2025-01-15,08:00,17:00\n"        # NA token: dropped
            "007,2025-01-15,08:00,17:00\n"       # kept as text
            "3,2025-01-15,00:00,17:00\n"         # midnight start: dropped
            "4,2025-01-15,18:00,07:00\n"         # overnight: dropped
            "5,2025-01-15,8:00,17:00\n"          # 4-char time -> 0: dropped
            "6,15/01/2025,08:00,17:00\n")        # other format than the file's: dropped
    path = write(tmp_dir, "up.csv", text)
    got = rows(C.load_schedule_csv(spark, path))
    assert got == [("007", dt.date(2025, 1, 15), 480.0, 1020.0)]


def test_day_month_year_file(spark, tmp_dir):
    text = "ID;Date;Start Time;End Time\n1;15/01/2025;08:30;17:00\n2;5/1/2025;09:00;18:15\n"
    got = rows(C.load_schedule_csv(spark, write(tmp_dir, "up.csv", text)))
    assert got == [("1", dt.date(2025, 1, 15), 510.0, 1020.0), ("2", dt.date(2025, 1, 5), 540.0, 1095.0)]


def test_row_seq_follows_file_order(spark, tmp_dir):
    text = "ID,Date,Start Time,End Time\n" + "".join(f"1,2025-01-15,08:{i:02d},17:00\n" for i in range(1, 30))
    df = C.load_schedule_csv(spark, write(tmp_dir, "up.csv", text))
    got = [r.start_time_by_minutes for r in df.orderBy("row_seq").collect()]
    assert got == sorted(got)


def test_store_round_trip_and_inventory(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    a = spark.createDataFrame([("1", dt.date(2025, 1, 1), 500.0, 900.0, 1)],
                              "id string, date date, start_time_by_minutes double, "
                              "end_time_by_minutes double, row_seq long")
    b = a.withColumn("id", F.lit("2"))
    store.save_schedule(a, root, "ds_a")
    store.save_schedule(b, root, "ds_b")
    store.save_schedule(b.withColumn("id", F.lit("3")), root, "ds_b")  # replaces ds_b only
    assert [r.id for r in store.read_schedule(spark, root, "ds_a").collect()] == ["1"]
    assert [r.id for r in store.read_schedule(spark, root, "ds_b").collect()] == ["3"]
    sizes = {r.dataset_id: r.bytes for r in store.dataset_sizes(spark, root).collect()}
    assert set(sizes) == {"ds_a", "ds_b"} and all(v > 0 for v in sizes.values())
    assert sorted(r.dataset_id for r in store.list_datasets(spark, root).collect()) == ["ds_a", "ds_b"]


def test_rows_longer_than_header_fail_the_upload(spark, tmp_dir):
    text = "ID;Date;Start Time;End Time\n1;2025-01-15;08:30;17:00\n2;2025-01-15;08:30;17:00;x\n"
    path = write(tmp_dir, "up.csv", text)
    assert C.long_rows(C.read_raw_csv(spark, path)).count() == 1
    with pytest.raises(C.InvalidCsvError, match="more fields than the header, e.g. '2;2025"):
        C.load_schedule_csv(spark, path)
    # Lazy use keeps the readable fields of every row.
    assert len(rows(C.load_schedule_csv(spark, path, validate=False))) == 2


def test_short_rows_are_padded(spark, tmp_dir):
    text = "ID,Date,Start Time,End Time\n1,2025-01-15,08:30,17:00\n2,2025-01-15\n"
    path = write(tmp_dir, "up.csv", text)
    assert C.long_rows(C.read_raw_csv(spark, path)).count() == 0
    assert rows(C.load_schedule_csv(spark, path)) == [("1", dt.date(2025, 1, 15), 510.0, 1020.0)]


def test_header_collision_after_cleaning(spark, tmp_dir):
    path = write(tmp_dir, "up.csv", "ID,Date,Start Time,Start_Time,End Time\n1,2025-01-15,08:30,x,17:00\n")
    with pytest.raises(C.InvalidCsvError, match="collide"):
        C.load_schedule_csv(spark, path)


def test_bucketed_audit_tables_join_without_shuffle(spark):
    from shiftspark.operators import quotas as Q
    from shiftspark.sources.tables import Fixtures
    from conftest import SF_SMALL
    fx = Fixtures(spark, SF_SMALL)
    store.save_bucketed(fx.sessions(), "sessions_b", "session_id", 8)
    store.save_bucketed(fx.security_logs(), "logs_b", "session_id", 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Q.ip_changes(spark.table("logs_b"), spark.table("sessions_b"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert out.count() == Q.ip_changes(fx.security_logs(), fx.sessions()).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_separators_inside_quotes_do_not_make_a_row_long(spark, tmp_dir):
    head = "ID,Date,Start Time,End Time\n"
    path = write(tmp_dir, "short.csv", head + '"a, b, c, d, e",15/01/2025,08:30\n"x ""y"", z",15/01/2025,08:30,17:00\n')
    assert C.long_rows(C.read_raw_csv(spark, path)).count() == 0
    assert len(rows(C.load_schedule_csv(spark, path))) == 1         # the short row has no end
    long_ = write(tmp_dir, "long.csv", head + '"a, b",15/01/2025,08:30,17:00,more\n1,15/01/2025,"08:30",17:00\n')
    assert C.long_rows(C.read_raw_csv(spark, long_)).count() == 1
    with pytest.raises(C.InvalidCsvError, match="more fields"):
        C.load_schedule_csv(spark, long_)
