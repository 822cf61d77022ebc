"""Entity codes (M1), last record (A13), features (M2)."""

import datetime as dt

from shiftspark.operators import features as FE


def test_codes_follow_code_point_order(spark):
    ids = ["10", "9", "B", "a", "é", "z", "Z"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.id_encoded for r in FE.id_index(df).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == ["10", "9", "B", "Z", "a", "z", "é"]


def test_codes_dense_over_many_partitions(spark):
    df = spark.range(0, 5000).selectExpr("cast(id * 7919 % 100003 as string) as id")
    got = FE.id_index(df, num_partitions=13).collect()
    expect = sorted({r.id for r in df.collect()})
    assert sorted((r.id_encoded, r.id) for r in got) == list(enumerate(expect))


def test_last_record_wins(spark):
    d = dt.date(2025, 1, 1)
    df = spark.createDataFrame([("1", d, 1.0, 2.0, 5), ("1", d, 3.0, 4.0, 9), ("1", d, 5.0, 6.0, 7)],
                               "id string, date date, start_time_by_minutes double, "
                               "end_time_by_minutes double, row_seq long")
    r = FE.last_record(df).collect()
    assert [(x.start_time_by_minutes, x.end_time_by_minutes) for x in r] == [(3.0, 4.0)]
