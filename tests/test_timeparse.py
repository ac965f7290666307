from datetime import UTC, datetime

from tidemark.operators.timeparse import normalise_timestamps, readings_of

LOW, HIGH = 0, 1 << 62
us = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


def one(text, zone="UTC"):
    r = readings_of(text, zone, us(2022, 1, 1), us(2028, 1, 1))
    return r[0][1] if len(r) == 1 else r


def test_notations():
    t = us(2024, 3, 5, 14, 7, 9)
    for text in ["2024-03-05T14:07:09Z", ' "2024-03-05 14:07:09 UTC"\n', "20240305T140709Z", "2024-065T14:07:09Z", "5 Mar 2024 14:07:09",
                 "Tue, 05 Mar 2024 14:07:09 GMT", "Mar 5, 2024 2:07:09 PM UTC", "2024-03-05T15:07:09+01:00[Europe/Berlin]",
                 "2024-03-05T09:07:09-05", "2024-03-05 09:07:09 America/New_York",
                 str(t // 10**6), str(t // 1000), str(t), f"{t}123", hex(t // 10**6)]:
        assert one(text) == t, text
    assert one("2024-03-05 14:07:09,123456789Z") == t + 123456 and one("1709647629.5") == t + 500_000


def test_impossible_texts():
    for text in [None, "", "--", "T", "25:61:00", "0000-00-00 00:00:00", "2024-02-30 11:20:00Z", "2023-366T00:00:00Z", "13:00:00 PM",
                 "2024-01-01 13:00:00 PM", "2024-01-01 00:00:00 XYZ", "2024-01-01 00:00:00 No/Where", "99999999999999999999",
                 "2024-01-01 24:00:00Z", "2024-01-01 10:60:00Z", "13 Foo 2024 10:00:00"]:
        assert one(text) == [], text
    assert one("2024-03-10 02:30:00", "America/New_York") == []  # skipped
    assert one("2024-11-03 01:30:00", "America/New_York") == us(2024, 11, 3, 5, 30)  # first pass
    assert one("2024-11-03 01:30:00 EST", "America/New_York") == us(2024, 11, 3, 6, 30)
    assert one("2024-01-01 00:00:00", None) == []


def test_abbreviations_are_those_of_the_own_zone():
    t = us(2024, 3, 5, 14, 7, 9)
    for text, zone, hours in [("CST", "Asia/Shanghai", 8), ("CST", "America/Chicago", -6), ("IST", "Asia/Kolkata", 5.5), ("IST", "Asia/Jerusalem", 2),
                              ("CET", "Europe/Berlin", 1), ("jst", "Asia/Tokyo", 9), ("GMT", "Asia/Tokyo", 0), ("Z", None, 0)]:
        assert one(f"2024-03-05 14:07:09 {text}", zone) == t - hours * 3_600_000_000, (text, zone)
    assert one("2024-07-05 14:07:09 IST", "Europe/Dublin") == us(2024, 7, 5, 13, 7, 9)
    for text, zone in [("BST", "Asia/Dhaka"), ("CST", "Europe/Berlin"), ("EST", None), ("CEST", "Europe/Berlin"), ("EST", "UTC"), ("IST", "Europe/Dublin")]:
        assert one(f"2024-03-05 14:07:09 {text}", zone) == [], (text, zone)  # no such name there, or not in winter
    assert one("2024-10-27 02:30:00 CEST", "Europe/Berlin") == us(2024, 10, 27, 0, 30)
    assert one("2024-10-27 02:30:00 CET", "Europe/Berlin") == us(2024, 10, 27, 1, 30)
    assert one("2024-10-27 02:30:00", "Europe/Berlin") == us(2024, 10, 27, 0, 30)


def test_range_is_for_epoch_numbers_only(spark):
    assert one("1999-12-31T23:59:59Z") == us(1999, 12, 31, 23, 59, 59) and one("946684799") == []
    df = spark.createDataFrame([(1, "a", "1999-12-31T23:59:59Z"), (2, "a", "2024-01-01T00:00:00Z")], "id int, venue string, timestamp_raw string")
    out = normalise_timestamps(df, spark.createDataFrame([("a", "UTC", None)], "venue string, zone_name string, date_order string"))
    assert {r.id: (r.time_status, r.utc_micros) for r in out.collect()} == {1: ("outside", us(1999, 12, 31, 23, 59, 59)), 2: ("ok", us(2024, 1, 1))}


def test_each_text_is_read_once(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01T00:00:00Z")], "id int, venue string, timestamp_raw string")
    out = normalise_timestamps(df, spark.createDataFrame([("a", "UTC", None)], "venue string, zone_name string, date_order string"))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()  # only the written readings


def test_sources_decide_the_order_of_dates(spark):
    rows = [(i, "d", f"{d:02}/0{1 + i % 9}/2024 10:00:00") for i, d in enumerate([13, 20, 31, 5, 6])]
    rows += [(10, "m", "03/25/2024 1:00:00 AM"), (11, "m", "03/04/2024 01:00:00"), (12, "m", "05/05/2024 01:00:00")]
    rows += [(20, "u", "03/04/2024 01:00:00"), (21, None, "2024-01-01T00:00:00Z"), (22, "p", "03/04/2024 00:00:00"), (22, "p", None)]
    df = spark.createDataFrame(rows, "id int, venue string, timestamp_raw string").selectExpr("*", "'x' as zone_name")
    src = spark.createDataFrame([("d", "UTC", None), ("m", "UTC", None), ("u", "UTC", None), ("p", "UTC", "dmy")], "venue string, zone_name string, date_order string")
    out = normalise_timestamps(df, src).collect()
    assert len(out) == len(rows) and out[0].zone_name == "x"
    by = {r.id: r for r in out if r.timestamp_raw}
    assert by[3].utc_micros == us(2024, 4, 5, 10) and by[3].time_format == "dmy"
    assert by[11].utc_micros == us(2024, 3, 4, 1) and by[12].time_status == "ok"
    assert by[20].time_status == "ambiguous" and by[20].utc_micros is None and abs(by[20].time_certainty - 0.5) < 1e-9
    assert by[21].time_status == "ok" and by[22].utc_micros == us(2024, 4, 3)
    assert [r.time_status for r in out if r.timestamp_raw is None] == ["unreadable"]
    assert normalise_timestamps(df.limit(0), src).count() == 0
