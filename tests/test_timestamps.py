from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from lakepost.functions.timestamps import days_from_civil, mask, normalise_timestamps, parse_instants, wall_to_utc


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


def one(value, zone="Europe/Warsaw", order="dmy"):
    got = parse_instants(pd.Series([value]), pd.Series([zone]), pd.Series([order]))[0]
    return None if pd.isna(got) else int(got)


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2024-09-27T00:43:28", us(2024, 9, 26, 22, 43, 28)),
        ("2025-08-24T12:10:15+02:00", us(2025, 8, 24, 10, 10, 15)),
        ("2024-11-04T21:04:07.470Z", us(2024, 11, 4, 21, 4, 7) + 470_000),
        ("2022-04-02T00:40:25.7807904+00:00", us(2022, 4, 2, 0, 40, 25) + 780_790),
        ("20230914T125445Z", us(2023, 9, 14, 12, 54, 45)),
        ("Tue, 05 Apr 2022 02:39:17 BST", us(2022, 4, 5, 1, 39, 17)),
        ("Thu, 14 Apr 2022 04:52:16 +0200 (CEST)", us(2022, 4, 14, 2, 52, 16)),
        ("11 sie 2022 03:28", us(2022, 8, 11, 1, 28)),
        ("Feb 27, 2026 18:23:23", us(2026, 2, 27, 17, 23, 23)),
        ("29-01-26 04.07", us(2026, 1, 29, 3, 7)),
        ("1660747256", 1660747256 * 1_000_000),
        ("1699132899518", 1699132899518 * 1000),
        ("1664470882442497", 1664470882442497),
        ("134077840159526309", 134077840159526309 // 10 - 11_644_473_600_000_000),
        ("/Date(1687657903905+0530)/", 1687657903905 * 1000),
        ("2024-05-09 14:29:45 America/New_York", us(2024, 5, 9, 18, 29, 45)),
        ("2025-04-09 06:48:35[America/New_York]", us(2025, 4, 9, 10, 48, 35)),
        ("2024-04-07 02:11 UTC+5:30", us(2024, 4, 6, 20, 41)),
        ("26.10.2025 02:30", us(2025, 10, 26, 0, 30)),  # occurs twice: the earlier
        ("27.03.2022 02:12", us(2022, 3, 27, 1, 12)),  # never occurs: moved by the gap
        ("31.02.2024 10:00", None), ("n/a", None), ("-1", None), ("", None), (None, None), ("0000-00-00 00:00:00", None), ("x" * 10_000, None),
    ],
)
def test_notations(value, expected):
    assert one(value) == expected


def test_month_first_and_half_days():
    assert one("4/16/2022 3:12 AM", "America/New_York", "mdy") == us(2022, 4, 16, 7, 12)
    assert one("1/19/2022 12:54 PM", "America/New_York", "mdy") == us(2022, 1, 19, 17, 54)
    assert one("04/05/2022 01:00:00", "Europe/London", "dmy") == us(2022, 5, 4, 0, 0)
    assert mask("Tue, 05 Apr 2022") == "A, 99 A 9999"


def test_wall_time_against_the_zone_library():
    zone = "America/New_York"
    t0 = datetime(2023, 1, 1)
    for k in range(0, 2 * 365 * 24, 7):
        wall = t0 + timedelta(hours=k)
        expected = wall.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
        got, known = wall_to_utc(np.array([int(wall.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000]), zone)
        assert known and got[0] == int(expected.timestamp()) * 1_000_000


def test_civil_days():
    y = np.array([1970, 2000, 2024, 1999])
    assert list(days_from_civil(y, np.array([1, 3, 2, 12]), np.array([1, 1, 29, 31]))) == [(datetime(a, b, c) - datetime(1970, 1, 1)).days for a, b, c in ((1970, 1, 1), (2000, 3, 1), (2024, 2, 29), (1999, 12, 31))]


def test_table_form(spark, collected):
    mails = spark.createDataFrame([("a", "s", "2024-01-01 00:00:00", "1660747256", 1), ("a", "s", "2024-01-01 00:00:00", "1660747256", 2), ("b", "?", "01.02.2024 10:00", None, 3)], "entry_id string, store_id string, received string, sent string, value int")
    stores = spark.createDataFrame([("s", "Europe/Warsaw", "dmy")], "store_id string, zone_name string, date_order string")
    got = normalise_timestamps(mails, ["received", "sent"], "entry_id", stores)
    assert collected(got) == [("a", "sent", 1660747256000000)]
    assert normalise_timestamps(mails.limit(0), ["received"], "entry_id", stores).count() == 0


def test_order_of_rows_plays_no_part():
    v = ["2024-01-01 10:00 unknown", "2024-01-01 10:00 CET", "Mon, 5 Feb 2024 10:00:00 GMT", "xyz, 5 abc 2024 10:00:00 GMT"]
    z, o = pd.Series(["Europe/Warsaw"] * 4), pd.Series(["dmy"] * 4)
    one = dict(zip(v, parse_instants(pd.Series(v), z, o)))
    two = dict(zip(v[::-1], parse_instants(pd.Series(v[::-1]), z, o)))
    assert {k: None if pd.isna(x) else int(x) for k, x in one.items()} == {k: None if pd.isna(x) else int(x) for k, x in two.items()}
    assert not pd.isna(one[v[1]]) and pd.isna(one[v[0]]) and not pd.isna(one[v[2]])


def test_times_beyond_the_tables():
    v = ["1700-01-01 12:00", "2300-07-01 12:00", "2300-01-01 12:00", "2024-07-01 12:00"]
    got = parse_instants(pd.Series(v), pd.Series(["Europe/Berlin"] * 4), pd.Series(["dmy"] * 4))
    hours = [(datetime(int(t[:4]), int(t[5:7]), 1, 12) - datetime(1970, 1, 1)).total_seconds() - int(x) / 1e6 for t, x in zip(v, got)]
    assert hours[1] == 7200 and hours[2] == 3600 and hours[3] == 7200 and 0 < hours[0] < 3600
