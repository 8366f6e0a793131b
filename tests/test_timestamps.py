from datetime import datetime, timezone

import pytest

from mentionloom.operators.timestamps import normalize_timestamps, parse_timestamp, zone_intervals


def us(*x):
    return int(datetime(*x, tzinfo=timezone.utc).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("value", "order", "want"),
    [
        ("2021-04-15T08:13:56Z", None, (us(2021, 4, 15, 8, 13, 56), 0, None)),
        (" 1537762852379 ", None, (us(2018, 9, 24, 4, 20, 52) + 379_000, 0, None)),
        ("1548254610", None, (us(2019, 1, 23, 14, 43, 30), 0, None)),
        ("20190507T001549Z", None, (us(2019, 5, 7, 0, 15, 49), 0, None)),
        ("Wed, 03 Apr 2019 09:25:33 +0545", None, (us(2019, 4, 3, 9, 25, 33), 20_700_000_000, None)),
        ("08/10/21 20:21", "DMY", (us(2021, 10, 8, 20, 21), None, None)),
        ("03/11/2018 2:47 AM", "MDY", (us(2018, 3, 11, 2, 47), None, None)),
        ("2020/08/07 11:23", "YMD", (us(2020, 8, 7, 11, 23), None, None)),
        ("Jun 29, 2020 1:18 pm CEST", "DMY", (us(2020, 6, 29, 13, 18), None, "CEST")),
        ("December 15, 2018 12:54 AM", "DMY", (us(2018, 12, 15, 0, 54), None, None)),
        ("12. Oktober 2023, 05:43 Uhr", "DMY", (us(2023, 10, 12, 5, 43), None, None)),
        ("27 de octubre de 2019, 02:08", "DMY", (us(2019, 10, 27, 2, 8), None, None)),
        ("24 octobre 2019 à 16h48", "DMY", (us(2019, 10, 24, 16, 48), None, None)),
        ("28 января 2019 г., 05:57", "DMY", (us(2019, 1, 28, 5, 57), None, None)),
        ("2017年6月18日 14:34", "YMD", (us(2017, 6, 18, 14, 34), None, None)),
        ("2019-10-19", None, (us(2019, 10, 19), None, None)),
    ],
)
def test_formats(value, order, want):
    assert parse_timestamp(value, order) == want


@pytest.mark.parametrize("value", [None, "", "  ", "-", "n/a", "yesterday", "2 hours ago", "2019-13-45", "0000-00-00 00:00:00", "31/02/2020", "13:99", "Invalid date", "99/99/9999 10:00", "Jan 5, 2020 13:00 pm"])
def test_unreadable(value):
    assert parse_timestamp(value, "DMY") is None


def test_intervals_cover_time():
    iv = zone_intervals("Europe/Berlin", 2018, 2020)
    assert all(a[1] == b[0] for a, b in zip(iv, iv[1:]))
    assert {x[3] for x in iv} == {"CET", "CEST"}


def test_all_years(spark):
    from zoneinfo import ZoneInfo

    zones = {"b": "Europe/Berlin", "n": "America/New_York", "t": "Asia/Tokyo"}
    sources = spark.createDataFrame([(k, z, "YMD") for k, z in zones.items()], "source_domain string, time_zone string, date_order string")
    years = [*range(1, 1800, 171), 1799, 1800, 1850, 1893, 1916, 1945, 1969, 1970, 2038, 2099, 2100, 2101, 2400, 2498, 2499, 2500, 2501, 2899, 2900, 5000, 9998]
    at = [(y, k, m) for y in years for k in zones for m in (1, 7, 12)]
    rows = [(n, k, f"{y:04d}-{m:02d}-{31 if m == 12 else 1} {'23:30' if m == 12 else '12:00'}") for n, (y, k, m) in enumerate(at)] + [(9000, "b", "9" * 19), (9001, "b", "9" * 12)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "article_id long, source_domain string, date_publish string, date_download string, date_modify string")
    got = {r.article_id: r.utc_us for r in normalize_timestamps(df, sources).collect()}
    for n, (y, k, m) in enumerate(at):
        local = datetime(y, m, 31 if m == 12 else 1, *((23, 30) if m == 12 else (12, 0)))
        want = us(*local.timetuple()[:6]) - int(local.replace(tzinfo=ZoneInfo(zones[k])).utcoffset().total_seconds() * 1_000_000)
        assert got[n] == want, (y, k, m)
    assert 9000 not in got and got[9001] == (10**12 - 1) * 1000


def test_zones(spark):
    sources = spark.createDataFrame([("b", "Europe/Berlin", "DMY"), ("n", "America/New_York", "MDY"), ("k", "Asia/Kathmandu", "DMY")], "source_domain string, time_zone string, date_order string")
    rows = [
        (1, "b", "2019-10-27 02:30:00"),  # twice: the earlier instant
        (2, "b", "2019-03-31 02:30:00"),  # skipped: the offset before
        (3, "b", "2019-10-27 02:30:00 CET"),
        (4, "n", "03/10/2019 2:30 AM"),
        (5, "k", "12/03/2019 01:54"),
        (6, "x", "2019-01-01 00:00:00"),  # unknown site: UTC
        (7, None, "2019-01-01"),
        (8, "b", None),
        (1, "b", "2019-10-27 02:30:00"),
    ]
    df = spark.createDataFrame([(*r, r[2], None, "extra") for r in rows], "article_id long, source_domain string, date_publish string, date_download string, date_modify string, tz string")
    got = {(r.article_id, r.field): r.utc_us for r in normalize_timestamps(df, sources).collect()}
    assert got[1, "date_publish"] == us(2019, 10, 27, 0, 30)
    assert got[2, "date_publish"] == us(2019, 3, 31, 1, 30)
    assert got[3, "date_publish"] == us(2019, 10, 27, 1, 30)
    assert got[4, "date_publish"] == us(2019, 3, 10, 7, 30)
    assert got[5, "date_publish"] == us(2019, 3, 11, 20, 9)
    assert got[6, "date_publish"] == got[7, "date_publish"] == us(2019, 1, 1)
    assert got[1, "date_download"] == us(2019, 10, 27, 2, 30)
    assert not [k for k in got if k[0] == 8] and len(got) == 14
    assert normalize_timestamps(df.limit(0), sources).count() == 0
