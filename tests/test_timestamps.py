import datetime as dt
import io
from zoneinfo import ZoneInfo

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from boardwright.functions.zones import ZoneTables, zone_bytes
from boardwright.operators import timestamps as T

CASES = [
    ("2026-03-08T02:30:00", "America/New_York", "mdy", "2026-03-08T07:30:00"),  # skipped: moved forward by an hour
    ("2025-11-02T01:30:00", "America/New_York", "mdy", "2025-11-02T05:30:00"),  # twice: the first
    ("03/04/2026", "Europe/London", "dmy", "2026-04-02T23:00:00"),
    ("03/04/2026", "America/Chicago", "mdy", "2026-03-04T06:00:00"),
    ("31/11/2025 10:00", "Europe/Berlin", "dmy", None),
    ("2026-02-29", "UTC", "ymd", None),
    ("2024-02-29", "UTC", "ymd", "2024-02-29T00:00:00"),
    ("Mar 5, 2026 12:05 AM PST", "UTC", "ymd", "2026-03-05T08:05:00"),
    ("13. Oktober 2025, 10:42 Uhr", "Europe/Berlin", "dmy", "2025-10-13T08:42:00"),
    ("1700000000123", "Asia/Tokyo", "ymd", "2023-11-14T22:13:20.123000"),
    ("20260528T120225Z", "Asia/Tokyo", "ymd", "2026-05-28T12:02:25"),
    ("2026-01-01 10:00 America/Chicago", "UTC", "ymd", "2026-01-01T16:00:00"),
    ("2026-01-01T10:00:00[UTC]", "Asia/Tokyo", "ymd", "2026-01-01T10:00:00"),
    ("Wed, 27 Aug 2025 16:10:29 +0530", "UTC", "ymd", "2025-08-27T10:40:29"),
    ("22 days ago", "UTC", "ymd", None), ("yesterday", "UTC", "ymd", None), ("", "UTC", "ymd", None), (None, "UTC", "ymd", None), ("2026-06", "UTC", "ymd", None), ("9" * 5000, "UTC", "ymd", None), ("  2026-01-02  ", "UTC", "ymd", "2026-01-02T00:00:00"), ("2026-01-02", "Nowhere/City", "ymd", None), ("2026-01-02", None, None, None),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, *c[:3], "clash") for i, c in enumerate(CASES)], "i int, posted string, z string, o string, utc_us string")
    got = {r.i: r.utc_us for r in T.normalise_timestamps(df, "posted", "z", "o", ["i"]).collect()}
    for i, c in enumerate(CASES):
        want = None if c[3] is None else round(dt.datetime.fromisoformat(c[3]).replace(tzinfo=dt.UTC).timestamp() * 1e6)
        assert got[i] == want, c


def test_no_rows(spark):
    assert T.normalise_timestamps(spark.createDataFrame([], "posted string, z string, o string"), "posted", "z", "o", ["posted"]).count() == 0


TABLES = ZoneTables(zone_bytes()[1])


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "America/Phoenix", "Africa/Casablanca"]), st.integers(0, 4_000_000_000))
def test_tables_agree_with_the_library(zone, second):
    local = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=second)
    same_version = ZoneInfo.from_file(io.BytesIO(TABLES.zones[zone]))
    want = local.replace(tzinfo=same_version, fold=0).utcoffset().total_seconds()
    assert TABLES.get(zone).offset_of_local(np.array([second]))[0] == want
