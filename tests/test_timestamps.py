from datetime import datetime, timezone

import pytest

from newsloom.operators.timestamps import normalise_instants

US = 1_000_000


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * US


CASES = [
    ("2025-09-01T18:43:56.184+0200", "Europe/Paris", "dmy", us(2025, 9, 1, 16, 43, 56) + 184000),
    ("2025-09-01T15:28:16.146157569Z", "Asia/Tokyo", "dmy", us(2025, 9, 1, 15, 28, 16) + 146157),
    ("2025-09-01T01:24:17+02:00[Europe/Berlin]", None, None, us(2025, 8, 31, 23, 24, 17)),
    ("20250901T191117Z", "Asia/Tokyo", "dmy", us(2025, 9, 1, 19, 11, 17)),
    ("2025-09-03", "Asia/Kolkata", "dmy", us(2025, 9, 2, 18, 30)),
    ("Tue, 02 Sep 2025 17:48:08 GMT", "Asia/Tokyo", "dmy", us(2025, 9, 2, 17, 48, 8)),
    ("Mon, 1 Sep 2025 19:23:55 CST", "Asia/Shanghai", "dmy", us(2025, 9, 1, 11, 23, 55)),
    ("Mon, 1 Dec 2025 19:23:55 CST", "America/Chicago", "mdy", us(2025, 12, 2, 1, 23, 55)),
    ("Mon, 1 Sep 2025 19:23:55 EDT", "Asia/Tokyo", "dmy", us(2025, 9, 1, 23, 23, 55)),
    ("2025-09-02 11:22:39.651507+01", "x", "dmy", us(2025, 9, 2, 10, 22, 39) + 651507),
    ("2025-11-02 01:08:00 America/Chicago", None, None, us(2025, 11, 2, 6, 8)),
    ("08/09/2025 20:14", "Europe/London", "dmy", us(2025, 9, 8, 19, 14)),
    ("08/09/2025 20:14", "America/New_York", "mdy", us(2025, 8, 10, 0, 14)),
    ("2.9.2025 17:14:54", "Europe/Berlin", "dmy", us(2025, 9, 2, 15, 14, 54)),
    ("September 1, 2025 12:07 a.m.", "America/New_York", "mdy", us(2025, 9, 1, 4, 7)),
    ("Sep 2, 2025 12:08 PM", "Europe/London", "dmy", us(2025, 9, 2, 11, 8)),
    ("1 de septiembre de 2025, 10:59", "Europe/Madrid", "dmy", us(2025, 9, 1, 8, 59)),
    ("29. März 2026, 03:28 Uhr", "Europe/Berlin", "dmy", us(2026, 3, 29, 1, 28)),
    ("9 сентября 2025 г., 10:45", "Europe/Moscow", "dmy", us(2025, 9, 9, 7, 45)),
    ("2025年9月5日4時42分", "Asia/Tokyo", "dmy", us(2025, 9, 4, 19, 42)),
    ("Wed Sep 10 00:10:03 2025", "Asia/Kolkata", "dmy", us(2025, 9, 9, 18, 40, 3)),
    ("3 Sep 25 21:32 +0100", "x", "dmy", us(2025, 9, 3, 20, 32)),
    (" \t1756762615\n", None, None, 1756762615 * US),
    ("1756703883540", None, None, 1756703883540 * 1000),
    # a repeated hour is its first occurrence, a skipped one keeps the offset before the change
    ("2025-10-26 02:30", "Europe/Berlin", "dmy", us(2025, 10, 26, 0, 30)),
    ("2026-03-29 02:30", "Europe/Berlin", "dmy", us(2026, 3, 29, 1, 30)),
    ("31/02/2026 10:00", "Europe/Berlin", "dmy", None), ("0000-00-00 00:00:00", "Europe/Berlin", "dmy", None), ("yesterday", "Europe/Berlin", "dmy", None),
    ("2 hours ago", "Europe/Berlin", "dmy", None), ("", "Europe/Berlin", "dmy", None), (None, "Europe/Berlin", "dmy", None), ("2025-09-03 10:00", None, "dmy", None),
    ("2025-09-03 25:00", "Europe/Berlin", "dmy", None), ("x" * 50_000, "Europe/Berlin", "dmy", None), ("2024-02-29", "UTC", "dmy", us(2024, 2, 29)), ("2023-02-29", "UTC", "dmy", None),
]


def test_formats_zones_and_changes(spark):
    rows = [(k, *c) for k, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, text string, zone string, order string, wanted long")
    out = normalise_instants(df, "text", "zone", "order").collect()
    assert len(out) == len(CASES)
    assert [(r["text"], r["zone"], r["published_us"]) for r in out if r["published_us"] != r["wanted"]] == []


@pytest.mark.parametrize("rows", [[], [(1, "2025-09-03", "UTC", "dmy", 7)] * 3])
def test_empty_repeated_and_clashing_columns(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, zone string, order string, published_us long")
    out = normalise_instants(df, "text", "zone", "order")
    assert out.columns == ["id", "text", "zone", "order", "published_us"]
    assert [r["published_us"] for r in out.collect()] == [us(2025, 9, 3)] * len(rows)
