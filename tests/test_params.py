from datetime import datetime, timezone

import pytest

from quillmeter.plans import params as P


def test_automatic_buckets():
    for span, label in ((3600, "5m"), (36000, "1h"), (7 * 86400, "12h"), (10 * 86400, "1d"), (5, "1s"), (300 * 86400, "30d")):
        assert P.automatic_bucket(span).label == label


def test_bucket_texts():
    assert P.parse_bucket("15s", 1).seconds == 15
    assert P.parse_bucket("60s", 1).label == "1m" and P.parse_bucket("24h", 1).follows_time_zone
    assert P.parse_bucket("+3d", 1).seconds == 3 * 86400
    assert P.parse_bucket("1mo", 1).seconds is None and P.parse_bucket("30d", 1).label == "30d"
    for bad in ("0m", "秒", "721d", "1.5h", "h"):
        with pytest.raises(P.InvalidQuery):
            P.parse_bucket(bad, 1)


def test_ranges():
    q = P.resolve_query(1000)
    assert (q.begin, q.end) == (1000 - 86400, 1000)
    for begin, end in ((5, 5), (6, 5), (0, 721 * 86400)):
        with pytest.raises(P.InvalidQuery):
            P.resolve_query(0, begin, end)
    with pytest.raises(P.InvalidQuery):
        P.resolve_query(0, 0, 30_000, "1s")
    with pytest.raises(P.InvalidQuery):
        P.resolve_query(0, 0, 10, offset_minutes=841)
    assert P.resolve_query(0, 0, 720 * 86400).bucket.label == "30d"


def test_filters_are_trimmed_and_bounded():
    q = P.resolve_query(0, 0, 10, model="  m ", node_id=" ")
    assert q.filters == {"model": "m"}
    with pytest.raises(P.InvalidQuery):
        P.clean_filter("é" * 65)


def test_daily_defaults_to_365_local_days():
    q = P.resolve_daily(1_700_000_000, offset_minutes=480)
    assert (q.end - q.begin) == 365 * 86400 and (q.end + 480 * 60) % 86400 == 0 and q.end > 1_700_000_000
    assert P.resolve_daily(-5).end == 0


def test_pages():
    assert P.page_limit(None) == 50
    for bad in (0, 201):
        with pytest.raises(P.InvalidQuery):
            P.page_limit(bad)
    assert P.page_cursor(None, None) is None and P.page_cursor(3, " x ") == (3, "x")
    for bad in ((3, "  "), (3, None), (None, "x")):
        with pytest.raises(P.InvalidQuery):
            P.page_cursor(*bad)


def test_presets():
    now = datetime(2024, 2, 29, 15, 30, tzinfo=timezone.utc)
    at = lambda *d: int(datetime(*d, tzinfo=timezone.utc).timestamp())
    assert P.resolve_preset("today", now)[0] == at(2024, 2, 29)
    assert P.resolve_preset("7d", now)[0] == at(2024, 2, 23)
    assert P.resolve_preset("1y", now)[0] == at(2023, 2, 28)
    assert P.resolve_preset("1h", now) == (at(2024, 2, 29, 14, 30), at(2024, 2, 29, 15, 30))
