"""Snapshots shown to requests: validity by the clock, nulls, requests of unknown tickers, an empty table."""

from __future__ import annotations

import datetime as dt

from strikeloom.operators import views as V

SNAP = "ticker string, error string, fetched_at timestamp_ntz, refreshed_at timestamp_ntz, session_date date, valuation_time timestamp_ntz, spot double, source string, rate_session date, quote_time timestamp_ntz, quote_fetched_at timestamp_ntz"
DAY = dt.date(2025, 3, 4)


def at(h, m=0, s=0, day=4):
    return dt.datetime(2025, 3, day, h, m, s)


OPEN = V.Clock("2025-03-04 16:00:00", True, "2025-03-04", "2025-03-03", "2025-03-03 21:00:00")
SHUT = V.Clock("2025-03-04 12:00:00", False, "2025-03-04", "2025-03-03", "2025-03-03 21:00:00")
SNAPS = [
    ("fresh", None, at(15, 50), None, DAY, at(15, 49), 10.0, "f", DAY, at(15, 46), at(15, 47)), ("old", None, at(15, 45), None, DAY, at(15, 44), 10.0, "f", DAY, at(15, 46), at(15, 47)),
    ("failed", "down", at(9), at(15, 55), None, None, None, None, None, None, None), ("closed", None, at(21, 5, day=3), None, dt.date(2025, 3, 3), at(21, 0, day=3), 10.0, "f", DAY, None, None),
    ("early", None, at(20, 5, day=3), None, dt.date(2025, 3, 3), at(20, 59, day=3), 10.0, "f", DAY, None, None), ("ahead", None, at(15, 59), None, DAY, at(15, 58), 10.0, "f", DAY, at(16, 1, 1), at(15, 47)), (None, None, None, None, None, None, None, None, None, None, None),
]


def test_validity(spark):
    df = spark.createDataFrame(SNAPS, SNAP)
    assert {r.ticker for r in df.filter(V.valid(OPEN)).collect()} == {"fresh", "failed", "ahead"}
    assert {r.ticker for r in df.filter(V.valid(SHUT)).collect()} >= {"closed"} and "early" not in {r.ticker for r in df.filter(V.valid(SHUT)).collect()}
    assert [r.ticker for r in V.underlying_quotes(df, OPEN).collect()] == ["fresh"] and V.underlying_quotes(df, SHUT).count() == 0


def test_every_request_has_one_row(spark):
    asked = "id int, ticker string, root string, side string, expiry date, strike double"
    day = dt.date(2025, 4, 17)
    rows = [(1, "fresh", None, "call", day, 5.0), (2, "fresh", "fresh", "put", day, 5.0), (3, "fresh", "X", "call", day, 5.0), (4, "none", None, "call", day, 5.0), (5, "failed", None, "call", day, 5.0), (6, "fresh", None, "call", day, 6.0), (7, "fresh", None, "call", None, 5.0), (8, None, None, None, None, None), (9, "fresh", None, "call", day, 7.0)]
    requests, snaps = spark.createDataFrame(rows, asked), spark.createDataFrame(SNAPS, SNAP)
    expiries = spark.createDataFrame([("old", day, "no")], "ticker string, expiry date, reason string")
    odds = spark.createDataFrame([("fresh", day, 5.0, 0.2504, 0.2, 0.3, None), ("fresh", day, 7.0, None, None, None, "quote_fit_failed")], "ticker string, expiry date, strike double, p double, lower double, upper double, reason string")
    got = {r.id: (r.status, r.reason, r.itm, r.low) for r in V.odds_views(requests, snaps, expiries, odds, OPEN).collect()}
    assert got == {1: ("available", None, 250, 200), 2: ("available", None, 750, 700), 3: ("unavailable", V.TERMS, None, None), 4: ("pending", V.PENDING, None, None), 5: ("unavailable", "down", None, None), 6: ("unavailable", V.ABSENT, None, None), 7: ("unavailable", V.ABSENT, None, None), 8: ("pending", V.PENDING, None, None), 9: ("unavailable", "quote_fit_failed", None, None)}
    assert V.odds_views(requests.limit(0), snaps, expiries, odds, OPEN).count() == 0
    curves = spark.createDataFrame([("fresh", at(15, 50), None)], "ticker string, fitted_at timestamp_ntz, failure string")
    seen = {r.id: (r.status, r.reason, r.one_tick_stable) for r in V.curve_views(requests, snaps, expiries, odds.select("ticker", "expiry", "strike"), curves, odds, OPEN).collect()}
    assert seen[1] == ("available", None, True) and seen[6] == ("unavailable", V.TERMS, None) and seen[9] == ("unavailable", "quote_fit_failed", None) and len(seen) == 9
    late = {r.id: r.reason for r in V.curve_views(requests, snaps, expiries, odds.select("ticker", "expiry", "strike"), curves.limit(0), odds, OPEN).collect()}
    assert late[1] == V.FITTING
