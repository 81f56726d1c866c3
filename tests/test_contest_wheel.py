"""Contest reports and wheel capture on small tables: nulls, ties, empty tables, hot keys."""

from __future__ import annotations

import datetime as dt

import pytest

from strikeloom.operators import contest as T
from strikeloom.operators import inference as I
from strikeloom.operators import wheel as H

ROW = "ticker string, origin date, horizon int, contract long, method string, issued timestamp_ntz, seq long, vintage string, crps double, probability double, reason string, itm boolean, side string, moneyness string, prepare_ms double, lookup_ms double"
DAY = dt.date(2025, 1, 2)


def row(contract, method, seq, vintage="v", probability=0.5, itm=True, ticker="A", crps=1.0, side="call", ms=1.0, horizon=5):
    return (ticker, DAY, horizon, contract, method, dt.datetime(2025, 1, 2, 9), seq, vintage, crps, probability, None, itm, side, None, ms, ms)


ROWS = [
    row(1, "base", 1), row(1, "new", 2, probability=1.0), row(1, "new", 3, probability=0.0), row(1, "base", 9, vintage="w"), row(2, "base", 4, probability=None), row(2, "new", 5),
    row(3, "new", 6, ticker="B"), row(3, "new", 7, ticker="B"), row(4, "base", 8, crps=None, side="put"), row(4, "new", 10, probability=0.05, itm=True, side="put", ms=float("nan")), row(5, "new", 11, vintage=None), row(6, "other", 12), row(7, "base", 13, itm=None), row(7, "new", 14, ms=-1.0, horizon=5),
]


def test_attempts_by_hand(spark):
    got = T.attempt_counts(spark.createDataFrame(ROWS, ROW), "base", "new").first().asDict()
    assert got == {"cells_attempted": 5, "orphan_cells": 1, "duplicates_excluded": 1, "baseline_attempted": 4, "baseline_available": 3, "candidate_available": 3, "later_vintages_excluded": 2}
    assert set(T.attempt_counts(spark.createDataFrame([], ROW), "base", "new").first().asDict().values()) == {0}


def test_reports_by_hand(spark):
    df = spark.createDataFrame(ROWS, ROW)
    pairs = I.evaluated(df, "base", "new", ("side", "moneyness"), ("crps",))
    outcome = {(r.ticker, r.contract): r.outcome for r in pairs.collect()}
    assert outcome == {("A", 1): "scored", ("A", 2): "baseline_unavailable", ("B", 3): "baseline_not_issued", ("A", 4): "scored", ("A", 7): "unscorable_or_conflicting_label"}
    bins = {(r.side, r.bin): (r.units, r.forecast, r.observed) for r in T.calibration_by_side(pairs).collect()}
    assert bins == {("call", 9): (1, 1.0, 1.0), ("put", 0): (1, 0.05, 1.0)}
    groups = {(r.category, r.value): (r.units, r.dates, round(r.brier_delta, 6), r.supported) for r in T.subgroups(pairs, ["side", "moneyness"], 1, 1).collect()}
    assert groups == {("side", "call"): (1, 1, -0.25, True), ("side", "put"): (1, 1, 0.6525, True), ("moneyness", None): (1, 1, 0.20125, True)}
    unit = T.unit_scores(pairs).first()
    assert unit.contracts == 2 and unit.crps_candidate == 1.0 and unit.brier_baseline == pytest.approx(0.25)
    times = {r.label: (r.n, r.p50) for r in T.latencies(df, "base", "new").collect()}
    assert times == {"prepare": (1, 1.0), "lookup": (1, 1.0)}
    assert T.calibration_by_side(pairs.limit(0)).count() == 0


def test_candidates_by_hand(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    sessions = spark.createDataFrame([(day(n),) for n in range(12)], "session date")
    bars = [("A", day(n), 100.0 + n, 100.0 + n, 1.0 if n == 9 else None if n == 10 else 0.0) for n in range(12) if n != 7] + [("B", day(0), 50.0, None, 0.0)]
    stocks = spark.createDataFrame(bars, "ticker string, session date, open double, close double, action double")
    base = {"side": "call", "strike": 90.0, "mark": 11.0, "volume": 5, "valid": True, "failed": False, "opening": 11.0}
    days, want = [], {}

    def add(contract, why, start=0, end=4, ticker="A", entry=True, **change):
        r = base | change
        days.append((contract, ticker, r["side"], day(start), day(end), r["strike"], r["mark"], r["volume"], r["valid"], r["failed"], r["opening"]))
        if entry:
            days.append((contract, ticker, r["side"], day(start + 1), day(0), r["strike"], r["mark"], r["volume"], True, False, r["opening"]))
        want[contract] = why

    add(1, None)
    add(2, "decision_missing_verified_stock", ticker="B")
    add(3, "outside_horizons", end=0)
    add(4, "invalid_decision_observation", mark=None)
    add(5, "outside_strict_moneyness", strike=100.0)
    add(6, "opening_moneyness_changed", side="put", strike=100.5)
    add(7, "missing_opening_bucket", entry=False)
    add(8, "missing_verified_stock_open", start=6, end=8)
    add(9, "reconciliation_failure", failed=True)
    add(10, "missing_verified_expiry_close", end=7)
    add(11, "stock_session_missing", end=8)
    add(12, "corporate_action", start=8, end=9)
    add(13, "actions_unknown", start=9, end=11)
    add(14, "invalid_decision_observation", valid=None)
    schema = "contract long, ticker string, side string, session date, expiry date, strike double, mark double, volume long, valid boolean, reconciliation_failed boolean, opening double"
    rows = H.candidates(spark.createDataFrame(days, schema), stocks, sessions).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.session):
        first.setdefault(r.contract, (r.status, r.reason))
    assert {c: r for c, (_, r) in first.items()} == want and first[1][0] == "scored" and len(rows) == len(days)
    assert H.candidates(spark.createDataFrame([], schema), stocks, sessions).count() == 0


def test_descriptives_keep_null_keys_and_weigh_cells_alike(spark):
    schema = "ticker string, side string, panel string, period string, depth_band string, horizon_band string, origin date, expiry date, scored boolean, ret double, time_yield double"
    hot = [("A", "call", "p", None, "d", "h", DAY, DAY, True, 1.0, 2.0)] * 500
    rows = [*hot, ("A", "call", "p", None, "d", "h", DAY, dt.date(2025, 2, 1), True, 3.0, 4.0), ("A", "call", None, "x", "d", "h", DAY, DAY, False, None, 6.0)]
    got = {(r.level, r.panel, r.period): r for r in H.capture_descriptives(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(0, "p", None), (0, None, "x"), (1, "p", None), (1, None, "x"), (2, "p", None), (2, None, "x"), (3, "p", None), (3, None, "x"), (4, None, None)}
    a, b, whole = got[0, "p", None], got[0, None, "x"], got[4, None, None]
    assert (a.cells, a.contracts, a.mean_return, a.median_return, a.mean_yield) == (2, 501, 2.0, 2.0, 3.0)
    assert (b.scored, b.mean_return, b.median_return) == (0, None, None) and (whole.cells, whole.expiries, whole.mean_yield) == (3, 2, 4.0)
    assert H.capture_descriptives(spark.createDataFrame([], schema)).count() == 0
