"""Regime prices against Black-Scholes and simulation, planted fits, and the curve programme against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from strikeloom.functions.greeks import normal_cdf, price
from strikeloom.operators import curves as C
from strikeloom.operators import regimes as R


def test_equal_regimes_are_black_scholes():
    strikes = np.array([50.0, 80.0, 100.0, 130.0, 190.0])
    for sigma, years, rate in ((0.2, 0.5, 0.03), (0.6, 2.0, 0.0), (0.15, 0.1, 0.1)):
        one = np.ones(5)
        want = price(one == 1, 100 * one, strikes, years * one, rate * one, sigma * one)
        d2 = (np.log(100 / strikes) + (rate - sigma * sigma / 2) * years) / (sigma * math.sqrt(years))
        p = np.array([sigma, sigma, 1.3, 0.4])
        assert np.allclose(R.converged(R.calls, p, 100.0, rate, years, strikes), want, atol=2e-6)
        assert np.allclose(R.converged(R.digitals, p, 100.0, rate, years, strikes), normal_cdf(d2) * math.exp(-rate * years), atol=2e-6)
    assert np.isnan(R.converged(R.calls, np.array([0.07, 0.5, 1, 1.0]), 100.0, 0.0, 0.01, strikes)).all()


def test_two_regimes_are_a_simulated_chain():
    p, years, rng = np.array([0.15, 0.55, 3.0, 1.5]), 0.75, np.random.default_rng(2)
    n = 200_000
    spent, state, left = np.zeros((2, n)), np.zeros(n, int), np.full(n, years)
    while (left > 0).any():
        stay = np.minimum(rng.exponential(1 / p[2 + state]), left)
        spent[state, np.arange(n)] += stay
        left, state = left - stay, 1 - state
    variance = spent[0] * p[0] ** 2 + spent[1] * p[1] ** 2
    x = -variance / 2 + np.sqrt(variance) * rng.standard_normal(n)
    for strike in (80.0, 100.0, 125.0):
        paid = np.maximum(100 * np.exp(x) - strike, 0)
        assert R.calls(p, 100.0, 0.0, years, np.array([strike]), 256.0)[0] == pytest.approx(paid.mean(), abs=5 * paid.std() / math.sqrt(n))
        assert R.digitals(p, 100.0, 0.0, years, np.array([strike]), 256.0)[0] == pytest.approx((100 * np.exp(x) > strike).mean(), abs=0.006)


def test_bounded_least_squares():
    rosen = lambda x: np.array([10 * (x[1] - x[0] ** 2), 1 - x[0]])
    x, cost = R.bounded_least_squares(rosen, np.array([-1.2, 1.0]), np.array([-5.0, -5.0]), np.array([5.0, 5.0]), most=200, close=1e-10)
    assert np.allclose(x, 1, atol=1e-4) and cost < 1e-8
    x, cost = R.bounded_least_squares(rosen, np.array([-1.2, 1.0]), np.array([-5.0, -5.0]), np.array([0.5, 5.0]), most=200, close=1e-10)
    assert np.allclose(x, [0.5, 0.25], atol=1e-3)


def chain(p, spot=100.0, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in (40, 90, 180, 365, 500):
        strikes = np.arange(60.0, 150.0, 5.0)
        value = R.calls(np.array(p), spot, 0.03, t / 365, strikes, 256.0)
        for k, v in zip(strikes, value, strict=True):
            half = 0.03 + 0.01 * v
            half, mid = float(half), float(v + noise * half * rng.uniform(-1, 1))
            rows.append(("T", f"2025-{t:03d}", float(k), spot, t / 365, 0.03, max(0.0, mid - half), max(0.0, mid + half), 10, 10, True))
    return rows


SCHEMA = "ticker string, expiry string, strike double, spot double, years double, rate double, bid double, ask double, oi long, volume long, standard boolean"


def test_planted_models_are_recovered(spark):
    planted = (0.18, 0.5, 1.5, 2.5)
    good = R.market_odds(spark.createDataFrame(chain(planted, noise=0.3), SCHEMA)).toPandas()
    published = good[good["p"].notna()]
    assert len(published) > 60
    for r in published.itertuples():
        t = int(r.expiry[-3:]) / 365
        truth = R.digitals(np.array(planted), 100.0, 0.03, t, np.array([r.strike]), 256.0)[0] * math.exp(0.03 * t)
        assert abs(truth - r.p) < 0.02 and r.lower <= r.p <= r.upper
    assert good["held_out_price"].notna().sum() == 4
    for _, part in published.sort_values("strike").groupby("expiry"):
        assert (np.diff(part["p"]) <= 0.001).all()


def test_reasons(spark):
    rows = chain((0.2, 0.4, 2.0, 2.0))
    odd = [
        ("T", "2025-040", 60.0, 100.0, 40 / 365, 0.03, 1.0, 2.0, 10, 10, True), ("T", "2025-040", 61.0, 100.0, 40 / 365, 0.03, 1.0, 2.0, 10, 10, False),
        ("T", "2025-000", 70.0, 100.0, -0.1, 0.03, 1.0, 2.0, 10, 10, True), ("T", "2025-090", 71.0, 100.0, 0.2, None, 1.0, 2.0, 10, 10, True),
        ("T", "2025-090", 72.0, 100.0, 90 / 365, 0.03, 2.0, 1.0, 10, 10, True), ("U", "2025-090", 72.0, 100.0, 90 / 365, 0.03, 1.0, 1.1, 10, 10, True),
        ("V", "2025-090", 72.0, 0.0, 90 / 365, 0.03, 1.0, 1.1, 10, 10, True), ("T", "2025-090", 73.0, 100.0, 90 / 365, 0.03, 1.0, 1.1, 1, None, True),
    ]
    got = {(r.ticker, r.expiry, r.strike): r.reason for r in R.market_odds(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    assert got["T", "2025-040", 60.0] == "duplicate_contract" and got["T", "2025-040", 61.0] == "invalid_contract" and got["T", "2025-000", 70.0] == "expired"
    assert got["T", "2025-090", 71.0] == "rate_unavailable" and got["T", "2025-090", 72.0] == "invalid_quote" and got["T", "2025-090", 73.0] == "invalid_quote"
    assert got["U", "2025-090", 72.0] == "calibration_failed" and got["V", "2025-090", 72.0] == "invalid_spot"
    assert got["T", "2025-040", 145.0] == "quote_bracket_missing" and None in got.values()
    assert R.market_odds(spark.createDataFrame([], SCHEMA)).count() == 0
    spoiled = [(*r[:6], r[6] * (1.5 if i % 2 else 0.6), r[7] * (1.5 if i % 2 else 0.6), *r[8:]) for i, r in enumerate(rows)]
    assert {r.reason for r in R.fits(R.fit_quotes(spark.createDataFrame(spoiled, SCHEMA))).selectExpr("fit_reason as reason").collect()} == {"poor_fit"}


def test_fit_sample_by_hand(spark):
    df = spark.createDataFrame(chain((0.2, 0.4, 2.0, 2.0)), SCHEMA)
    got = R.fit_quotes(df).toPandas()
    assert sorted(set(got["expiry"])) == ["2025-040", "2025-090", "2025-365", "2025-500"]  # places 0, 1.33, 2.67 and 4 of five
    for _, part in got.groupby("expiry"):
        assert len(part) == 5 and part["held_out"].sum() == 1 and part[part["held_out"]]["strike"].iloc[0] in (90.0, 110.0)


def brute(a, b):
    """The best of all solutions held by some set of constraints."""
    best = None
    for size in range(a.shape[1] + 1):
        for some in itertools.combinations(range(len(b)), size):
            n = a[list(some)]
            y = np.linalg.lstsq(n @ n.T, b[list(some)], rcond=None)[0] if size else np.zeros(0)
            x = n.T @ y if size else np.zeros(a.shape[1])
            if (a @ x - b).min() > -1e-8 and (best is None or x @ x < best @ best - 1e-12):
                best = x
    return best


def test_programme_is_optimal_or_certified():
    rng = np.random.default_rng(11)
    feasible = 0
    for _ in range(120):
        strikes = np.cumsum(rng.uniform(1, 3, 4))
        mid = np.sort(rng.uniform(0, 4, 4))[::-1] + rng.normal(0, 0.3, 4)
        bid = np.maximum(mid - rng.uniform(0.02, 0.4, 4), 0)
        a, b, _, _ = C.programme(strikes, bid, np.maximum(mid, bid + 0.01), 0.97)
        x, _, certificate = C.nearest(a, b)
        want = brute(a, b)
        assert (x is None) == (want is None)
        if x is None:
            y = np.zeros(len(b))
            y[list(certificate)] = list(certificate.values())
            assert (y >= 0).all() and np.abs(y @ a).max() < 1e-7 and y @ b > 0
        else:
            feasible += 1
            assert np.allclose(x, want, atol=1e-6)
    assert 15 < feasible < 110


def test_curves_never_rise_and_warm_starts_change_nothing():
    rng = np.random.default_rng(5)
    seen = 0
    for n in (5, 20, 80):
        for _ in range(6):
            strikes = np.cumsum(rng.uniform(0.5, 3, n))
            true = np.maximum(100 - strikes, 0) + 3 * np.exp(-np.abs(strikes - 100) / 9) + 0.5
            bid = np.maximum(true + rng.normal(0, 0.02, n) - 0.1, 0)
            ask = bid + 0.2
            prices, active, _ = C.curve(strikes, bid, ask, 1.0)
            if prices is None:
                continue
            seen += 1
            slope = np.diff(prices) / np.diff(strikes)
            assert (prices > bid - 1e-7).all() and (prices < ask + 1e-7).all() and slope.min() > -1 - 1e-7 and slope.max() < 1e-7 and np.diff(slope).min() > -1e-7
            assert (np.diff(C.chances(strikes, prices, 1.0)) <= 0).all()
            shifted = bid + np.where(np.arange(n) == n // 2, 0.01, 0)
            cold, warm = C.curve(strikes, shifted, shifted + 0.2, 1.0)[0], C.curve(strikes, shifted, shifted + 0.2, 1.0, active)[0]
            assert (cold is None) == (warm is None) and (cold is None or np.allclose(cold, warm, atol=1e-6))
    assert seen > 8


def test_curve_odds_of_a_chain(spark):
    rows = chain((0.2, 0.4, 2.0, 2.0), noise=0.2)
    crossed = [("X", "e", float(k), 100.0, 0.5, 0.0, b, b + 0.1, 9, 9, True) for k, b in zip(range(90, 96), (5.0, 6.0, 4.0, 7.0, 3.0, 8.0), strict=True)]
    few = [("F", "e", float(k), 100.0, 0.5, 0.0, 1.0, 1.1, 9, 9, True) for k in range(4)]
    many = [("M", "e", float(k), 100.0, 0.5, 0.0, 1.0, 1.1, 9, 9, True) for k in range(81)]
    twice = [("D", "e", float(k // 2), 100.0, 0.5, 0.0, 1.0, 1.1, 9, 9, True) for k in range(12)]
    got = C.curve_odds(spark.createDataFrame(rows + crossed + few + many + twice, SCHEMA)).toPandas()
    reason = {k: set(v["reason"]) for k, v in got.groupby("ticker")}
    assert reason["X"] == {"infeasible_curve"} and reason["F"] == {"sparse_or_large_strip"} == reason["M"] and reason["D"] == {"duplicate_strike"}
    assert len(got) == len(rows) + 6 + 4 + 81 + 12
    own = got[got["ticker"] == "T"]
    assert own["p"].notna().sum() > 40
    for _, part in own[own["p"].notna()].sort_values("strike").groupby("expiry"):
        assert (np.diff(part["p"]) <= 0).all()
    counts = {r.ticker: r for r in C.curve_counters(C.curve_odds(spark.createDataFrame(rows + crossed, SCHEMA)), ["ticker"]).collect()}
    assert counts["T"].held_out == 15 and counts["T"].predicted == 15 and counts["T"].inside == own["inside"].sum() > 3 and "infeasible_curve" in counts["X"].reasons
    assert isinstance(got, pd.DataFrame)
