"""Kernels against closed forms and independent small implementations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strikeloom.functions import dist as D
from strikeloom.functions import greeks as G
from strikeloom.functions import money as M
from strikeloom.operators import ledger as L
from strikeloom.operators import models as Mo
from strikeloom.operators import studies as S


@settings(max_examples=60, deadline=None)
@given(st.booleans(), st.floats(20, 200), st.floats(0.5, 1.6), st.floats(0.05, 2), st.floats(0.05, 1.5))
def test_implied_volatility_inverts_the_price(call, spot, ratio, years, sigma):
    a = lambda x: np.array([x])
    p = G.price(a(call), a(spot), a(spot * ratio), a(years), a(0.04), a(sigma))
    low = G.price(a(call), a(spot), a(spot * ratio), a(years), a(0.04), a(G.LOW))
    if p[0] - low[0] > 0.01:
        got = G.implied(a(call), a(spot), a(spot * ratio), a(years), a(0.04), p)
        again = G.price(a(call), a(spot), a(spot * ratio), a(years), a(0.04), got)
        assert abs(again[0] - p[0]) <= 2e-6


def test_put_call_parity_and_greeks():
    f = G.greeks_of(pd.Series(["call", "put", "call"]), pd.Series([50.0] * 3), pd.Series([50.0, 50.0, 50.0]), pd.Series([45, 45, 0]), pd.Series([0.04] * 3), pd.Series([3.0, 2.8, 3.0]), pd.Series([3.1, 2.9, 3.1]))
    assert 0.4 < f.delta[0] < 0.7 and -0.6 < f.delta[1] < -0.3
    assert f.reason.tolist()[2] == "expired" and math.isnan(f.iv[2])
    step = 1e-4
    up, down = (G.price(np.array([True]), np.array([50.0 + s]), np.array([50.0]), np.array([45 / 365]), np.array([0.04]), f.iv.to_numpy()[:1])[0] for s in (step, -step))
    assert abs((up - down) / (2 * step) - f.delta[0]) < 1e-6


def test_half_up_is_away_from_zero(spark):
    rows = spark.createDataFrame([(0.25,), (-0.25,), (None,), (0.24,), (1e9 + 0.5,)], "x double").select(M.half_up(F.col("x"), 10).alias("y")).collect()
    assert [r.y for r in rows] == [3, -3, None, 2, 10_000_000_005]


def test_watch_key_round_trip_and_bad_keys(spark):
    df = spark.createDataFrame([("w1:IREN:IREN:call:2026-09-25:40.500",), ("w2:IREN:IREN:call:2026-09-25:40.500",), ("",), (None,)], "k string")
    p = M.parse_watch_key(F.col("k"))
    got = df.select(p["ticker"].alias("t"), p["side"].alias("s"), p["strike"].cast("string").alias("x")).collect()
    assert [tuple(r) for r in got] == [("IREN", "call", "40.500")] + [(None, None, None)] * 3


def test_crps_against_the_definition(spark):
    rng = np.random.default_rng(3)
    data = [(i, sorted(rng.uniform(50, 150, 17).tolist()), float(rng.uniform(40, 160))) for i in range(20)]
    df = spark.createDataFrame(data, "i int, p array<double>, y double").select("i", D.crps(F.col("p"), F.col("y")).alias("c"))
    for r in df.collect():
        p, y = np.array(data[r.i][1]), data[r.i][2]
        assert abs(r.c - (np.abs(p - y).mean() - np.abs(p[:, None] - p[None, :]).mean() / 2)) < 1e-9


def test_asof_backward_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 25), ("b", 3, 5), ("a", 4, 20)], "k string, id int, t int")
    right = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("a", 20, "z"), ("b", 6, "w")], "k string, t int, v string")
    got = {r.id: r.v for r in L.asof_backward(left, right, ["k"], "t", "t", ["v"], "v").collect()}
    assert got == {1: "x", 2: "z", 3: None, 4: "z"}


def test_tail_counts_the_border_in_part(spark):
    df = spark.createDataFrame([("g", x, 10) for x in (1, 2, 3, 4)], "g string, x int, w int")
    r = S.tail_stats(df, ["g"], 0.375).first()
    assert r["quantile"] == 2 and abs(r["shortfall"] - (1 * 10 + 2 * 5) / 15) < 1e-12


def test_pareto_keeps_equal_points(spark):
    df = spark.createDataFrame([("g", 1, 5, 5), ("g", 2, 5, 5), ("g", 3, 6, 6), ("g", 4, 4, 5), ("g", 5, 7, 6)], "g string, id int, hi int, lo int")
    assert sorted(r.id for r in S.pareto(df, ["g"], "hi", "lo").collect()) == [1, 2, 5]


def test_blocked_dates_are_greedy(spark):
    df = spark.createDataFrame([("g", int(n)) for n in (1, 2, 7, 8, 12, 13, 14)], "g string, ordinal long")
    assert sorted(r.ordinal for r in S.blocked_dates(df, ["g"], 6).collect()) == [1, 7, 13]


def test_models_are_seeded_and_gated():
    returns = np.random.default_rng(1).normal(0, 0.02, 700)
    for name, f in Mo.MODELS.items():
        first, reason = f(returns, 5, np.random.default_rng(9))
        second, _ = f(returns, 5, np.random.default_rng(9))
        assert reason is None and np.array_equal(first, second), name
        assert 0.02 < first.std() < 0.09, name
        assert f(returns[:40], 5, np.random.default_rng(9))[0] is None
