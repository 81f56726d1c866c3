"""Kernels of the forecast models, odds and exact quantiles against plain forms."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeloom.functions import greeks as G
from strikeloom.operators import inference as I
from strikeloom.operators import models as Mo
from strikeloom.operators import odds as O
from strikeloom.operators import quantiles as Q


def test_skewed_density_and_draws():
    x = np.linspace(-80, 80, 1_600_001)
    for nu, skew in ((5.0, -0.4), (30.0, 0.0), (8.0, 0.7)):
        p = np.exp(Mo.log_skew_t(x, nu, skew)) * (x[1] - x[0])
        assert (abs(p.sum() - 1), abs((x * p).sum()), abs((x * x * p).sum() - 1)) < (1e-4, 1e-3, 1e-2)
        z = Mo.draw_skew_t(np.random.default_rng(3), nu, skew, 400_000)
        for at in (-1.5, -0.5, 0.0, 1.0):
            assert abs((z <= at).mean() - p[x <= at].sum()) < 0.004
    assert np.allclose(Mo.log_skew_t(np.array([0.3, -1.2]), 9.0, 0.0), Mo.log_t(np.array([0.3, -1.2]), 9.0, 1.0))


def test_variance_recursions():
    r = np.random.default_rng(5).normal(0, 1, 40)
    v, log_v = float(np.mean(r**2)), math.log(float(np.mean(r**2)))
    got, logs = Mo.gjr_variances(r, 0.1, 0.05, -0.02, 0.8), Mo.egarch_logs(r, 0.02, 0.1, -0.05, 0.9)
    for i, x in enumerate(r):
        assert got[i] == pytest.approx(v) and logs[i] == pytest.approx(log_v)
        z = x / math.exp(log_v / 2)
        v = 0.1 + (0.05 - 0.02 * (x < 0)) * x * x + 0.8 * v
        log_v = 0.02 + 0.1 * (abs(z) - math.sqrt(2 / math.pi)) - 0.05 * z + 0.9 * log_v


def test_innovations_skip_frames_with_splits():
    r = np.random.default_rng(6).normal(0, 0.02, 200)
    close = np.exp(np.concatenate([[0], np.cumsum(r)]))
    split = np.zeros(201)
    split[101] = 2.0
    got = Mo.innovations(Mo.Series(close, close, close, close, split))
    weights = 0.94 ** np.arange(60)[::-1]
    want = [r[i] / math.sqrt((r[i - 60 : i] ** 2 * weights).sum() / weights.sum()) for i in range(60, 200) if not split[i - 59 : i + 2].any()]
    assert np.allclose(got, want)


def test_not_negative_least_squares():
    rng = np.random.default_rng(8)
    for _ in range(20):
        x, y = rng.normal(size=(60, 4)), rng.normal(size=60)
        best, value = None, math.inf
        for mask in range(16):
            cols = [j for j in range(4) if mask >> j & 1]
            beta = np.zeros(4)
            if cols:
                beta[cols] = np.linalg.lstsq(x[:, cols], y, rcond=None)[0]
            loss = ((y - x @ beta) ** 2).sum()
            if beta.min() >= 0 and loss < value:
                best, value = beta, loss
        assert np.allclose(Mo.not_negative(x, y), best, atol=1e-6)


def test_splits_and_history_are_gated():
    r = np.random.default_rng(4).normal(0, 0.02, 600)
    close = np.exp(np.concatenate([[0], np.cumsum(r)]))
    split = np.zeros(601)
    split[400] = 4.0
    s = Mo.Series(close, close, close, close, split)
    reason = {n: f(s, 5, np.random.default_rng(1))[1] for n, f in Mo.MODELS.items()}
    assert reason["gjr"] == "gjr_split_in_window" and reason["egarch"] == "egarch_split_safe_history_short" and reason["markov"] == "markov_split_safe_history_short" and reason["student_t"] is None


def test_tree_walk(spark):
    tree = {"feature": [0, -1, 1, -1, -1], "cut": [0.5, 0, 2.0, 0, 0], "left": [1, 0, 3, 0, 0], "right": [2, 0, 4, 0, 0], "value": [0, 1.0, 0, 2.0, 3.0]}
    flat = {"feature": [-1], "cut": [0], "left": [0], "right": [0], "value": [0.5]}
    model = {"start": (0.1, -1.0), "rate": 0.1, "stages": [{"scale": 2.0, "trees": [tree, flat]}, {"scale": 1.0, "trees": [flat, tree]}]}
    df = spark.createDataFrame([(1, 0.5, 9.0), (2, 0.6, 2.0), (3, 0.6, 2.1), (4, None, 1.0)], "id int, a double, b double")
    got = {r.id: (r["mean"], r.deviation) for r in Mo.predicted(df, model, ["a", "b"]).collect()}
    for i, leaf in ((1, 1.0), (2, 2.0), (3, 3.0)):
        assert got[i] == pytest.approx((0.1 - 0.2 * leaf - 0.05, math.exp(-1.0 - 0.1 - 0.1 * leaf)))
    assert got[4] == (None, None)


def test_steepest_like_all_pairs():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 50, 200):
        k = np.cumsum(rng.uniform(0.1, 2, n)).tolist()
        base, value = rng.normal(size=n).tolist(), rng.normal(size=n).tolist()
        for i, x in enumerate(O.steepest(k, base, value)):
            want = max(((value[i] - base[j]) / (k[i] - k[j]) for j in range(i)), default=None)
            assert x == (want if want is None else pytest.approx(want))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(10)
    rows = [(g, float(x)) for g, n in (("a", 1000), ("b", 7), ("c", 1)) for x in rng.normal(size=n)] + [("d", 2.0)] * 300 + [("e", float(k % 3)) for k in range(100)]
    df = spark.createDataFrame(rows, "g string, x double")
    ranges = df.groupBy("g").agg(F.min("x").alias("least_"), F.max("x").alias("most_"), F.count("*").alias("count_"))
    values = defaultdict(list)
    for g, x in rows:
        values[g].append(x)
    for share in (0.05, 0.5):
        got = {r.g: r.q for r in Q.lower_quantile(df, ranges, ["g"], "x", share, "q", 16).collect()}
        assert got == {g: sorted(v)[max(1, math.ceil(share * len(v))) - 1] for g, v in values.items()}
    got = {r.g: r.q for r in Q.counted_quantile(df.filter("g > 'c'"), ["g"], "x", 0.5, "q").collect()}
    assert got == {"d": 2.0, "e": 1.0}
    atoms = df.groupBy("g", F.floor(F.col("x") * 10).alias("k")).agg(F.count("*").alias("w"))
    for r in Q.running(atoms, ["g"], "k", "w", F.floor(F.col("k") / 4)).collect():
        assert r.upto == sum(math.floor(x * 10) <= r.k for x in values[r.g]) and r.total == len(values[r.g])


def test_paired_interval_and_blocks(spark):
    rng = np.random.default_rng(11)
    rows = [("g", f"d{i:03d}", float(x), 2) for i, x in enumerate(rng.normal(size=40))] + [("h", f"d{i:03d}", 1.0, 1) for i in range(19)]
    df = spark.createDataFrame(rows, "g string, origin string, s double, n long")
    got = {r.g: r for r in I.paired_interval(df, ["g"], F.col("g") == "g").collect()}
    s = np.array([r[2] for r in rows if r[0] == "g"])
    picks = np.random.default_rng(1729).integers(0, 40, size=(2000, 40))
    low, high = np.quantile(s[picks].sum(axis=1) / 80, [0.05 / 14, 1 - 0.05 / 14])
    assert (got["g"].low, got["g"].high, got["g"].comparisons) == (pytest.approx(low), pytest.approx(high), 7)
    assert (got["h"].status, got["h"].low, got["h"].comparisons) == ("not_estimable", None, 1)
    calendar = spark.range(300).withColumnRenamed("id", "ordinal")
    pair = calendar.filter("ordinal % 2 = 0").selectExpr("'x' as rule", "ordinal", "double(ordinal % 7) / 100 as ret", "2L as days", "double(ordinal % 5) / 100 as other_ret", "2L as other_days")
    r = I.block_comparison(pair, calendar, ["rule"], draws=200).first()
    a, b = np.array([k % 7 / 100 for k in range(0, 300, 2)]), np.array([k % 5 / 100 for k in range(0, 300, 2)])
    assert r.status == "estimable" and r.dates == 150 and r.blocks == 11
    assert r.reward == pytest.approx(a.sum() / 300 - b.sum() / 300) and r.reward_low <= r.reward <= r.reward_high
    assert I.block_comparison(pair.limit(19), calendar, ["rule"]).first().status == "underpowered"


def test_endpoint_volatilities():
    import pandas as pd

    rng = np.random.default_rng(12)
    n = 300
    side = pd.Series(np.where(rng.random(n) < 0.5, "call", "put"))
    spot, strike, years, rate = (pd.Series(rng.uniform(a, b, n)) for a, b in ((20, 80), (20, 80), (0.05, 2), (0, 0.1)))
    sigma = pd.Series(rng.uniform(0.1, 2, n))
    call = (side == "call").to_numpy()
    price = pd.Series(G.price(call, *(x.to_numpy() for x in (spot, strike, years, rate, sigma))))
    got = G.endpoints_of(side, spot, strike, years, rate, price)
    discounted = strike * np.exp(-rate * years)
    edge = np.maximum(np.where(call, spot - discounted, discounted - spot), 0)
    wide = price.to_numpy() > edge + 0.05  # where the price tells the volatility
    assert (abs(got["tenths"][wide].astype(float) - sigma[wide] * 1000) <= 6).all() and got["reason"][wide].isna().all()
    wrong = G.endpoints_of(side, spot, strike, years, rate, pd.Series(np.where(call, spot, discounted)))
    assert set(wrong["reason"]) == {"model_bounds"} and wrong["tenths"].isna().all()
    far = G.endpoints_of(pd.Series(["call"]), pd.Series([50.0]), pd.Series([50.0]), pd.Series([0.01]), pd.Series([0.0]), pd.Series([49.0]))
    assert far["reason"][0] == "solver_range"
    assert G.endpoints_of(pd.Series(["call"]), pd.Series([50.0]), pd.Series([50.0]), pd.Series([0.5]), pd.Series([0.0]), pd.Series([np.nan]))["reason"][0] == "model_bounds"
