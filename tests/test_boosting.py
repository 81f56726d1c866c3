"""The distributed learner against a plain NumPy trainer that looks at every row for every cut."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from strikeloom.operators import boosting as B
from strikeloom.operators.models import boosted


def by_hand(x, y, stages, rate, depth, least, bins):
    n = len(y)
    cuts = []
    for f in range(x.shape[1]):
        v = np.sort(x[:, f])
        cuts.append(sorted({v[max(math.ceil(n * i / bins), 1) - 1] for i in range(1, bins)} - {v[-1]}))

    def tree(rows, g, left):
        value = g[rows].mean()
        best = None
        if left:
            base = g[rows].sum() ** 2 / len(rows)
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if len(a) >= least and len(b) >= least:
                        gain = g[a].sum() ** 2 / len(a) + g[b].sum() ** 2 / len(b) - base
                        if gain > 1e-12 * max(1, base) and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, c, a, b)
        if best is None:
            return lambda row: value
        _, f, c, a, b = best
        low, high = tree(a, g, left - 1), tree(b, g, left - 1)
        return lambda row: low(row) if row[f] <= c else high(row)

    mean, dev = np.full(n, y.mean()), np.full(n, math.log(y.std()))
    nll = lambda m, d: float(np.mean(0.5 * math.log(2 * math.pi) + d + (y - m) ** 2 * np.exp(-2 * d) / 2))
    out = []
    for _ in range(stages):
        parts = [tree(np.arange(n), g, depth) for g in (mean - y, (1 - (mean - y) ** 2 * np.exp(-2 * dev)) / 2)]
        a, b = (np.array([t(r) for r in x]) for t in parts)
        now, length, scale = nll(mean, dev), np.hypot(a, b).mean(), 1.0
        while scale < 512 and nll(mean - scale * a, dev - scale * b) <= now:
            scale *= 2
        while not (nll(mean - scale * a, dev - scale * b) < now or length * scale < 1e-4):
            scale /= 2
        mean, dev = mean - rate * scale * a, dev - rate * scale * b
        out.append(scale)
        if length < 1e-4:
            break
    return mean, np.exp(dev), out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(1, 26, 700), rng.normal(size=700), np.repeat(2.0, 700)])
    y = 0.1 * np.sign(x[:, 1]) + rng.normal(size=700) * np.where(x[:, 0] > 12, 0.3, 0.05)
    return x, y, spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b.c": x[:, 1], "same": x[:, 2], "y": y}))


def test_like_the_plain_trainer(table):
    x, y, df = table
    model = B.train(df, ["a", "b.c", "same"], "y", stages=13, rate=0.1, bins=16, least_leaf=30)
    mean, dev, scales = by_hand(x, y, 13, 0.1, 2, 30, 16)
    assert [s["scale"] for s in model["stages"]] == scales
    got = np.array([boosted(model, r) for r in x])
    assert np.allclose(got[:, 0], mean, atol=1e-6) and np.allclose(got[:, 1], dev, rtol=1e-6)


def test_the_same_however_rows_are_dealt(table):
    _, _, df = table
    a, b = (B.train(df.repartition(n), ["a", "b.c", "same"], "y", stages=4, bins=8) for n in (1, 7))
    assert a["stages"] == b["stages"]


def test_it_learns_both_parameters(table):
    x, y, df = table
    model = B.train(df, ["a", "b.c", "same"], "y", stages=60, rate=0.1)
    got = np.array([boosted(model, r) for r in x])
    quiet, loud = x[:, 0] <= 12, x[:, 0] > 12
    assert np.median(got[quiet, 1]) < 0.12 < 0.2 < np.median(got[loud, 1])
    assert got[x[:, 1] > 0.2, 0].mean() > 0.05 > -0.05 > got[x[:, 1] < -0.2, 0].mean()


def test_tables_that_cannot_be_learned(spark):
    schema = "a double, y double"
    for rows in ([], [(None, 1.0), (1.0, None)], [(1.0, 2.0), (2.0, 2.0)]):
        with pytest.raises(ValueError, match="support"):
            B.train(spark.createDataFrame(rows, schema), ["a"], "y")
    flat = B.train(spark.createDataFrame([(1.0, float(i % 2)) for i in range(100)], schema), ["a"], "y", stages=3)
    assert all(t["feature"] == [-1] for s in flat["stages"] for t in s["trees"]) and len(flat["stages"]) == 1


def test_prices_have_reasons(spark, table):
    model = B.train(table[2], ["a", "b.c", "same"], "y", stages=2)
    df = spark.createDataFrame([(1, 5.0, 0.0, 2.0), (2, None, 0.0, 2.0), (3, 99.0, 0.0, 2.0), (4, 5.0, float("nan"), 2.0)], "id int, a double, b double, same double")
    got = {r.id: r for r in B.priced(df, model, ["a", "b", "same"]).collect()}
    assert [got[i].reason for i in (1, 2, 3, 4)] == [None, "pooled_inputs_invalid", "pooled_inputs_out_of_domain", "pooled_inputs_invalid"]
    assert got[1]["mean"] is not None and got[3]["mean"] is None


def bars(n, ticker="A", split=None):
    rng = np.random.default_rng(1)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return pd.DataFrame({"ticker": ticker, "ts": pd.date_range("2024-01-01", periods=n).date, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(1, 99, n).astype(float), "split": [1.0 if i == split else 0.0 for i in range(n)]})


def test_features_by_hand(spark):
    frame = bars(60, split=30)
    got = {r.place: r for r in B.pooled_features(spark.createDataFrame(frame)).collect()}
    assert {p for p, r in got.items() if r.last_return is not None} == set(range(22, 30)) | set(range(53, 60))
    r = np.diff(np.log(frame["close"].to_numpy()))[:22]
    v = np.log(frame["high"] / frame["low"]).to_numpy()[1:23] ** 2 / (4 * math.log(2))
    volume = frame["volume"].to_numpy()[1:23]
    want = [r[-1], r[-5:].mean(), r.mean(), r[-5:].std(), r.std(), v[-5:].mean(), v.mean(), math.log(volume[-1] / volume.mean())]
    assert [got[22][c] for c in B.FEATURES[1:]] == pytest.approx(want)


def test_cohorts_are_gated(spark):
    rows = spark.range(10)
    make = lambda sizes: spark.createDataFrame(pd.concat([bars(n, f"T{i}") for i, n in enumerate(sizes)]))
    reason = lambda sizes, **k: B.cohort_reason(make(sizes), rows, **({"least_tickers": 2, "least_sessions": 20, "most_sessions": 40, "least_rows": 5} | k))
    assert reason([30, 30]) is None
    assert reason([30]) == "pooled_training_cohort_size_invalid"
    assert reason([30, 31]) == "pooled_training_vintage_mismatch"
    assert reason([10, 10]) == "pooled_training_history_invalid"
    assert reason([30, 30], least_rows=11) == "pooled_training_support_insufficient"
