"""Forecast models of one price series: fits and seeded simulations, one ticker to a Python group.

Spark cuts every series to its last ``WINDOW`` sessions before it is grouped, so a
group is bounded; every model is seeded from ticker, date, name and horizon and
gives the same scenarios anywhere. A model that can't be fitted says why.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, SCENARIOS, DECAY, FRAME = 1096, 4096, 0.94, 60  # fixed values
MOST_LOG = math.log(100)
Result = tuple[np.ndarray | None, str | None]


@dataclass
class Series:
    """Bars in order; ``split`` is the ratio on days of a split, else 0."""

    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    split: np.ndarray

    @property
    def returns(self) -> np.ndarray:
        return np.diff(np.log(self.close))

    @property
    def split_days(self) -> np.ndarray:
        """For each return whether its day has a split."""
        return self.split[1:] > 0

    def unsplit_returns(self) -> np.ndarray:
        """Returns after the last split."""
        at = np.flatnonzero(self.split_days)
        return self.returns[int(at[-1]) + 1 :] if len(at) else self.returns


def seed_of(ticker: str, day: str, method: str, horizon: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{ticker}|{day}|{method}|{horizon}".encode()).digest()[:8], "big")


def nelder_mead(f: Callable, start: list[float], rounds: int = 400, step: float = 0.25, close: float = 1e-6) -> tuple[np.ndarray, float, bool]:
    """Downhill simplex from a fixed start: best point, its value, and whether values came within ``close`` of one another."""
    n = len(start)
    points = np.array([start] + [[x + (step if i == j else 0) for j, x in enumerate(start)] for i in range(n)], float)
    values = np.array([f(p) for p in points])
    met = False
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if met := bool(values[-1] - values[0] < close):
            break
        centre = points[:-1].mean(axis=0)
        for scale in (1.0, 2.0):
            new = centre + scale * (centre - points[-1])
            value = f(new)
            if scale == 1.0:
                first, first_value = new, value
                if value >= values[0]:
                    break
            elif value < first_value:
                first, first_value = new, value
        if first_value < values[-2]:
            points[-1], values[-1] = first, first_value
            continue
        new = centre + 0.5 * (points[-1] - centre)
        value = f(new)
        if value < values[-1]:
            points[-1], values[-1] = new, value
        else:
            points[1:] = points[0] + 0.5 * (points[1:] - points[0])
            values[1:] = [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], float(values[best]), met


def log_t(x: np.ndarray, nu: float, scale: np.ndarray | float, unit: bool = True) -> np.ndarray:
    """Log density of a Student-t times ``scale``, of unit variance unless ``unit`` is false."""
    z, width = x / scale, nu - 2 if unit else nu
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * width) - np.log(scale) - (nu + 1) / 2 * np.log1p(z * z / width)


def skew_parts(nu: float, skew: float) -> tuple[float, float, float]:
    """Shift a, scale b and log factor of the skewed Student-t of mean 0 and variance 1."""
    log_c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    a = 4 * skew * math.exp(log_c) * (nu - 2) / (nu - 1)
    return a, math.sqrt(1 + 3 * skew * skew - a * a), log_c


def log_skew_t(z: np.ndarray, nu: float, skew: float) -> np.ndarray:
    """Log density of the skewed Student-t."""
    a, b, log_c = skew_parts(nu, skew)
    side = np.where(z < -a / b, 1 - skew, 1 + skew)
    return math.log(b) + log_c - (nu + 1) / 2 * np.log1p(((b * z + a) / side) ** 2 / (nu - 2))


def draw_skew_t(rng: np.random.Generator, nu: float, skew: float, n: int) -> np.ndarray:
    """Draws: a side with its chance, then half of a Student-t stretched by it."""
    a, b, _ = skew_parts(nu, skew)
    t = np.abs(rng.standard_t(nu, n)) * math.sqrt((nu - 2) / nu)
    left = rng.random(n) < (1 - skew) / 2
    return (np.where(left, -(1 - skew) * t, (1 + skew) * t) - a) / b


def trailing_volatility(returns: np.ndarray) -> np.ndarray:
    """For each place from FRAME on the root of the weighted mean square of the FRAME returns before it; nan where it's next to nothing."""
    weights = DECAY ** np.arange(FRAME)[::-1]
    frames = np.lib.stride_tricks.sliding_window_view(returns, FRAME)
    variance = (frames**2 @ weights) / weights.sum()
    return np.where(variance > 1e-16, np.sqrt(variance), np.nan)


def innovations(series: Series) -> np.ndarray:
    """Returns over the volatility of the FRAME before them, where neither they nor the frame has a split."""
    r, hit = series.returns, series.split_days
    if len(r) <= FRAME:
        return np.zeros(0)
    vol = trailing_volatility(r)[:-1]
    clean = ~np.lib.stride_tricks.sliding_window_view(hit, FRAME + 1).any(axis=1)
    z = r[FRAME:] / vol
    return z[clean & np.isfinite(z)]


def student(series: Series, horizon: int, rng: np.random.Generator) -> Result:
    """EWMA variance with Student-t innovations of free scale, fed back along each path."""
    z = innovations(series)
    if len(z) < 60:
        return None, "student_history_short"
    (a, b), _, met = nelder_mead(lambda p: -float(log_t(z, 2.05 + math.exp(min(p[0], 6)), math.exp(np.clip(p[1], -3, 3)), False).sum()), [1.0, 0.0])
    nu, scale = 2.05 + math.exp(min(a, 6)), math.exp(float(np.clip(b, -3, 3)))
    if not met or not 2.05 < nu <= 200:
        return None, "student_parameters_invalid"
    vol = trailing_volatility(series.returns)[-1]
    if not np.isfinite(vol):
        return None, "student_volatility_missing"
    total, var = np.zeros(SCENARIOS), np.full(SCENARIOS, vol * vol)
    for _ in range(horizon):
        r = np.sqrt(var) * scale * rng.standard_t(nu, SCENARIOS)
        total += r
        var = DECAY * var + (1 - DECAY) * r * r
    return np.clip(total, -MOST_LOG, MOST_LOG), None


def gjr_variances(returns: np.ndarray, omega: float, alpha: float, gamma: float, beta: float) -> np.ndarray:
    """Variance before each return and after the last, started at the mean square."""
    v = [float(np.mean(returns**2))]
    for r in returns.tolist():
        v.append(omega + (alpha + gamma * (r < 0)) * r * r + beta * v[-1])
    return np.array(v)


def gjr(series: Series, horizon: int, rng: np.random.Generator) -> Result:
    """GJR-GARCH(1,1) with Student-t innovations: omega free, alpha and alpha + gamma not below zero, persistence under 1."""
    if len(series.returns) < 500:
        return None, "gjr_history_short"
    if series.split_days.any():
        return None, "gjr_split_in_window"
    returns = series.returns * 100
    square = float(np.mean(returns**2))

    def parts(p: np.ndarray) -> tuple[float, float, float, float, float]:
        share = np.exp(np.clip(p[1:4], -8, 8))
        share = share / (1 + share.sum())  # of persistence: alpha / 2, (alpha + gamma) / 2, beta
        alpha, both, beta = 2 * share[0], 2 * share[1], share[2]
        return square * math.exp(float(np.clip(p[0], -12, 3))), alpha, both - alpha, beta, 2.05 + math.exp(min(float(p[4]), 5))

    def loss(p: np.ndarray) -> float:
        *shape, nu = parts(p)
        return -float(log_t(returns, nu, np.sqrt(gjr_variances(returns, *shape)[:-1])).sum())

    best, _, met = nelder_mead(loss, [-3.0, 0.0, 0.5, 3.0, 1.5], 250, 0.5, 1e-3)
    omega, alpha, gamma, beta, nu = parts(best)
    if not met:
        return None, "gjr_nonconverged"
    if omega <= 0 or alpha + gamma < 0 or alpha + gamma / 2 + beta >= 1 or nu <= 2.05:
        return None, "gjr_parameters_invalid"
    total, var = np.zeros(SCENARIOS), np.full(SCENARIOS, gjr_variances(returns, omega, alpha, gamma, beta)[-1])
    for _ in range(horizon):
        r = np.sqrt(var) * rng.standard_t(nu, SCENARIOS) * math.sqrt((nu - 2) / nu)
        total += r / 100
        var = omega + (alpha + gamma * (r < 0)) * r * r + beta * var
    return np.clip(total, -MOST_LOG, MOST_LOG), None


def not_negative(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with coefficients that aren't negative, by coordinate descent on the normal equations."""
    scale = np.sqrt((x * x).mean(axis=0))
    z = x / np.where(scale > 0, scale, 1)
    a, b = z.T @ z, z.T @ y
    beta = np.zeros(len(b))
    for _ in range(20_000):
        before = beta.copy()
        for j in range(len(b)):
            beta[j] = max(0.0, beta[j] + (b[j] - a[j] @ beta) / a[j, j]) if a[j, j] > 0 else 0.0
        if np.abs(beta - before).max() <= 1e-12 * (1e-300 + np.abs(beta).max()):
            break
    return beta / np.where(scale > 0, scale, 1)


def har(series: Series, horizon: int, rng: np.random.Generator) -> Result:
    """Daily variance from overnight gap and range, regressed on its last value, 5- and 22-session means, run forward."""
    at = np.flatnonzero(series.split > 0)
    begin = int(at[-1]) if len(at) else 0
    o, h, low, c = (x[begin:] for x in (series.open, series.high, series.low, series.close))
    if len(c) < 224:
        return None, "har_history_short"
    v = np.log(o[1:] / c[:-1]) ** 2 + np.log(h[1:] / low[1:]) ** 2 / (4 * math.log(2))
    if not np.isfinite(v).all() or v.mean() <= 1e-12:
        return None, "har_inputs_invalid"
    rows = np.arange(22, len(v))
    x = np.column_stack([np.ones(len(rows)), v[rows - 1], [v[i - 5 : i].mean() for i in rows], [v[i - 22 : i].mean() for i in rows]])
    beta = not_negative(x, v[rows])
    if beta.sum() <= 0:
        return None, "har_parameters_invalid"
    past, total = list(v[-22:]), np.zeros(SCENARIOS)
    for _ in range(horizon):
        var = float(beta @ [1.0, past[-1], np.mean(past[-5:]), np.mean(past)])
        total += rng.standard_normal(SCENARIOS) * math.sqrt(max(var, 1e-16))
        past = [*past[1:], var]
    return total, None


def skewed(series: Series, horizon: int, rng: np.random.Generator) -> Result:
    """EWMA variance with skewed Student-t innovations, on the returns after the last split."""
    returns = series.unsplit_returns() * 100
    if len(returns) < 180:
        return None, "skew_ewma_split_safe_history_short" if series.split_days.any() else "skew_ewma_history_short"
    v = [float(np.mean(returns[:FRAME] ** 2))]
    for r in returns.tolist():
        v.append(DECAY * v[-1] + (1 - DECAY) * r * r)
    z = returns / np.sqrt(np.array(v[:-1]))
    best, _, met = nelder_mead(lambda p: -float(log_skew_t(z, 2.05 + math.exp(min(p[0], 5.6)), 0.99 * math.tanh(p[1])).sum()), [1.5, 0.0])
    nu, skew = 2.05 + math.exp(min(best[0], 5.6)), 0.99 * math.tanh(best[1])
    if not met or nu > 300 or abs(skew) >= 0.99:
        return None, "skew_ewma_parameters_invalid"
    total, var = np.zeros(SCENARIOS), np.full(SCENARIOS, v[-1])
    for _ in range(horizon):
        r = np.sqrt(var) * draw_skew_t(rng, nu, skew, SCENARIOS)
        total += r / 100
        var = DECAY * var + (1 - DECAY) * r * r
    return np.clip(total, -MOST_LOG, MOST_LOG), None


def egarch_logs(returns: np.ndarray, omega: float, alpha: float, gamma: float, beta: float) -> np.ndarray:
    """Log variance before each return and after the last."""
    mean, logs = math.sqrt(2 / math.pi), [math.log(float(np.mean(returns**2)))]
    for r in returns.tolist():
        z = r * math.exp(-logs[-1] / 2)
        logs.append(min(50.0, max(-50.0, omega + alpha * (abs(z) - mean) + gamma * z + beta * logs[-1])))
    return np.array(logs)


def egarch(series: Series, horizon: int, rng: np.random.Generator) -> Result:
    """EGARCH(1,1) with asymmetry and skewed Student-t innovations, on the returns after the last split."""
    returns = series.unsplit_returns() * 100
    if len(returns) < 500:
        return None, "egarch_split_safe_history_short" if series.split_days.any() else "egarch_history_short"

    def parts(p: np.ndarray) -> tuple[float, float, float, float, float, float]:
        return float(p[0]), float(p[1]), float(p[2]), 0.9999 / (1 + math.exp(-float(np.clip(p[3], -9, 9)))), 2.05 + math.exp(min(float(p[4]), 5.6)), 0.99 * math.tanh(float(p[5]))

    def loss(p: np.ndarray) -> float:
        omega, alpha, gamma, beta, nu, skew = parts(p)
        logs = egarch_logs(returns, omega, alpha, gamma, beta)[:-1]
        return -float((log_skew_t(returns * np.exp(-logs / 2), nu, skew) - logs / 2).sum())

    best, _, met = nelder_mead(loss, [0.02, 0.1, 0.0, 2.5, 1.5, 0.0], 400, 0.2, 1e-3)
    omega, alpha, gamma, beta, nu, skew = parts(best)
    if not met:
        return None, "egarch_nonconverged"
    logs, mean = egarch_logs(returns, omega, alpha, gamma, beta), math.sqrt(2 / math.pi)
    total, now = np.zeros(SCENARIOS), np.full(SCENARIOS, logs[-1])
    for _ in range(horizon):
        z = draw_skew_t(rng, nu, skew, SCENARIOS)
        total += np.exp(now / 2) * z / 100
        now = omega + alpha * (np.abs(z) - mean) + gamma * z + beta * now
        if np.abs(now).max() > 50:
            return None, "egarch_scenarios_invalid"
    return np.clip(total, -MOST_LOG, MOST_LOG), None


def markov(series: Series, horizon: int, rng: np.random.Generator, rounds: int = 60) -> Result:
    """Two variances that switch as a Markov chain, by expectation-maximisation on the returns after the last split."""
    returns = series.unsplit_returns()
    if len(returns) < 500:
        return None, "markov_split_safe_history_short" if series.split_days.any() else "markov_history_short"
    n, base = len(returns), float(np.mean(returns**2))
    var, stay = np.array([0.4, 2.5]) * base, np.array([0.95, 0.9])
    for _ in range(rounds):
        move = np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]])
        density = np.exp(-0.5 * returns[:, None] ** 2 / var) / np.sqrt(2 * math.pi * var) + 1e-300
        ahead, size = np.empty((n, 2)), np.empty(n)
        p = np.array([0.5, 0.5])
        for i in range(n):
            p = (p @ move if i else p) * density[i]
            size[i] = p.sum()
            p = ahead[i] = p / size[i]
        back = np.ones((n, 2))
        joint = np.zeros((2, 2))
        for i in range(n - 2, -1, -1):
            nxt = density[i + 1] * back[i + 1] / size[i + 1]
            joint += ahead[i][:, None] * move * nxt
            back[i] = move @ nxt
        post = ahead * back
        post /= post.sum(axis=1, keepdims=True)
        var = np.maximum((post * returns[:, None] ** 2).sum(axis=0) / post.sum(axis=0), 1e-12)
        stay = np.clip(np.diag(joint) / joint.sum(axis=1), 0.0, 1.0)
    state = (rng.random(SCENARIOS) < ahead[-1][1]).astype(int)
    total = np.zeros(SCENARIOS)
    for _ in range(horizon):
        state = np.where(rng.random(SCENARIOS) < stay[state], state, 1 - state)
        total += np.sqrt(var[state]) * rng.standard_normal(SCENARIOS)
    return np.clip(total, -MOST_LOG, MOST_LOG), None


def lognormal(series: Series, horizon: int, rng: np.random.Generator) -> Result:
    """Zero-drift lognormal of EWMA volatility at mid-quantiles."""
    from strikeloom.functions.dist import normal_quantiles

    if len(series.returns) < FRAME or not np.isfinite(vol := trailing_volatility(series.returns)[-1]):
        return None, "too_few_returns"
    return vol * math.sqrt(horizon) * np.array(normal_quantiles(1024)), None


def tree_value(tree: dict[str, list], row: np.ndarray) -> float:
    """Walk an array-coded tree: ``feature`` (-1: leaf), ``cut``, ``left``, ``right``, ``value``; up to the cut goes left."""
    at = 0
    while tree["feature"][at] >= 0:
        at = tree["left"][at] if row[tree["feature"][at]] <= tree["cut"][at] else tree["right"][at]
    return float(tree["value"][at])


def boosted(model: dict, row: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of a boosted normal model: start values less the scaled sums of the trees' steps, the second as a logarithm."""
    mean, log_dev = model["start"]
    for stage in model["stages"]:
        mean -= model["rate"] * stage["scale"] * tree_value(stage["trees"][0], row)
        log_dev -= model["rate"] * stage["scale"] * tree_value(stage["trees"][1], row)
    return mean, math.exp(log_dev)


def predicted(features: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``features`` with ``mean`` and ``deviation`` of a boosted model, row by row in Arrow batches; null where a feature is missing."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("mean double, deviation double")
    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [boosted(model, r) if np.isfinite(r).all() else (None, None) for r in frame.to_numpy(float)]
        return pd.DataFrame(rows, columns=["mean", "deviation"], dtype="float64")

    return features.withColumn("walked", walk(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]))).select(*features.columns, "walked.mean", "walked.deviation")


def series_of(returns: np.ndarray) -> Series:
    """Bars of which nothing but the returns is known: each opens where it closes, without range or split."""
    close = np.exp(np.concatenate([[0.0], np.cumsum(returns)]))
    return Series(close, close, close, close, np.zeros(len(close)))


def on_returns(model: Callable[[Series, int, np.random.Generator], Result]) -> Callable[[Series | np.ndarray, int, np.random.Generator], Result]:
    """``model`` for bars or for an array of returns."""
    return lambda x, horizon, rng: model(series_of(x) if isinstance(x, np.ndarray) else x, horizon, rng)


MODELS = {"lognormal": lognormal, "student_t": student, "gjr": gjr, "har": har, "skew_ewma": skewed, "egarch": egarch, "markov": markov}
MODELS = {name: on_returns(model) for name, model in MODELS.items()}
#: Methods that are declared and never available, with their reasons.
UNAVAILABLE = {"earnings_jump": "no_verified_events", "iv_physical": "no_history", "ssvi": "no_surface", "pooled": "training_source_rights_unverified"}


def candidates(stocks: DataFrame, horizon: int, methods: list[str]) -> DataFrame:
    """Scenario summary of each method and ticker as of its last session, or the reason why there's none.

    ``stocks``: ticker, ts, open, high, low, close and, where splits are known,
    ``split``. Only the last WINDOW sessions of a ticker are sent to Python.
    """
    named = [m for m in methods if m in MODELS]
    spare = {m: UNAVAILABLE[m] for m in methods if m in UNAVAILABLE}

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        ticker, day = frame["ticker"].iloc[0], str(frame["ts"].iloc[-1])
        series = Series(*[frame[c].to_numpy(float) for c in ("open", "high", "low", "close", "split")])
        out = [[ticker, m, 0, None, None, None, r] for m, r in spare.items()]
        for m in named:
            logs, reason = MODELS[m](series, horizon, np.random.default_rng(seed_of(ticker, day, m, horizon)))
            if logs is None:
                out.append([ticker, m, 0, None, None, None, reason])
            else:
                x = np.sort(series.close[-1] * np.exp(logs))
                out.append([ticker, m, len(x), float(np.quantile(x, 0.05)), float(np.quantile(x, 0.5)), float(np.quantile(x, 0.95)), None])
        return pd.DataFrame(out, columns=["ticker", "method", "scenarios", "q05", "q50", "q95", "reason"])

    split = F.col("split") if "split" in stocks.columns else F.lit(0.0)
    rows = stocks.select("ticker", F.col("ts").cast("string").alias("ts"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], split.cast("double").alias("split"))
    last = rows.withColumn("back", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("ts")))).filter(F.col("back") <= WINDOW).drop("back")
    return last.groupBy("ticker").applyInPandas(fit, "ticker string, method string, scenarios long, q05 double, q50 double, q95 double, reason string")
