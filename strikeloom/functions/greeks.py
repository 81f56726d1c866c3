"""Black-Scholes prices, implied volatility and Greeks over whole Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW, HIGH, TOLERANCE, STEPS, EDGE = 1e-4, 5.0, 1e-6, 80, 0.01
_erf = np.frompyfunc(math.erf, 1, 1)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(x / math.sqrt(2.0)).astype(float))


def price(call: np.ndarray, spot: np.ndarray, strike: np.ndarray, years: np.ndarray, rate: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """European prices; all inputs positive."""
    root = np.sqrt(years)
    d1 = (np.log(spot / strike) + (rate + 0.5 * sigma * sigma) * years) / (sigma * root)
    d2 = d1 - sigma * root
    sign = np.where(call, 1.0, -1.0)
    return sign * (spot * normal_cdf(sign * d1) - strike * np.exp(-rate * years) * normal_cdf(sign * d2))


def implied(call: np.ndarray, spot: np.ndarray, strike: np.ndarray, years: np.ndarray, rate: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Volatility by bisection, NaN where no volatility between LOW and HIGH has the price.

    All rows are halved together; those within TOLERANCE drop out.
    """
    out = np.full(len(spot), np.nan)
    rows = np.flatnonzero((years > 0) & (spot > 0) & (strike > 0) & (wanted > 0))
    if not len(rows):
        return out
    at = lambda i, s: price(call[i], spot[i], strike[i], years[i], rate[i], s)
    low, high = np.full(len(rows), LOW), np.full(len(rows), HIGH)
    inside = (wanted[rows] >= at(rows, low) - TOLERANCE) & (wanted[rows] <= at(rows, high) + TOLERANCE)
    rows, low, high = rows[inside], low[inside], high[inside]
    for _ in range(STEPS):
        if not len(rows):
            break
        mid = 0.5 * (low + high)
        gap = at(rows, mid) - wanted[rows]
        out[rows] = mid
        go = np.abs(gap) > TOLERANCE
        up = gap < 0
        low, high = np.where(up, mid, low)[go], np.where(up, high, mid)[go]
        rows = rows[go]
    return out


GREEKS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("iv", "delta", "gamma", "theta", "vega", "rho")] + [T.StructField("reason", T.StringType())])


def greeks_of(side: pd.Series, spot: pd.Series, strike: pd.Series, dte: pd.Series, rate: pd.Series, bid: pd.Series, ask: pd.Series) -> pd.DataFrame:
    """iv, delta, gamma, theta a day, vega and rho a point; NaN and a reason where the midpoint has no volatility."""
    call = (side == "call").to_numpy()
    s, k, r = (x.to_numpy(float) for x in (spot, strike, rate))
    years = dte.to_numpy(float) / 365.0
    middle = (bid.to_numpy(float) + ask.to_numpy(float)) / 2
    with np.errstate(all="ignore"):
        lower = np.where(call, s - k * np.exp(-r * years), k * np.exp(-r * years) - s).clip(min=0)
        upper = np.where(call, s, k)
        reason = np.select([~(years > 0), ~(middle > 0), middle <= lower + EDGE, middle >= upper], ["expired", "no_midpoint", "below_bound", "above_bound"], "")
        sigma = implied(call, s, k, np.where(reason == "", years, 0.0), r, middle)
        reason = np.where((reason == "") & np.isnan(sigma), "no_volatility", reason)
        root = np.sqrt(years)
        d1 = (np.log(s / k) + (r + 0.5 * sigma * sigma) * years) / (sigma * root)
        d2 = d1 - sigma * root
        density = np.exp(-0.5 * d1 * d1) / math.sqrt(2 * math.pi)
        sign = np.where(call, 1.0, -1.0)
        fine = ~np.isnan(sigma)
        one, two = np.full(len(s), np.nan), np.full(len(s), np.nan)
        one[fine], two[fine] = normal_cdf((sign * d1)[fine]), normal_cdf((sign * d2)[fine])
        discount = k * np.exp(-r * years)
        theta = (-s * density * sigma / (2 * root) - sign * r * discount * two) / 365.0
    return pd.DataFrame({"iv": sigma, "delta": sign * one, "gamma": density / (s * sigma * root), "theta": theta, "vega": s * density * root / 100, "rho": sign * discount * years * two / 100, "reason": pd.Series(reason).where(reason != "", None)})


@F.pandas_udf(GREEKS)
def greeks(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Column function over (side, spot, strike, dte, rate, bid, ask)."""
    for columns in batches:
        yield greeks_of(*columns)


ENDPOINT = T.StructType([T.StructField("tenths", T.LongType()), T.StructField("reason", T.StringType())])


def endpoints_of(side: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, quoted: pd.Series) -> pd.DataFrame:
    """Volatility in tenths of a percent of a quoted price strictly inside the European bounds, else a reason.

    ``model_bounds``: not positive or not inside; ``solver_range``: no volatility
    between LOW and HIGH has it; ``numerical_failure``: the search doesn't end at it.
    """
    call = (side == "call").to_numpy()
    s, k, y, r, p = (x.to_numpy(float) for x in (spot, strike, years, rate, quoted))
    with np.errstate(all="ignore"):
        discounted = k * np.exp(-r * y)
        lower = np.where(call, s - discounted, discounted - s).clip(min=0)
        inside = np.isfinite(s) & np.isfinite(k) & np.isfinite(y) & np.isfinite(r) & (np.minimum(np.minimum(s, k), np.minimum(y, p)) > 0) & (lower < p) & (p < np.where(call, s, discounted))
        sigma, fits, ranged = np.full(len(s), np.nan), np.zeros(len(s), bool), np.zeros(len(s), bool)
        rows = np.flatnonzero(inside)
        at = lambda v: price(call[rows], s[rows], k[rows], y[rows], r[rows], v)
        if len(rows):
            ranged[rows] = (at(np.full(len(rows), LOW)) <= p[rows]) & (p[rows] <= at(np.full(len(rows), HIGH)))
            sigma[rows] = implied(call[rows], s[rows], k[rows], y[rows], r[rows], p[rows])
            fits[rows] = np.abs(at(np.nan_to_num(sigma[rows], nan=1.0)) - p[rows]) <= TOLERANCE
    reason = np.select([~inside, ~ranged, np.isnan(sigma) | ~fits], ["model_bounds", "solver_range", "numerical_failure"], "")
    tenths = pd.Series(np.floor(sigma * 1000 + 0.5)).where(reason == "").astype("Int64")
    return pd.DataFrame({"tenths": tenths, "reason": pd.Series(reason).where(reason != "", None)})


@F.pandas_udf(ENDPOINT)
def endpoint_iv(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Column function over (side, spot, strike, years, rate, price)."""
    for columns in batches:
        yield endpoints_of(*columns)
