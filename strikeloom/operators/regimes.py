"""Risk-neutral odds from one two-regime volatility model a ticker, fitted to its quotes and checked against those held out.

The model's prices are Fourier integrals on Gauss-Legendre nodes; a price counts
only if three cutoffs agree. A ticker's fit sees at most four expiries of five quotes,
which Spark picks; every quote is then priced by itself, in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.operators.odds import vertical_bounds
from strikeloom.operators.quantiles import matched

# fixed values: cutoffs, starts, bounds and limits that decide which fits and prices count
CUTOFFS = (128.0, 256.0, 512.0)
STARTS = ((0.18, 0.38, 2.0, 2.0), (0.38, 0.18, 2.0, 2.0))
LOWEST, HIGHEST = np.array([0.07, 0.07, 0.05, 0.05]), np.array([1.5, 1.5, 12.0, 12.0])
MOST_CALLS, CLOSE = 24, 1e-4
MOST_RMS, NEAR_COST, APART = 1.25, (1.15, 0.1), 0.03
PARAMETERS = ("low", "high", "out", "back")


@lru_cache(maxsize=8)
def nodes_of(cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on [0, cutoff], as dense at every cutoff."""
    x, w = np.polynomial.legendre.leggauss(int(1.5 * cutoff))
    return (x + 1) * cutoff / 2, w * cutoff / 2


def characteristic(p: np.ndarray, years: float, u: np.ndarray) -> np.ndarray:
    """Characteristic function of the log of price over forward, from the first regime: the first row of a 2 by 2 matrix exponential."""
    low, high, out, back = (float(x) for x in p)
    power = -(u * u + 1j * u) / 2
    a, d = years * (low * low * power - out), years * (high * high * power - back)
    middle, half = (a + d) / 2, (a - d) / 2
    root = np.sqrt(half * half + years * years * out * back)
    root = np.where(np.abs(root) < 1e-12, 1e-12, root)
    share = (half + years * out) / root
    return (np.exp(middle + root) * (1 + share) + np.exp(middle - root) * (1 - share)) / 2


def calls(p: np.ndarray, spot: float, rate: float, years: float, strikes: np.ndarray, cutoff: float) -> np.ndarray:
    """Call prices of strikes of one expiry."""
    u, w = nodes_of(cutoff)
    forward = spot * math.exp(rate * years)
    phi = characteristic(p, years, u - 0.5j)
    waves = np.exp(1j * np.outer(np.log(forward / strikes), u))
    integral = (waves * (phi * w / (u * u + 0.25))).real.sum(axis=1)
    return math.exp(-rate * years) * (forward - np.sqrt(forward * strikes) * integral / math.pi)


def digitals(p: np.ndarray, spot: float, rate: float, years: float, strikes: np.ndarray, cutoff: float) -> np.ndarray:
    """Discounted chances of ending above strikes of one expiry."""
    u, w = nodes_of(cutoff)
    phi = characteristic(p, years, u.astype(complex))
    waves = np.exp(-1j * np.outer(np.log(strikes / spot) - rate * years, u))
    return math.exp(-rate * years) * (0.5 + (waves * (phi * w / (1j * u))).real.sum(axis=1) / math.pi)


def converged(kind: Callable, p: np.ndarray, spot: float, rate: float, years: float, strikes: np.ndarray) -> np.ndarray:
    """Values at the largest cutoff; NaN where the three cutoffs don't agree or the slowest regime's tail reaches beyond it."""
    if min(p[0], p[1]) * math.sqrt(years) * CUTOFFS[-1] < 7:
        return np.full(len(strikes), np.nan)
    allowed = 0.002 if kind is digitals else max(0.01, 0.0002 * spot)
    with np.errstate(all="ignore"):
        a, b, c = (kind(p, spot, rate, years, strikes, cutoff) for cutoff in CUTOFFS)
        return np.where((np.abs(b - c) <= allowed) & (np.abs(a - b) <= 2 * allowed), c, np.nan)


def bounded_least_squares(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = MOST_CALLS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Box-constrained Levenberg-Marquardt: the best point and half its sum of squares, after ``most`` trials at the most.

    A parameter at a bound that the descent would push through it is held; steps are
    cut at the box. Ends when cost, step or projected slope is next to nothing.
    """
    x = np.clip(np.asarray(start, float), low, high)
    r = f(x)
    cost, damping, trials = 0.5 * float(r @ r), 1e-3, 1
    while trials < most:
        step = np.sqrt(np.finfo(float).eps) * np.maximum(1.0, np.abs(x))
        step = np.where(x + step > high, -step, step)
        jacobian = np.column_stack([(f(x + np.where(np.arange(len(x)) == j, step, 0)) - r) / step[j] for j in range(len(x))])
        slope = jacobian.T @ r
        free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        if not free.any() or np.abs(slope[free]).max() < close:
            break
        better = False
        while trials < most:
            normal = jacobian[:, free].T @ jacobian[:, free]
            move = np.zeros(len(x))
            move[free] = np.linalg.lstsq(normal + damping * np.diag(np.maximum(np.diag(normal), 1e-12)), -slope[free], rcond=None)[0]
            new = np.clip(x + move, low, high)
            value = f(new)
            trials += 1
            new_cost = 0.5 * float(value @ value)
            if new_cost < cost:
                gained, moved = cost - new_cost, float(np.linalg.norm(new - x))
                done = gained < close * cost or moved < close * (close + float(np.linalg.norm(x)))
                x, r, cost, damping, better = new, value, new_cost, max(damping / 5, 1e-12), not done
                break
            damping *= 4
            if float(np.linalg.norm(new - x)) < close * (close + float(np.linalg.norm(x))):
                break
        if not better:
            break
    return x, cost


def fitted(quotes: pd.DataFrame) -> tuple[np.ndarray | None, float | None, str | None]:
    """Parameters, root mean square error in spreads, and why there's no fit: of one ticker's sample (expiry, strike, years, rate, bid, ask, held_out, spot)."""
    train = quotes[~quotes["held_out"]]
    if len(train) < 6 or quotes["held_out"].sum() < 2:
        return None, None, "too_few_quotes"
    spot = float(quotes["spot"].iloc[0])
    mid, width = ((train["bid"] + train["ask"]) / 2).to_numpy(), np.maximum(0.05, train["ask"] - train["bid"]).to_numpy()
    terms = [(years, rate, np.flatnonzero((train["years"] == years) & (train["rate"] == rate))) for years, rate in sorted(set(zip(train["years"], train["rate"], strict=True)))]
    strikes = train["strike"].to_numpy()

    def error(p: np.ndarray) -> np.ndarray:
        out = np.empty(len(train))
        with np.errstate(all="ignore"):
            for years, rate, at in terms:
                out[at] = (calls(p, spot, rate, years, strikes[at], CUTOFFS[0]) - mid[at]) / width[at]
        return out if np.isfinite(out).all() else np.full(len(train), 1e6)

    solutions = sorted((bounded_least_squares(error, np.array(s), LOWEST, HIGHEST) for s in STARTS), key=lambda s: s[1])
    best, cost = solutions[0]
    rms = math.sqrt(2 * cost / len(train))
    if rms > MOST_RMS:
        return None, rms, "poor_fit"
    slack = max(0.05, 0.0005 * spot)
    for q in quotes.itertuples():
        value = converged(calls, best, spot, q.rate, q.years, np.array([q.strike]))[0]
        if not math.isfinite(value):
            return None, rms, "numerical_unstable"
        if not q.bid - slack <= value <= q.ask + slack:
            return None, rms, "held_out_missed" if q.held_out else "train_missed"
    if solutions[1][1] <= cost * NEAR_COST[0] + NEAR_COST[1]:
        for q in quotes[quotes["held_out"]].itertuples():
            a, b = (digitals(s[0], spot, q.rate, q.years, np.array([q.strike]), CUTOFFS[-1])[0] for s in solutions[:2])
            if abs(a - b) * math.exp(q.rate * q.years) > APART:
                return None, rms, "two_solutions"
    return best, rms, None


def usable(quotes: DataFrame) -> DataFrame:
    """``quotes`` with ``reason``: why a quote can't be priced, by contract, term, quote and spot; null if it can.

    ``quotes``: ticker, expiry, strike, spot, years, rate, bid, ask, oi, volume and
    ``standard``. Contracts that are there twice are ambiguous, whatever they hold.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < 1e300)
    bid, ask, spot = F.col("bid"), F.col("ask"), F.col("spot")
    active = (F.coalesce("oi", F.lit(0)) >= 5) | (F.coalesce("volume", F.lit(0)) >= 5)
    narrow = ask - bid <= F.greatest(F.lit(0.25), 0.25 * (bid + ask) / 2)
    good = number("bid") & number("ask") & number("strike") & (F.col("strike") > 0) & (bid >= 0) & (ask > bid) & (ask < spot) & active & narrow
    reason = F.when(~(number("spot") & (spot > 0)), "invalid_spot").when(F.count("*").over(W.partitionBy("ticker", "expiry", "strike")) > 1, "duplicate_contract")
    reason = reason.when(~F.coalesce("standard", F.lit(False)), "invalid_contract").when(F.col("years") <= 0, "expired")
    reason = reason.when(~(number("years") & number("rate") & F.col("rate").between(0, 0.25)), "rate_unavailable").when(~F.coalesce(good, F.lit(False)), "invalid_quote")
    return quotes.withColumn("reason", reason)


def fit_quotes(quotes: DataFrame) -> DataFrame:
    """The quotes that a ticker's fit sees, with ``held_out``: of up to four expiries over its whole term the five nearest the spot, the farthest of which is held out.

    Expiries are at least 21 days off and have three quotes or more within a fifth of
    the spot and worth 0.20 or more.
    """
    near = quotes.filter((F.col("years") >= 21 / 365) & F.try_divide("strike", "spot").between(0.8, 1.2) & ((F.col("bid") + F.col("ask")) / 2 >= 0.2))
    w = W.partitionBy("ticker", "expiry")
    rows = near.withColumns({"n": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.abs(F.log(F.try_divide("strike", "spot"))), "strike"))}).filter("n >= 3 and place <= 5")
    terms = rows.select("ticker", "expiry").distinct()
    t = W.partitionBy("ticker")
    terms = terms.withColumns({"i": F.row_number().over(t.orderBy("expiry")) - 1, "size": F.count("*").over(t)}).filter("size >= 2")
    steps = F.least(F.lit(3), F.col("size") - 1)
    chosen = F.transform(F.sequence(F.lit(0), F.least(F.lit(4), F.col("size")).cast("int") - 1), lambda k: F.bround(k * (F.col("size") - 1) / steps, 0).cast("long"))
    terms = terms.filter(F.array_contains(chosen, F.col("i").cast("long"))).select("ticker", "expiry")
    return matched(rows, terms, ["ticker", "expiry"], "left_semi").withColumn("held_out", F.col("place") == F.least("n", F.lit(5))).drop("n", "place")


def fits(sample: DataFrame) -> DataFrame:
    """ticker, PARAMETERS, rms, fit_reason: of each ticker's sample (``fit_quotes``), at most 20 rows a group."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        p, rms, why = fitted(frame.sort_values(["expiry", "strike"]))
        return pd.DataFrame([[frame["ticker"].iloc[0], *(p if p is not None else [None] * 4), rms, why]], columns=["ticker", *PARAMETERS, "rms", "fit_reason"])

    given = sample.select("ticker", F.col("expiry").cast("string").alias("expiry"), *[F.col(c).cast("double").alias(c) for c in ("strike", "spot", "years", "rate", "bid", "ask")], "held_out")
    return given.groupBy("ticker").applyInPandas(fit, f"ticker string, {', '.join(f'{c} double' for c in PARAMETERS)}, rms double, fit_reason string")


def model_values(low: Column, high: Column, out: Column, back: Column, spot: Column, rate: Column, years: Column, strike: Column) -> Column:
    """struct(call, digital): converged values of each row, null where a parameter is null or cutoffs don't agree."""

    @F.pandas_udf("call double, digital double")
    def each(low: pd.Series, high: pd.Series, out: pd.Series, back: pd.Series, spot: pd.Series, rate: pd.Series, years: pd.Series, strike: pd.Series) -> pd.DataFrame:
        values = pd.DataFrame(np.nan, index=low.index, columns=["call", "digital"])
        rows = pd.DataFrame({"low": low, "high": high, "out": out, "back": back, "spot": spot, "rate": rate, "years": years, "strike": strike})
        rows = rows.dropna()
        rows = rows[(rows["years"] > 0) & (rows["strike"] > 0) & (rows["spot"] > 0)]
        for (a, b, c, d, s, r, y), part in rows.groupby(["low", "high", "out", "back", "spot", "rate", "years"], sort=False):
            for at in range(0, len(part), 256):
                k = part.index[at : at + 256]
                for name, kind in (("call", calls), ("digital", digitals)):
                    values.loc[k, name] = converged(kind, np.array([a, b, c, d]), s, r, y, part["strike"].loc[k].to_numpy())
        return values

    return each(low, high, out, back, spot, rate, years, strike)


def market_odds(quotes: DataFrame) -> DataFrame:
    """One row a contract (ticker, expiry, strike): ``p`` (chance of ending above), its bounds, ``reason`` where there's none, ``held_out_price`` of quotes held out.

    ``quotes`` as for ``usable``. A chance is published only if the fit, three cutoffs,
    the quote itself and the vertical spreads of its expiry agree, and no chance of
    the expiry rises with the strike.
    """
    key = ["ticker", "expiry", "strike"]
    rows = usable(quotes)
    good = rows.filter("reason is null")
    sample = fit_quotes(good)
    models = fits(sample)
    first = rows.groupBy(*key).agg(F.max("reason").alias("reason"))
    growth = F.exp(F.col("rate") * F.col("years"))
    bounds = vertical_bounds(good.select("ticker", F.col("expiry").cast("string").alias("month"), "strike", (F.col("bid") * growth).alias("bid"), (F.col("ask") * growth).alias("ask")), clamped=False)
    bounds = bounds.withColumnRenamed("month", "expiry_text").withColumns({"upper": F.when(F.col("upper") > 1, 1.0).otherwise(F.col("upper")), "lower": F.when(F.col("lower") < 0, 0.0).otherwise(F.col("lower"))})
    priced = good.drop("reason").withColumn("expiry_text", F.col("expiry").cast("string")).join(models, "ticker", "left").join(bounds, ["ticker", "expiry_text", "strike"], "left")
    priced = priced.withColumn("v", model_values(*[F.col(c) for c in (*PARAMETERS, "spot", "rate", "years")], F.col("strike")))
    p, vanilla = F.col("v.digital") * growth, F.col("v.call")
    why = (
        F.when(F.col("low").isNull(), "calibration_failed").when(F.col("lower").isNull() | F.col("upper").isNull(), "quote_bracket_missing").when(F.col("lower") > F.col("upper"), "quote_bounds_inconsistent")
        .when(vanilla.isNull() | F.isnan(vanilla) | p.isNull() | F.isnan(p), "numerical_unstable").when(~vanilla.between(F.col("bid") - 0.05, F.col("ask") + 0.05), "quote_fit_failed")
        .when(~p.between(0, 1), "numerical_unstable").when(~p.between(F.col("lower"), F.col("upper")), "quote_bounds_mismatch")
    )
    priced = priced.withColumns({"why": why, "p": p, "price": vanilla})
    held = matched(priced, sample.filter("held_out").select(*key, F.lit(True).alias("held_out")), key).select(*key, "why", "p", "lower", "upper", F.when(F.col("held_out") & F.col("low").isNotNull(), F.col("price")).alias("held_out_price"))
    held = held.withColumn("p", F.when(F.col("why").isNull(), F.col("p")))
    # among published chances alone
    before = F.last("p", True).over(W.partitionBy("ticker", "expiry").orderBy("strike").rowsBetween(W.unboundedPreceding, -1))
    rising = held.withColumn("rises", F.coalesce(before < F.col("p") - 0.001, F.lit(False))).withColumn("broken", F.max("rises").over(W.partitionBy("ticker", "expiry")))
    held = rising.withColumns({"why": F.when(F.col("why").isNull() & F.col("broken"), "nonmonotone_odds").otherwise(F.col("why")), "p": F.when(~F.col("broken"), F.col("p"))})
    out = matched(first, held.select(*key, "why", "p", "lower", "upper", "held_out_price"), key)
    published = F.col("p").isNotNull()
    return out.select(*key, "p", F.when(published, F.col("lower")).alias("lower"), F.when(published, F.col("upper")).alias("upper"), F.coalesce("reason", "why").alias("reason"), "held_out_price")
