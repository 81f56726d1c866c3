"""Odds from the decreasing, convex call curve nearest to an expiry's quotes.

The curve is a quadratic programme, solved by a dual active set method that ends
with the optimum or with a certificate that no such curve lies within the quotes. An
expiry has at most 80 strikes, or it isn't fitted; so no group is larger.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.operators.odds import vertical_bounds
from strikeloom.operators.quantiles import matched

# fixed values: strikes of a curve, the tick, and how far a chance may move with one
FEWEST, MOST, TICK, MOST_MOVE = 5, 80, 0.01, 0.03
SLACK = 1e-9


def nearest(a: np.ndarray, b: np.ndarray, start: list[int] | None = None) -> tuple[np.ndarray | None, list[int], dict[int, float]]:
    """The shortest x with a x >= b: x and the constraints that hold it, or None and a certificate.

    A certificate gives weights y > 0 of constraints with y a = 0 and y b > 0, which no
    x can meet. ``start`` are constraints to try first (of a solution nearby); rows of
    ``a`` should have length 1.
    """
    active: list[int] = []
    weights = np.zeros(0)
    for k in start or []:
        # constraints that don't pull are left out, until all do
        trial = [*active, k]
        n = a[trial]
        y, *_ = np.linalg.lstsq(n @ n.T, b[trial], rcond=None)
        if (y > 0).all() and np.abs(n @ (n.T @ y) - b[trial]).max() < SLACK:
            active, weights = trial, y
    x = a[active].T @ weights if active else np.zeros(a.shape[1])
    while True:
        gap = a @ x - b
        worst = int(np.argmin(gap))
        if gap[worst] >= -SLACK:
            return x, active, {}
        row, pull = a[worst], 0.0
        while True:
            n = a[active]
            share = np.linalg.lstsq(n.T, row, rcond=None)[0] if active else np.zeros(0)
            free = row - n.T @ share if active else row
            length = float(free @ free)
            full = -(float(row @ x) - b[worst]) / length if length > 1e-14 else math.inf
            lets = np.flatnonzero(share > 1e-12)
            ratios = weights[lets] / share[lets]
            part = float(ratios.min()) if len(lets) else math.inf
            if math.isinf(full) and math.isinf(part):
                certificate = {worst: 1.0} | {k: float(-s) for k, s in zip(active, share, strict=True) if -s > 1e-12}
                return None, active, certificate
            step = min(full, part)
            if not math.isinf(full):
                x = x + step * free
            weights, pull = weights - step * share, pull + step
            if full <= part:
                active, weights = [*active, worst], np.append(weights, pull)
                break
            gone = int(lets[int(ratios.argmin())])
            active, weights = active[:gone] + active[gone + 1 :], np.delete(weights, gone)


def programme(strikes: np.ndarray, bid: np.ndarray, ask: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Constraints a x >= b of unit rows for x = (price - mid) / spread; mid and spread.

    Prices lie within quotes, the first slope isn't under -discount, the last not over
    0, and slopes don't fall; so all slopes lie between.
    """
    n, mid, spread = len(strikes), (bid + ask) / 2, np.maximum(ask - bid, TICK)
    gap = np.diff(strikes)
    slopes = np.zeros((n - 1, n))
    slopes[np.arange(n - 1), np.arange(n - 1)], slopes[np.arange(n - 1), np.arange(1, n)] = -1 / gap, 1 / gap
    rows = np.vstack([np.eye(n), -np.eye(n), slopes[:1], -slopes[-1:], np.diff(slopes, axis=0)])
    least = np.concatenate([bid, -ask, [-discount, 0.0], np.zeros(n - 2)])
    a, b = rows * spread, least - rows @ mid
    size = np.linalg.norm(a, axis=1)
    return a / size[:, None], b / size, mid, spread


def curve(strikes: np.ndarray, bid: np.ndarray, ask: np.ndarray, discount: float, start: list[int] | None = None) -> tuple[np.ndarray | None, list[int], dict[int, float]]:
    """Prices of the nearest curve, or None with a certificate (``nearest``)."""
    if len(strikes) < 3 or (np.diff(strikes) <= 0).any() or (bid < 0).any():
        return None, [], {}
    a, b, mid, spread = programme(strikes, bid, ask, discount)
    x, active, certificate = nearest(a, b, start)
    return (None if x is None else mid + spread * x), active, certificate


def chances(strikes: np.ndarray, prices: np.ndarray, discount: float) -> np.ndarray:
    """Chance above each inner strike: the mean of both slopes; it never rises (what numbers of 64 bits add is taken off)."""
    slope = np.diff(prices) / np.diff(strikes)
    return np.minimum.accumulate(np.clip(-(slope[1:] + slope[:-1]) / (2 * discount), 0.0, 1.0))


def expiry_odds(strikes: np.ndarray, bid: np.ndarray, ask: np.ndarray, discount: float, held: list[int] | None = None) -> dict[str, list]:
    """``p`` and ``reason`` of each strike of an expiry, and of those ``held`` out whether the others' curve passes within their quotes (``inside``; None if there's none).

    A chance is given only if it moves by less than MOST_MOVE when the quote of the
    strike or of a neighbour moves by a tick either way.
    """
    n = len(strikes)
    held = list(range(2, n - 2, 5)) if held is None else held
    inside: list[bool | None] = [None] * n
    missed: list[str | None] = [None] * n
    if held:
        stay = np.setdiff1d(np.arange(n), held)
        rest = curve(strikes[stay], bid[stay], ask[stay], discount)[0]
        place = {int(k): i for i, k in enumerate(stay)}
        for k in held:
            if rest is None:
                missed[k] = "held_out_curve_fit_failed"
            elif k - 1 not in place or k + 1 not in place:
                missed[k] = "held_out_bracket_missing"
            else:
                value = float(np.interp(strikes[k], strikes[[k - 1, k + 1]], rest[[place[k - 1], place[k + 1]]]))
                inside[k] = bool(bid[k] <= value <= ask[k])
    prices, active, _ = curve(strikes, bid, ask, discount)
    if prices is None:
        return {"p": [None] * n, "reason": ["infeasible_curve"] * n, "inside": inside, "missed": missed}
    p = chances(strikes, prices, discount)
    worst = np.zeros(n)
    for k in range(n):
        for way in (-TICK, TICK):
            shift = np.where(np.arange(n) == k, way, 0.0)
            moved = curve(strikes, bid + shift, ask + shift, discount, active)[0]
            near = range(max(1, k - 1), min(n - 1, k + 2))
            if moved is None:
                worst[list(near)] = np.inf
            else:
                off = np.abs(chances(strikes, moved, discount) - p)
                for i in near:
                    worst[i] = max(worst[i], off[i - 1])
    reason = [None if 0 < k < n - 1 and worst[k] <= MOST_MOVE else "one_tick_unstable" if 0 < k < n - 1 else "quote_bracket_missing" for k in range(n)]
    return {"p": [None if r else float(p[k - 1]) for k, r in enumerate(reason)], "reason": reason, "inside": inside, "missed": missed}


def curve_odds(quotes: DataFrame) -> DataFrame:
    """One row a quote (ticker, expiry, strike): ``p``, ``lower``, ``upper``, ``reason``, and ``held_out``, ``inside``, ``missed`` of quotes held out.

    ``quotes``: ticker, expiry, strike, years, rate, bid, ask, all usable; with a
    ``held_out`` column those are held out, else every fifth strike. Expiries with a
    strike twice, or with fewer than 5 or more than 80 strikes, have a reason and are
    never grouped.
    """
    own = "held_out" in quotes.columns
    w = W.partitionBy("ticker", "expiry")
    rows = quotes.select("ticker", F.col("expiry").cast("string").alias("expiry"), *[F.col(c).cast("double").alias(c) for c in ("strike", "years", "rate", "bid", "ask")], (F.col("held_out") if own else F.lit(False)).alias("held_out"))
    rows = rows.withColumn("n", F.count("*").over(w))
    twice = rows.groupBy("ticker", "expiry", "strike").agg(F.count("*").alias("same")).groupBy("ticker", "expiry").agg(F.max("same").alias("same"))
    rows = matched(rows, twice, ["ticker", "expiry"])
    out_of_place = F.when(F.col("same") > 1, "duplicate_strike").when(~F.col("n").between(FEWEST, MOST), "sparse_or_large_strip")
    rows = rows.withColumn("unfit", out_of_place).drop("n", "same")
    columns = ["ticker", "expiry", "strike", "p", "reason", "held_out", "inside", "missed"]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("strike").reset_index(drop=True)
        held = [int(k) for k in np.flatnonzero(frame["held_out"])] if own else list(range(2, len(frame) - 2, 5))
        found = expiry_odds(*(frame[c].to_numpy(float) for c in ("strike", "bid", "ask")), math.exp(-float(frame["rate"].iloc[0]) * float(frame["years"].iloc[0])), held)
        for c, values in found.items():
            frame[c] = pd.Series(values, dtype=object)
        frame["held_out"] = frame.index.isin(held)
        return frame[columns]

    odds = rows.filter("unfit is null").groupBy("ticker", "expiry").applyInPandas(fit, "ticker string, expiry string, strike double, p double, reason string, held_out boolean, inside boolean, missed string")
    growth = F.exp(F.col("rate") * F.col("years"))
    bounds = vertical_bounds(rows.filter("unfit is null").select("ticker", F.col("expiry").alias("month"), "strike", (F.col("bid") * growth).alias("bid"), (F.col("ask") * growth).alias("ask")), clamped=False).withColumnRenamed("month", "expiry")
    bounds = bounds.withColumns({"upper": F.when(F.col("upper") > 1, 1.0).otherwise(F.col("upper")), "lower": F.when(F.col("lower") < 0, 0.0).otherwise(F.col("lower"))})
    odds = odds.join(bounds, ["ticker", "expiry", "strike"])
    kept = F.col("reason").isin("infeasible_curve", "quote_bracket_missing")
    wrong = F.when(kept, F.col("reason")).when(F.col("lower") > F.col("upper"), "quote_bounds_inconsistent").when(F.col("p").isNotNull() & ~F.col("p").between(F.col("lower") - 1e-6, F.col("upper") + 1e-6), "quote_bounds_mismatch").otherwise(F.col("reason"))
    odds = odds.withColumn("reason", wrong).withColumn("p", F.when(F.col("reason").isNull(), F.col("p")))
    odds = odds.select(*columns, *[F.when(F.col("p").isNotNull(), F.col(c)).alias(c) for c in ("lower", "upper")])
    spare = rows.filter("unfit is not null").select("ticker", "expiry", "strike", F.lit(None).cast("double").alias("p"), F.col("unfit").alias("reason"), "held_out", F.lit(None).cast("boolean").alias("inside"), F.lit(None).cast("string").alias("missed"), *[F.lit(None).cast("double").alias(c) for c in ("lower", "upper")])
    return odds.unionByName(spare)


def curve_counters(odds: DataFrame, by: list[str]) -> DataFrame:
    """Published chances, quotes held out, those predicted and those inside, and how often each reason was given (contracts, expiries and held-out quotes)."""
    sums = odds.groupBy(*by).agg(F.count("*").alias("quotes"), F.count("p").alias("published"), F.count_if("held_out").alias("held_out"), F.count("inside").alias("predicted"), F.count_if("inside").alias("inside"))
    why = odds.select(*by, F.explode(F.array_compact(F.array("reason", "missed"))).alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))
    why = why.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("reasons"))
    return matched(sums, why, by)
