"""Option-chain metrics, filters, lows, flags and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators.quantiles import counted, matched

MINIMUM_OPEN_INTEREST = 5


def moneyness(side: Column, spot: Column, strike: Column) -> Column:
    """itm, atm or otm of a quote."""
    return M.classify(side, spot, strike)


def passes_moneyness(quotes: DataFrame, wanted: str = "all") -> DataFrame:
    """Rows in (itm) or out of (otm) the money; neither takes those at the money."""
    if wanted == "all":
        return quotes
    return quotes.filter(moneyness(F.col("side"), F.col("spot"), F.col("strike")) == wanted)


def decision_metrics(quotes: DataFrame) -> DataFrame:
    """net_premium_cents, breakeven_cents, apr_tenths, to_assignment_tenths of each quote.

    The premium is net of intrinsic value; the rate is over the breakeven's
    capital and a year, null where capital or days to expiry aren't positive.
    """
    side, spot, strike, bid, dte = (F.col(c) for c in ("side", "spot", "strike", "bid", "dte"))
    intrinsic = F.greatest(F.lit(0.0), F.when(side == "call", spot - strike).otherwise(strike - spot))
    net = (bid - intrinsic) * M.SHARES
    breakeven = F.when(side == "call", spot - bid).otherwise(strike - bid)
    apr = F.when((breakeven > 0) & (dte > 0), net / (breakeven * M.SHARES) * M.YEAR / dte * 100)
    return quotes.withColumns({"net_premium_cents": M.cents(net), "breakeven_cents": M.cents(breakeven), "apr_tenths": M.tenths(apr), "to_assignment_tenths": M.tenths(F.abs((strike - spot) / spot) * 100)})


def call_metrics(quotes: DataFrame) -> DataFrame:
    """Covered-call columns: outlay, profit if called, rates over outlay and over stock."""
    spot, strike, bid, dte = (F.col(c) for c in ("spot", "strike", "bid", "dte"))
    outlay = spot * 100 - bid * 100
    profit = bid * 100 - (spot - strike) * 100
    rate = lambda base: M.tenths(F.when((base > 0) & (dte > 0), profit / base * M.YEAR / dte * 100))
    return quotes.filter("side = 'call'").withColumns({"outlay_cents": M.cents(outlay), "called_profit_cents": M.cents(profit), "apr_outlay_tenths": rate(outlay), "apr_stock_tenths": rate(spot * 100)})


def put_metrics(quotes: DataFrame) -> DataFrame:
    """Cash-secured-put columns: collateral, net collateral, rates over each, cushion."""
    spot, strike, bid, dte = (F.col(c) for c in ("spot", "strike", "bid", "dte"))
    collateral = strike * 100
    net = collateral - bid * 100
    rate = lambda base: M.tenths(F.when((base > 0) & (dte > 0), bid * 100 / base * M.YEAR / dte * 100))
    cushion = M.tenths(M.ratio_pct(spot - (strike - bid), spot))
    return quotes.filter("side = 'put'").withColumns({"collateral_cents": M.cents(collateral), "net_collateral_cents": M.cents(net), "apr_collateral_tenths": rate(collateral), "apr_net_tenths": rate(net), "cushion_tenths": cushion})


def spreads(quotes: DataFrame) -> DataFrame:
    """spread_cents and spread_tenths (percent of the midpoint, null where that isn't positive)."""
    bid, ask = F.col("bid"), F.col("ask")
    return quotes.withColumns({"spread_cents": M.cents(ask - bid), "spread_tenths": M.tenths(M.ratio_pct(ask - bid, (ask + bid) / 2))})


def passes(quotes: DataFrame, minimum: dict[str, int], maximum: dict[str, int]) -> DataFrame:
    """All thresholds at once; a null value fails only the thresholds on its own column."""
    for name, least in minimum.items():
        quotes = quotes.filter(F.col(name) >= least)
    for name, most in maximum.items():
        quotes = quotes.filter(F.col(name) <= most)
    return quotes


def quote_issue(quotes: DataFrame) -> DataFrame:
    """``issue``: the first reason why a quote can't be entered, null if it can."""
    bid, ask, oi = F.col("bid"), F.col("ask"), F.col("oi")
    cap = F.when(F.col("side") == "call", F.col("spot")).otherwise(F.col("strike"))
    wide = ask - bid > F.greatest(F.lit(0.25), (ask + bid) / 2 * 0.25)
    issue = F.when(bid.isNull() | ask.isNull() | (bid <= 0), "missing_quote").when(ask < bid, "crossed").when(ask == bid, "locked").when(ask >= cap, "above_cap").when(oi < MINIMUM_OPEN_INTEREST, "inactive").when(wide, "wide_spread")
    return quotes.withColumn("issue", issue)


def period_lows(stocks: DataFrame, as_of: str, windows: tuple[int, ...] = (7, 30, 90, 365)) -> DataFrame:
    """Lowest positive low of each ticker in [as_of - n days, as_of), one column for each n: one pass, no join."""
    day = F.lit(as_of).cast("date")
    inside = lambda n: (F.col("ts") >= F.date_sub(day, n)) & (F.col("ts") < day) & (F.col("low") > 0)
    kept = stocks.filter((F.col("ts") >= F.date_sub(day, max(windows))) & (F.col("ts") < day))
    return kept.groupBy("ticker").agg(*[F.min(F.when(inside(n), M.cents(F.col("low")))).alias(f"low_{n}") for n in windows])


def duplicates(quotes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose key occurs more than once: ``copies``, and ``kept`` on the first in ``order``."""
    w = W.partitionBy(*key)
    return quotes.withColumns({"copies": F.count("*").over(w), "kept": F.row_number().over(w.orderBy(*order)) == 1}).filter("copies > 1")


def heat_ranges(quotes: DataFrame, metric: str) -> DataFrame:
    """Least, largest and number of a metric in each ticker and expiry month."""
    return quotes.groupBy("ticker", F.date_format("expiry", "yyyy-MM").alias("month")).agg(F.min(metric).alias("least"), F.max(metric).alias("most"), F.count(metric).alias("known"), F.count("*").alias("n"))


def keyset_page(rows: DataFrame, key: str, after: object, n: int) -> DataFrame:
    """The ``n`` rows after a key, in its order."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(n)


def reveal(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows over groups in order: a limit that Spark takes from each task, not a global window."""
    return rows.orderBy(F.col(group), *order).limit(n)


def nearest_expiry(quotes: DataFrame, wanted: int) -> DataFrame:
    """For each ticker the days to expiry nearest to ``wanted`` (the shorter in a tie)."""
    distance = F.struct(F.abs(F.col("dte") - wanted).alias("distance"), F.col("dte"))
    return quotes.filter("dte > 0").groupBy("ticker").agg(F.min(distance).alias("d")).select("ticker", F.col("d.dte").alias("dte"))


def search_tickers(names: DataFrame, query: str, n: int) -> DataFrame:
    """Tickers that begin with the query first, then names that contain it."""
    q = query.upper()
    starts = F.upper("ticker").startswith(q)
    hit = names.filter(starts | F.upper("name").contains(q))
    return hit.withColumn("rank", F.when(starts, 0).otherwise(1)).orderBy("rank", "ticker").limit(n)


POLICIES = {
    "max_apr": {"call": (0.90, 1.0, None), "put": (0.90, 1.0, None)},
    "near_atm": {"call": (0.975, 1.0, 1.0), "put": (0.975, 1.0, 1.0)},
    "five_below": {"call": (0.925, 0.975, 0.95), "put": (0.925, 0.975, 0.95)},
    "wider": {"call": (1.025, 1.075, 1.05), "put": (0.875, 0.925, 0.90)},
}
"""Strike to spot: lowest, highest, target (fixed values). With a target the highest is allowed, without it isn't."""


def eligible(quotes: DataFrame, policy: str) -> DataFrame:
    """Quotes that a policy may choose, with ``distance`` to its target (0 without one)."""
    ratio, side = F.try_divide("strike", "spot"), F.col("side")
    inside, distance = F.lit(False), F.lit(0.0)
    for name, (low, high, target) in POLICIES[policy].items():
        upper = ratio <= high if policy in ("five_below", "wider") else ratio < high
        inside = inside | ((side == name) & (ratio >= low) & upper)
        if target is not None:
            distance = F.when(side == name, F.abs(ratio - target)).otherwise(distance)
    return quotes.filter(inside & (F.col("dte") > 0) & (F.col("bid") > 0)).withColumn("distance", e8(distance))


def e8(x: Column) -> Column:
    return M.half_up(x, 100_000_000)


def ranking(contract: list[str]) -> list[Column]:
    """Distance, rate down, activity down, strike, contract."""
    return [F.col("distance"), F.col("apr_tenths").desc_nulls_last(), F.col("oi").desc(), F.col("strike"), *[F.col(c) for c in contract]]


def ranked(quotes: DataFrame, policy: str, group: list[str], contract: list[str]) -> DataFrame:
    """Eligible quotes with their ``rank`` in each group."""
    return eligible(decision_metrics(quotes), policy).withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*ranking(contract))))


def selected(quotes: DataFrame, policy: str, group: list[str], contract: list[str]) -> DataFrame:
    """The best quote of each group: an aggregate that is combined before the shuffle, not a sort of whole groups."""
    rows = eligible(decision_metrics(quotes), policy)
    order = F.struct(F.col("distance"), -F.coalesce(F.col("apr_tenths"), F.lit(-(2**62))), -F.col("oi"), F.col("strike"), *[F.col(c) for c in contract])
    kept = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.min_by(F.struct(*kept), order).alias("best")).select(*group, "best.*")


def wheel_selected(quotes: DataFrame, group: list[str], contract: list[str], haircut: float = 0.1, fee: float = 0.65) -> DataFrame:
    """The contract of the best reward for capital and calendar day (first and last day counted), in each group."""
    side, spot, strike, bid = (F.col(c) for c in ("side", "spot", "strike", "bid"))
    intrinsic = F.greatest(F.lit(0.0), F.when(side == "call", spot - strike).otherwise(strike - spot))
    capital = F.when(side == "call", spot).otherwise(strike)
    reward = F.try_divide(bid * (1 - haircut) - intrinsic - fee / 100, capital) / (F.col("dte") + 1)
    rows = quotes.filter("dte > 0 and bid > 0").withColumn("reward_e9", M.half_up(reward, 1_000_000_000))
    order = F.struct(-F.col("reward_e9"), -F.col("oi"), strike, *[F.col(c) for c in contract])
    kept = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.min_by(F.struct(*kept), order).alias("best")).select(*group, "best.*")


def panel_cells(quotes: DataFrame, contract: list[str]) -> DataFrame:
    """For each ticker, horizon band, side and target distance the nearest contract; cells without one stay, empty.

    Targets are 0, 10 and 20 % in and out of the money, in three bands of days.
    """
    spark = quotes.sparkSession
    cells = spark.createDataFrame([(h, s, d) for h in range(3) for s in ("call", "put") for d in (-20, -10, 0, 10, 20)], "band int, side string, target int")
    targets = [-20, -10, 0, 10, 20]
    band = F.when(F.col("dte").between(1, 100), 0).when(F.col("dte").between(101, 500), 1).when(F.col("dte").between(501, 2000), 2)
    pct = F.when(F.col("side") == "call", F.try_divide("strike", "spot") - 1).otherwise(1 - F.try_divide("strike", "spot")) * 100
    rows = quotes.withColumns({"band": band, "pct_e6": M.half_up(pct, 1_000_000)})
    gap = lambda t: F.abs(F.col("pct_e6") - t * 1_000_000)
    # the least distances are numbers, for which no row is sorted; only rows that have one are compared in full
    least = counted(rows.groupBy("ticker", "side", "band").agg(*[F.min(gap(t)).alias(f"least {k}") for k, t in enumerate(targets)]))
    grid = least.select("ticker").distinct().join(F.broadcast(cells.select("band", "side", "target")))
    has = F.filter(F.array(*[F.when(gap(t).eqNullSafe(F.col(f"least {k}")), F.struct(F.lit(t).alias("target"), gap(t).alias("gap"))) for k, t in enumerate(targets)]), lambda x: x.isNotNull())
    near = matched(rows.filter("band is not null"), least, ["ticker", "side", "band"], "inner").withColumn("has_", has).filter(F.size("has_") > 0)
    near = near.select("ticker", "band", "side", "dte", *contract, F.explode("has_").alias("has_")).select("*", "has_.*")
    best = near.groupBy("ticker", "band", "side", "target").agg(F.min(F.struct("gap", F.col("dte"), *[F.col(c) for c in contract])).alias("b"))
    return grid.join(best, ["ticker", "band", "side", "target"], "left").select("ticker", "band", "side", "target", F.col("b.gap").alias("gap"), F.col("b.dte").alias("dte"), *[F.col(f"b.{c}").alias(c) for c in contract])


def rank_stability(first: DataFrame, second: DataFrame, group: list[str], contract: list[str]) -> DataFrame:
    """Spearman correlation of two rankings over the contracts that both have, and how many of the top three they share.

    Squares and cubes of ranks are exact at any size: a rank is an int, its square isn't.
    """
    w1, w2 = W.partitionBy(*group).orderBy("r1"), W.partitionBy(*group).orderBy("r2")
    both = first.select(*group, *contract, F.col("rank").alias("r1")).join(second.select(*group, *contract, F.col("rank").alias("r2")), [*group, *contract])
    both = both.withColumns({"a": F.row_number().over(w1), "b": F.row_number().over(w2)})
    apart = F.col("a").cast("long") - F.col("b")
    n, d = F.count("*"), F.sum((apart * apart).cast("decimal(20,0)")).cast("double")
    m = n.cast("decimal(12,0)")
    rho = F.when(n >= 2, 1 - 6.0 * d / (m * (m * m - 1)).cast("double"))
    return both.groupBy(*group).agg(n.alias("matched"), M.e4(rho).alias("spearman_e4"), F.count_if((F.col("r1") <= 3) & (F.col("r2") <= 3)).alias("top3_shared"))
