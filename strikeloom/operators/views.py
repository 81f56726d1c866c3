"""What watches and pages are shown of a ticker's latest snapshot: odds, curve odds, entry quotes, selections, the underlying, input states.

Requests are looked up together: snapshots, a row a ticker, are counted and
broadcast if they are few, contracts meet their odds by an equi-join. A request gets
exactly one row, with a status and, unless it's available, a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeloom.functions.display import quote_support, tenths_of
from strikeloom.operators.quantiles import counted

REFRESH_MINUTES = 15
# fixed values: what is shown where there are no odds
TERMS, PENDING, ABSENT, PENDING_CURVE, FITTING = "Contract terms cannot be verified", "Refreshing market odds", "Contract is absent from the current option chain", "Refreshing option quote snapshot", "Fitting option quote curve"
SAME_DAY, NO_RATE, DIVIDENDS = "Same-day option quote timing cannot be verified", "Dated Treasury rate is unavailable", "Dividend exposure is unsupported"


@dataclass(frozen=True)
class Clock:
    """A moment with what a calendar says of it, as texts: UTC times without zone, and days."""

    now: str
    is_open: bool
    session: str
    completed: str
    completed_close: str


def valid(clock: Clock, minutes: int = REFRESH_MINUTES) -> Column:
    """Whether a snapshot (error, fetched_at, refreshed_at, session_date, valuation_time) still stands: a fresh one while the market is open or after an error, else one of the completed session, valued at its close or later."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    fresh = lambda c: at(clock.now) < c + F.make_dt_interval(mins=F.lit(minutes))
    closed = (F.col("session_date") == F.lit(clock.completed).cast("date")) & (F.col("valuation_time") >= at(clock.completed_close))
    live = (F.col("session_date") == F.lit(clock.session).cast("date")) & fresh(F.col("fetched_at"))
    return F.coalesce(F.when(F.col("error").isNotNull(), fresh(F.coalesce("refreshed_at", "fetched_at"))).otherwise(live if clock.is_open else closed), F.lit(False))


def with_snapshots(requests: DataFrame, snapshots: DataFrame, clock: Clock) -> DataFrame:
    """Requests with the columns of their ticker's snapshot under ``s``, null where it has none that is valid."""
    good = snapshots.filter(valid(clock))
    packed = good.select("ticker", F.struct(*[c for c in good.columns if c != "ticker"]).alias("s"))
    return requests.join(counted(packed, 100_000), "ticker", "left")


def _sided(call: Column, put: Column) -> Column:
    return F.when(put, 1000 - call).otherwise(call)


def odds_views(requests: DataFrame, snapshots: DataFrame, expiries: DataFrame, odds: DataFrame, clock: Clock) -> DataFrame:
    """Each request (ticker, root, side, expiry, strike) with status, reason, itm and otm in tenths of a percent, bounds and support.

    ``expiries``: ticker, expiry, reason (why its odds can't be had); ``odds``: ticker, expiry, strike, p, lower, upper, reason.
    """
    rows = with_snapshots(requests, snapshots, clock).join(expiries.select("ticker", "expiry", F.col("reason").alias("expiry_reason")), ["ticker", "expiry"], "left")
    rows = rows.join(odds.select("ticker", "expiry", "strike", F.struct("p", "lower", "upper", "reason").alias("o")), ["ticker", "expiry", "strike"], "left")
    call, put = tenths_of(F.col("o.p")), F.col("side") == "put"
    status = F.when(F.col("root").isNotNull() & (F.col("root") != F.col("ticker")), "unavailable").when(F.col("s").isNull(), "pending").when(F.col("s.error").isNotNull() | F.col("expiry_reason").isNotNull() | call.isNull(), "unavailable").otherwise("available")
    reason = (
        F.when(F.col("root").isNotNull() & (F.col("root") != F.col("ticker")), TERMS).when(F.col("s").isNull(), PENDING).when(F.col("s.error").isNotNull(), F.col("s.error")).when(F.col("expiry_reason").isNotNull(), F.col("expiry_reason"))
        .when(F.col("o").isNull(), ABSENT).when(call.isNull(), F.coalesce("o.reason", F.lit("Odds unavailable")))
    )
    shown = status == "available"
    support = quote_support(F.col("o.lower"), F.col("o.upper"), put)
    return rows.select(*requests.columns, status.alias("status"), reason.alias("reason"), *[F.when(shown, v).alias(n) for n, v in (("itm", _sided(call, put)), ("otm", 1000 - _sided(call, put)), ("low", support["low"]), ("high", support["high"]), ("support", support["score"]))])


def curve_views(requests: DataFrame, snapshots: DataFrame, expiries: DataFrame, contracts: DataFrame, curves: DataFrame, odds: DataFrame, clock: Clock) -> DataFrame:
    """Each request with status, reason, itm, otm, and whether quotes are fitted and stable, from the curve of its ticker's snapshot.

    ``contracts``: valid ones (ticker, expiry, strike); ``curves``: ticker, fitted_at
    (the snapshot's ``fetched_at``; another one's doesn't count) and failure; ``odds``: as for ``odds_views``.
    """
    rows = with_snapshots(requests, snapshots, clock).join(expiries.select("ticker", "expiry", F.col("reason").alias("expiry_reason")), ["ticker", "expiry"], "left")
    rows = rows.join(contracts.select("ticker", "expiry", "strike", F.lit(True).alias("known")).distinct(), ["ticker", "expiry", "strike"], "left")
    rows = rows.join(counted(curves.select("ticker", F.struct("fitted_at", "failure").alias("c")), 100_000), "ticker", "left")
    rows = rows.join(odds.select("ticker", "expiry", "strike", F.struct("p", "lower", "upper", "reason").alias("o")), ["ticker", "expiry", "strike"], "left")
    call, put = tenths_of(F.col("o.p")), F.col("side") == "put"
    fitted = F.coalesce(F.col("c.fitted_at") == F.col("s.fetched_at"), F.lit(False))
    said = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.cast("string").alias("reason"))
    state = (
        F.when(F.col("root").isNotNull() & (F.col("root") != F.col("ticker")), said("unavailable", F.lit(TERMS))).when(F.col("s").isNull(), said("pending", F.lit(PENDING_CURVE)))
        .when(F.col("s.error").isNotNull() | F.col("expiry_reason").isNotNull(), said("unavailable", F.coalesce("s.error", "expiry_reason"))).when(F.col("known").isNull(), said("unavailable", F.lit(TERMS)))
        .when(~fitted, said("pending", F.lit(FITTING))).when(call.isNull(), said("unavailable", F.coalesce("o.reason", "c.failure", F.lit("curve_strike_not_supported")))).otherwise(said("available", F.lit(None)))
    )
    rows = rows.withColumn("state", state)
    shown = F.col("state.status") == "available"
    stable = F.when(shown, True).when(F.col("state.reason") == "one_tick_unstable", False)
    fit = F.when(shown, True).when(F.col("state.reason") == "infeasible_curve", False)
    return rows.select(*requests.columns, "state.status", "state.reason", F.when(shown, _sided(call, put)).alias("itm"), F.when(shown, 1000 - _sided(call, put)).alias("otm"), stable.alias("one_tick_stable"), fit.alias("bid_ask_fit"))


def selections(requests: DataFrame, snapshots: DataFrame, quotes: DataFrame, rates: DataFrame, blocked: DataFrame, clock: Clock, most_rate: float = 0.25, oldest_rate: int = 7) -> DataFrame:
    """Each request (ticker, root, side, expiry, strike, fetched_at, source: the quote shown) with its entry quote and ``selected``.

    Selected is a request whose snapshot is valid and the very one shown, without
    anything against contract, expiry or quote (``blocked``: ticker, expiry, strike,
    side, each null where it holds for all), with a dated rate of up to a week before
    the valuation, and an expiry after its day. ``quotes``: ticker, side, expiry,
    strike, bid, ask; ``rates``: ticker, expiry, rate.
    """
    rows = with_snapshots(requests, snapshots, clock)
    rows = rows.join(quotes.select("ticker", "side", "expiry", "strike", F.struct("bid", "ask").alias("q")), ["ticker", "side", "expiry", "strike"], "left").join(rates.select("ticker", "expiry", "rate"), ["ticker", "expiry"], "left")
    whole = blocked.filter("strike is null").select("ticker", "expiry", F.lit(True).alias("expiry_blocked")).distinct()
    terms = blocked.filter("strike is not null and side is null").select("ticker", "expiry", "strike", F.lit(True).alias("contract_blocked")).distinct()
    own = blocked.filter("strike is not null and side is not null").select("ticker", "expiry", "strike", "side", F.lit(True).alias("quote_blocked")).distinct()
    rows = rows.join(whole, ["ticker", "expiry"], "left").join(terms, ["ticker", "expiry", "strike"], "left").join(own, ["ticker", "expiry", "strike", "side"], "left")
    there = (F.col("root").isNull() | (F.col("root") == F.col("ticker"))) & F.col("s").isNotNull() & F.col("s.error").isNull() & F.col("s.spot").isNotNull() & F.col("s.source").isNotNull() & F.col("s.valuation_time").isNotNull() & F.col("q").isNotNull()
    shown = (F.col("s.fetched_at") == F.col("fetched_at")) & (F.col("s.source") == F.col("source"))
    free = F.coalesce("expiry_blocked", "contract_blocked", "quote_blocked").isNull()
    day = F.to_date("s.valuation_time")
    dated = F.col("rate").between(0, most_rate) & F.datediff(day, F.col("s.rate_session")).between(0, oldest_rate) & (F.col("expiry") > day)
    there = F.coalesce(there, F.lit(False))
    return rows.select(*requests.columns, *[F.when(there, v).alias(n) for n, v in (("spot", F.col("s.spot")), ("bid", F.col("q.bid")), ("ask", F.col("q.ask")), ("rate", F.col("rate")))], (there & F.coalesce(shown & free & dated, F.lit(False))).alias("selected"))


def underlying_quotes(snapshots: DataFrame, clock: Clock, minutes: int = REFRESH_MINUTES) -> DataFrame:
    """ticker, spot, quote_time of the snapshots whose stock quote is live: the market is open, the snapshot valid, the quote of its session, up to ``minutes`` old or a minute ahead."""
    age = F.expr(f"timestampdiff(SECOND, quote_time, timestamp_ntz'{clock.now}')")
    live = valid(clock) & F.lit(clock.is_open) & F.col("error").isNull() & F.col("spot").isNotNull() & F.col("source").isNotNull() & F.col("quote_fetched_at").isNotNull() & (F.to_date("quote_time") == F.col("session_date")) & age.between(-60, 60 * minutes)
    return snapshots.filter(F.coalesce(live, F.lit(False))).select("ticker", "spot", "quote_time")


def input_states(expiries: DataFrame) -> DataFrame:
    """Expiries (ticker, expiry, reason, curve_state, dividend_state, dividends_failed, dividend_reason) with what stands: ``reason``, and ``state`` (acquisition, pending or null).

    What was finally decided stays: same-day timing, a missing rate of a curve that is
    done, dividends that are known to stand against the expiry. Else a failed fetch is
    an acquisition problem, and a running one leaves the expiry pending.
    """
    done = (F.col("curve_state") == "done") & (F.col("dividend_state") == "done")
    final = F.col("reason").isNull() | done | (F.col("reason") == SAME_DAY) | ((F.col("reason") == NO_RATE) & (F.col("curve_state") == "done"))
    known = (F.col("dividend_state") == "done") & ~F.coalesce("dividends_failed", F.lit(False)) & F.col("dividend_reason").isNotNull()
    failed, running = (F.lit(x).isin(F.col("curve_state"), F.col("dividend_state")) for x in ("failed", "pending"))
    state = F.when(final | known, None).when(failed, "acquisition").when(running, "pending")
    return expiries.select("ticker", "expiry", F.when(~final & known, F.coalesce(F.nullif("dividend_reason", F.lit("")), F.lit(DIVIDENDS))).otherwise(F.col("reason")).alias("reason"), state.alias("state"))
