"""Paired inference: challengers against the baseline on identical cells, date-blocked evaluation, calibration evidence, wheel rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.operators.quantiles import continuous_quantiles, matched
from strikeloom.sources.scratch import written

BANDS = ((1, 1, 2, "1"), (2, 5, 6, "2-5"), (6, 25, 26, "6-25"))  # fixed values: horizons from and to, spacing of origins
CELL = ["panel", "ticker", "origin", "expiry", "horizon", "contract"]
UNIT = ["panel", "model", "ticker", "origin", "horizon"]


def band_of(horizon: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, _, name in reversed(BANDS):
        out = F.when(horizon.between(low, high), name).otherwise(out)
    return out


def pairs(scores: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """Each challenger's cell beside the baseline's: the first row of a cell and model (by ``seq``) counts, cells without either don't."""
    first = F.min_by(F.struct(*metrics), "seq").alias("m")
    once = scores.filter("eligible").groupBy(*CELL, "model").agg(first)
    base = once.filter(F.col("model") == baseline).select(*CELL, *[F.col(f"m.{m}").alias(f"base_{m}") for m in metrics])
    return once.filter(F.col("model") != baseline).select(*CELL, "model", "m.*").join(base, CELL)


def units(paired: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of candidate and baseline over the contracts of a unit where both are known, one row for each unit and metric.

    A unit's cells, one for each contract of a chain, are added in order of contract, so that means are the same in every run.
    """
    rows = paired.select(*UNIT, "expiry", "contract", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("c"), F.col(f"base_{m}").alias("b")) for m in metrics])).alias("x")).select(*UNIT, "expiry", "contract", "x.*")
    known = F.col("c").isNotNull() & F.col("b").isNotNull() & ~F.isnan("c") & ~F.isnan("b")
    cells = F.array_sort(F.collect_list(F.struct("contract", "expiry", "c", "b")))
    once = rows.filter(known).groupBy(*UNIT, "metric").agg(F.min("expiry").alias("expiry"), cells.alias("cells_"), F.count("*").alias("cells"))
    mean = lambda x: F.aggregate("cells_", F.lit(0.0), lambda a, s: a + s[x]) / F.col("cells")
    return once.select(*UNIT, "metric", "expiry", mean("c").alias("candidate"), mean("b").alias("baseline"), "cells")


def schedule(sessions: DataFrame) -> DataFrame:
    """panel, band, origin and ``boundary`` (the session three quarters through) from sessions (panel, session), before any outcome is seen.

    Every band takes each so many sessions of its panel, the first included.
    """
    n = F.row_number().over(W.partitionBy("panel").orderBy("session")) - 1
    rows = sessions.withColumns({"n": n, "total": F.count("*").over(W.partitionBy("panel"))})
    edge = rows.filter(F.col("n") == F.floor(F.col("total") * 0.75)).select("panel", F.col("session").alias("boundary"))
    bands = F.explode(F.array(*[F.struct(F.lit(name).alias("band"), F.lit(gap).alias("gap")) for _, _, gap, name in BANDS]))
    return rows.select("panel", F.col("session").alias("origin"), "n", bands.alias("b")).filter(F.col("n") % F.col("b.gap") == 0).select("panel", "b.band", "origin").join(edge, "panel")


def in_periods(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (panel, origin, horizon, expiry) on their band's schedule, as development (over before the boundary) or holdout (begun at it or after); others are purged."""
    period = F.when(F.col("expiry") < F.col("boundary"), "development").when(F.col("origin") >= F.col("boundary"), "holdout")
    return rows.withColumn("band", band_of(F.col("horizon"))).join(plan, ["panel", "band", "origin"]).withColumn("period", period).filter("period is not null")


def by_date(rows: DataFrame, group: list[str], value: str = "delta") -> DataFrame:
    """Sum and count of each group's origins: what a date contributes to a resampled mean."""
    return rows.groupBy(*group, "origin").agg(F.sum(value).alias("s"), F.count("*").alias("n"))


def paired_interval(dates: DataFrame, group: list[str], adjusted: Column, draws: int = 2000, seed: int = 1729, least: int = 20, comparisons: int = 7) -> DataFrame:
    """For each group: dates, units, mean delta, status and interval from resampled dates; seven comparisons' tail where ``adjusted``.

    A group reaches Python as one row for each date of a calendar.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in dates.dtypes if n in group)
    schema = f"{kinds}, dates long, units long, delta double, status string, comparisons int, low double, high double"

    def resample(key, frame):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("origin")
        s, n, times = frame["s"].to_numpy(float), frame["n"].to_numpy(float), int(frame["times"].iloc[0])
        low = high = None
        if len(s) >= least:
            picks = np.random.default_rng(seed).integers(0, len(s), size=(draws, len(s)))
            tail = 0.05 / (2 * times)
            low, high = np.quantile(s[picks].sum(axis=1) / n[picks].sum(axis=1), [tail, 1 - tail])
        return pd.DataFrame([[*key, len(s), int(n.sum()), s.sum() / n.sum(), "estimable" if len(s) >= least else "not_estimable", times, low, high]], columns=[*group, "dates", "units", "delta", "status", "comparisons", "low", "high"])

    return dates.withColumn("times", F.when(adjusted, comparisons).otherwise(1)).groupBy(*group).applyInPandas(resample, schema)


def block_comparison(rows: DataFrame, calendar: DataFrame, group: list[str], draws: int = 2000, seed: int = 1729, block: int = 26, least: int = 20, least_blocks: int = 8) -> DataFrame:
    """Two rules on the dates that both have: differences of reward a day and of the 5 % shortfall, with intervals from moving calendar blocks.

    ``rows``: group, ordinal, ret, days, other_ret, other_days, one row for each date
    of a calendar (so a group is bounded by it). Draws depend on the calendar alone.
    """
    size = calendar.count()
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n in group)
    schema = f"{kinds}, dates long, blocks long, status string, reward double, shortfall double, reward_low double, reward_high double, shortfall_low double, shortfall_high double"

    def resample(key, frame):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("ordinal")
        at = frame["ordinal"].to_numpy()
        full = size // block
        blocks = len({int(a) // block for a in at if a < full * block})

        def measures(ret, days, weights):  # noqa: ANN001, ANN202
            order = np.argsort(ret, kind="stable")
            mass = weights[:, order]
            upto = np.cumsum(mass, axis=1)
            target = 0.05 * mass.sum(axis=1)
            part = np.minimum(mass, np.maximum(target[:, None] - (upto - mass), 0))
            return (weights @ ret) / (weights @ days), (part @ ret[order]) / target

        sides = [(frame[r].to_numpy(float), frame[d].to_numpy(float)) for r, d in (("ret", "days"), ("other_ret", "other_days"))]
        one = np.ones((1, len(at)))
        (r1, s1), (r2, s2) = (measures(*x, one) for x in sides)
        out = [len(at), blocks, "underpowered", r1[0] - r2[0], s1[0] - s2[0], None, None, None, None]
        if len(at) >= least and blocks >= least_blocks:
            starts = np.random.default_rng(seed).integers(0, size - block + 1, size=(draws, -(-size // block)))
            days = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :size]
            weights = np.stack([np.bincount(d, minlength=size)[at] for d in days]).astype(float)
            if (weights.sum(axis=1) > 0).all():
                (r1, s1), (r2, s2) = (measures(*x, weights) for x in sides)
                out[2:3] = ["estimable"]
                out[5:] = [*np.quantile(r1 - r2, [0.025, 0.975]), *np.quantile(s1 - s2, [0.025, 0.975])]
        return pd.DataFrame([[*key, *out]], columns=[*group, "dates", "blocks", "status", "reward", "shortfall", "reward_low", "reward_high", "shortfall_low", "shortfall_high"])

    return rows.groupBy(*group).applyInPandas(resample, schema)


def representatives(stats: DataFrame, group: list[str]) -> DataFrame:
    """group, conservative, balanced, higher_return: rules of the frontier of reward a day (more) and tail loss (less).

    Only rules with 20 dates, 20 traded, four expiries of either and a positive
    reward are eligible. Equal points keep the rule of fewer losses, then of more
    dates, then the first by name. Frontiers are summed up by aggregates; balanced is
    the lower middle by reward.
    """
    able = stats.filter("dates >= 20 and traded >= 20 and expiries >= 4 and traded_expiries >= 4 and reward > 0 and tail_loss >= 0 and losses is not null")
    points = able.groupBy(*group, "reward", "tail_loss").agg(F.min(F.struct("losses", (-F.col("dates")).alias("less"), "rule")).alias("tie"))
    w = W.partitionBy(*group).orderBy(F.desc("reward"), "tail_loss").rowsBetween(W.unboundedPreceding, -1)
    front = points.withColumn("best", F.min("tail_loss").over(w)).filter("best is null or tail_loss < best")
    place = front.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("reward", "tie"))).withColumn("size", F.count("*").over(W.partitionBy(*group)))
    return place.groupBy(*group).agg(
        F.min_by("tie.rule", F.struct("tail_loss", "tie")).alias("conservative"),
        F.max(F.when(F.col("place") == F.floor((F.col("size") - 1) / 2) + 1, F.col("tie.rule"))).alias("balanced"),
        F.max(F.when(F.col("place") == F.col("size"), F.col("tie.rule"))).alias("higher_return"),
    )


def evaluated(rows: DataFrame, baseline: str, candidate: str, carry: tuple[str, ...] = (), paired: tuple[str, ...] = ()) -> DataFrame:
    """The candidate against the baseline contract by contract: ticker, origin, horizon, contract, ``outcome`` and both probabilities.

    The first baseline of a unit (ticker, origin, horizon) fixes the input vintage;
    rows of others don't count, and of a contract and method the first issued does.
    ``outcome`` is ``scored`` or the first reason why not. ``rows``: these columns,
    method, issued, seq, vintage, probability, reason, itm. Columns ``carry`` come back
    from the candidate's row, ``paired`` ones from both (``x_base``, ``x_candidate``).
    """
    unit = ["ticker", "origin", "horizon"]
    base = rows.filter(F.col("method") == baseline)
    chosen = base.groupBy(*unit).agg(F.min_by(F.struct("vintage"), F.struct("issued", "seq")).alias("v")).select(*unit, F.col("v.vintage").alias("chosen"))
    own = rows.filter(F.col("method").isin(baseline, candidate)).join(chosen.withColumn("has", F.lit(True)), unit, "left")
    orphans = own.filter((F.col("method") == candidate) & F.col("has").isNull()).select(*unit, "contract").distinct()
    kept = own.filter(F.col("has") & F.col("vintage").eqNullSafe(F.col("chosen")) & ((F.col("method") == baseline) | F.col("vintage").isNotNull()))
    first = lambda m: F.min_by(F.struct("probability", "reason", "itm", "vintage", *carry, *paired), F.when(F.col("method") == m, F.struct("issued", "seq")))
    both = kept.groupBy(*unit, "contract").agg(first(baseline).alias("b"), first(candidate).alias("c"))
    b, c = F.col("b"), F.col("c")
    bad = lambda p: ~p.between(0, 1)
    outcome = (
        F.when(b.isNull(), "baseline_not_issued")
        .when(b["probability"].isNull(), F.coalesce(b["reason"], F.lit("baseline_unavailable")))
        .when((c.isNull() | c["probability"].isNull()) & b["vintage"].isNull(), "input_vintage_missing")
        .when(c.isNull(), "candidate_not_issued")
        .when(c["probability"].isNull(), F.coalesce(c["reason"], F.lit("unavailable")))
        .when(b["itm"].isNull() | c["itm"].isNull() | (b["itm"] != c["itm"]), "unscorable_or_conflicting_label")
        .when(bad(b["probability"]) | bad(c["probability"]), "invalid_probability")
        .otherwise("scored")
    )
    out = both.select(*unit, "contract", outcome.alias("outcome"), b["probability"].alias("p_base"), c["probability"].alias("p_candidate"), b["itm"].alias("itm"), *[c[x].alias(x) for x in carry], *[side[x].alias(f"{x}_{name}") for x in paired for side, name in ((b, "base"), (c, "candidate"))])
    none = F.lit(None).cast("double")
    return out.unionByName(orphans.select(*unit, "contract", F.lit("baseline_not_issued").alias("outcome"), none.alias("p_base"), none.alias("p_candidate"), F.lit(None).cast("boolean").alias("itm")), allowMissingColumns=True)


def unit_deltas(rows: DataFrame) -> DataFrame:
    """Mean Brier and log-loss advantage of the candidate in each unit of scored contracts."""
    y = F.col("itm").cast("double")
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    brier = lambda p: (F.col(p) - y) * (F.col(p) - y)
    loss = lambda p: -F.log(F.when(F.col("itm"), clip(F.col(p))).otherwise(1 - clip(F.col(p))))
    return rows.filter("outcome = 'scored'").groupBy("ticker", "origin", "horizon").agg(F.avg(brier("p_candidate") - brier("p_base")).alias("brier_delta"), F.avg(loss("p_candidate") - loss("p_base")).alias("log_delta"), F.count("*").alias("contracts"))


def calibration_evidence(rows: DataFrame, least_tickers: int = 20, least_dates: int = 20, least_units: int = 500) -> DataFrame:
    """Predicted and observed rates of each model, band, moneyness and side with enough support, from ``rows`` on chosen dates.

    ``rows``: contract, model, origin, ticker, horizon, band, moneyness, side, issued,
    seq, vintage, p, itm, expiry. The first issuance of a contract, model and origin
    counts, then only those of the unit's first vintage; a unit is the mean over its contracts.
    """
    first = F.min_by(F.struct("ticker", "horizon", "band", "moneyness", "side", "vintage", "p", "itm", "expiry", "issued", "seq"), F.struct("issued", "seq")).alias("r")
    once = rows.groupBy("contract", "model", "origin").agg(first).select("contract", "model", "origin", "r.*")
    unit = ["ticker", "origin", "horizon", "model"]
    vintage = once.groupBy(*unit).agg(F.min(F.struct("issued", "seq", "vintage")).alias("v")).select(*unit, F.col("v.vintage").alias("vintage"))
    key = ["model", "band", "moneyness", "side"]
    means = once.join(vintage, [*unit, "vintage"], "left_semi").groupBy(*key, "ticker", "origin", "horizon").agg(F.avg("p").alias("p"), F.avg(F.col("itm").cast("double")).alias("y"), F.max("expiry").alias("expiry"))
    out = means.groupBy(*key).agg(F.count("*").alias("units"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("origin").alias("dates"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"), F.max("expiry").alias("through"))
    return out.filter((F.col("tickers") >= least_tickers) & (F.col("dates") >= least_dates) & (F.col("units") >= least_units))


CONDITIONS = ("volatility_low", "volatility_middle", "volatility_high", "trend_positive", "trend_other", "active")


def condition(name: str) -> Column:
    """True, false or (unknown) null of a row with volatility20, low and high (its ticker's edges), return20, transactions, volume."""
    v, low, high, r = F.col("volatility20"), F.col("low"), F.col("high"), F.col("return20")
    return {
        "volatility_low": v <= low, "volatility_middle": (v > low) & (v <= high), "volatility_high": v > high,
        "trend_positive": r > 0, "trend_other": r <= 0,
        "active": (F.col("transactions") >= 5) & (F.col("volume") >= 20),
    }[name]


def conditional(rows: DataFrame) -> DataFrame:
    """Each row under each condition: its own return where it holds, the baseline's where it doesn't; unknown ones are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), condition(n).alias("holds")) for n in CONDITIONS]))
    out = rows.withColumn("c", each).filter("c.holds is not null")
    return out.select(*[c for c in rows.columns if c not in ("traded", "ret")], "c.condition", (F.col("c.holds") & F.col("traded")).alias("traded"), F.when(F.col("c.holds"), F.col("ret")).otherwise(F.col("baseline_ret")).alias("ret"))


def rule_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Dates, expiries, traded of either, reward a day, median, losses, excess a day, participation, quartiles of the cushion, weekday counts.

    Rows are read several times: what is needed of them is written once, so that the joins behind them are made once.
    """
    rows = written(rows.select(*by, "origin", "expiry", "traded", "ret", "baseline_ret", "days", "cushion"), "rule-metrics")
    traded = F.col("traded")
    days = F.sum("days")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("dates"), F.count_distinct("expiry").alias("expiries"), F.count_if(traded).alias("traded"), F.count_distinct(F.when(traded, F.col("expiry"))).alias("traded_expiries"),
        F.try_divide(F.sum("ret"), days).alias("reward"), F.avg((F.col("ret") < 0).cast("double")).alias("losses"), F.try_divide(F.sum(F.col("ret") - F.col("baseline_ret")), days).alias("excess"),
        F.avg(traded.cast("double")).alias("participation"),
        *[F.count_if(F.weekday("origin") == i).alias(name) for i, name in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))],
    )
    quartiles = continuous_quantiles(rows.filter(traded), by, "cushion", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).withColumn("cushion_quartiles", F.array("q1", "q2", "q3")).drop("q1", "q2", "q3")
    return matched(matched(sums, continuous_quantiles(rows, by, "ret", {"median": 0.5}), by), quartiles, by)


def entry_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Shares of attempts without entry, cancelled for a known reason, and without entry for want of data."""
    none = (F.col("status") == "no_entry").cast("double")
    cancelled = F.coalesce(F.col("reason") == "opening_moneyness_changed", F.lit(False)).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(none).alias("no_entry"), F.avg(cancelled).alias("cancelled"), F.avg(none - cancelled).alias("missing"))


def period_of(panel: Column, origin: Column, expiry: Column, holdout: Column) -> Column:
    """development, holdout or purged (it straddles ``holdout``) of the primary panel; supplement; other_eligible."""
    primary = F.when(expiry < holdout, "development").when(origin >= holdout, "holdout").otherwise("purged")
    return F.when(panel == "primary", primary).when(panel == "supplement", "supplement").otherwise("other_eligible")


def decision_features(rows: DataFrame) -> DataFrame:
    """What is known at the decision, of side, spot, strike, mark: depth, intrinsic and time value, yields, cushion, capped return (haircut .1, fee .65)."""
    call, spot, strike, mark = F.col("side") == "call", F.col("spot"), F.col("strike"), F.col("mark")
    intrinsic = F.when(call, F.greatest(spot - strike, F.lit(0.0))).otherwise(0.0)
    capital = F.when(call, spot).otherwise(strike)
    net = mark * 0.9 - 0.0065
    even = F.when(call, spot).otherwise(strike) - net
    return rows.withColumns({"depth": 1 - F.try_divide(strike, spot), "intrinsic": intrinsic, "time_value": mark - intrinsic, "premium_yield": F.try_divide(mark, capital), "time_value_yield": F.try_divide(mark - intrinsic, capital), "cushion": 1 - F.try_divide(even, spot), "capped_return": F.try_divide(net - intrinsic, capital)})


def expiry_state(rows: DataFrame, haircut: float = 0.1, fee: float = 0.65) -> DataFrame:
    """Wealth at expiry of side, strike, entry, premium, close and ``traded``: a cancelled call keeps its shares and a cancelled put its cash, without a fee.

    Adds shares, cash, share_value, state, itm, and from ``lows`` (the path's lows,
    null where one is missing) the lowest return and whether the breakeven was breached.
    """
    call, traded = F.col("side") == "call", F.col("traded")
    strike, close, entry = F.col("strike"), F.col("close"), F.col("entry")
    net = F.when(traded, F.col("premium") * (1 - haircut) * 100 - fee).otherwise(0.0)
    itm = F.when(traded, F.when(call, close > strike).otherwise(close < strike))
    holds = F.when(traded, F.when(call, ~itm).otherwise(itm)).otherwise(call)
    cash = net + F.when(holds, 0.0).otherwise(100 * strike)
    even = F.when(traded, F.when(call, entry).otherwise(strike) - net / 100).when(call, entry)
    low = F.when(F.size("lows") > 0, F.array_min("lows"))
    whole = low.isNotNull() & ~F.exists("lows", lambda x: x.isNull()) & (traded | call)
    state = F.when(traded & (close == strike), "atm_ambiguous").when(holds, "shares").otherwise("cash")
    return rows.withColumns({
        "net_premium": net, "itm": itm, "shares": F.when(holds, 100).otherwise(0), "cash": cash, "share_value": F.when(holds, 100 * close).otherwise(0.0), "state": state,
        "min_return": F.when(whole, F.least(F.lit(0.0), F.try_divide(low, entry) - 1)), "breached": F.when(whole, low < even),
    })


def matched_rules(rows: DataFrame, by: list[str]) -> DataFrame:
    """Every two rules of a group on the dates that both have; rules are a dimension of a few dozen.

    The join is on group and date, so a pair of rules meets only there.
    """
    left = rows.select(*by, "ordinal", F.col("rule").alias("rule"), "ret", "days")
    right = rows.select(*by, "ordinal", F.col("rule").alias("other_rule"), F.col("ret").alias("other_ret"), F.col("days").alias("other_days"))
    return left.join(right, [*by, "ordinal"]).filter("rule < other_rule")


def cell_means(rows: DataFrame, cell: list[str], by: list[str], value: str) -> DataFrame:
    """Mean of the means of cells, their number and that of their rows: cells count alike, however many rows they have."""
    means = rows.groupBy(*by, *cell).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return means.groupBy(*by).agg(F.avg("m").alias(value), F.count("m").alias("cells"), F.sum("n").alias("rows"))


def exclusion_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """How often each status and reason came."""
    return rows.groupBy(*by, "status", "reason").agg(F.count("*").alias("n"))
