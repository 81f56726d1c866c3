"""Archive checks: validity reasons, duplicates, rollups, reconciliation, exclusions, fetch audit, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.operators.quantiles import counted_quantile, matched

KEY = ["contract", "start", "kind"]


def duplicate_keys(rows: DataFrame, key: list[str], facts: list[str]) -> DataFrame:
    """Keys that occur more than once: ``copies``, and ``variants`` (different facts; rows with nulls count too)."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies"), F.count_distinct(F.struct(*facts)).alias("variants")).filter("copies > 1")


def hour_validity(ticks: DataFrame, contracts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every tick with its hour, ``regular`` (the hour meets the session) and the first reason that makes it invalid.

    Contracts and sessions are joined from the left side, so no tick is lost or
    multiplied; duplicates are found with a window over the tick's own key.
    """
    rows = ticks.withColumn("start", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumn("session", F.to_date("ts"))
    rows = rows.withColumn("copies", F.count("*").over(W.partitionBy("contract", "start", "kind")))
    known = contracts.select("contract", F.lit(True).alias("known_"), F.col("reason").alias("reason_"))
    rows = rows.join(known, "contract", "left").join(sessions, "session", "left")
    hour = F.expr("INTERVAL '1' HOUR")
    regular = F.coalesce((F.col("start") < F.col("close_at")) & (F.col("start") + hour > F.col("open_at")), F.lit(False))
    reason = F.when(F.col("known_").isNull(), "missing_reference").when(F.col("reason_").isNotNull(), F.col("reason_")).when(F.col("ts").isNull(), "missing_timestamp").when(F.col("copies") > 1, "duplicate_hour").when(F.col("cents") <= 0, "invalid_price").when(F.col("open_at").isNull(), "no_session")
    return rows.withColumns({"regular": regular, "reason": reason}).drop("known_", "reason_")


def contract_days(ticks: DataFrame) -> DataFrame:
    """Rollup of valid and all ticks of a contract and day, in row order where order counts.

    Sums over no usable row are 0, first and last of none are null.
    """
    usable = F.col("usable")
    first = lambda x: F.min_by(F.when(usable, x), F.when(usable, F.col("row_id")))
    last = lambda x: F.max_by(F.when(usable, x), F.when(usable, F.col("row_id")))
    c = F.col("cents")
    return ticks.groupBy("contract", F.to_date("ts").alias("session")).agg(
        F.count("*").alias("rows"), F.count_if(usable).alias("usable_rows"), first(c).alias("opening"), last(c).alias("mark"),
        F.max(F.when(usable, c)).alias("high"), F.min(F.when(usable, c)).alias("low"), F.coalesce(F.sum(F.when(usable, c)), F.lit(0)).alias("volume"),
        F.count_if(~usable).alias("invalid_rows"), F.min(F.when(usable, F.col("ts"))).alias("first_at"), F.max(F.when(usable, F.col("ts"))).alias("last_at"),
    )


def reconcile(hours: DataFrame, days: DataFrame) -> DataFrame:
    """Days from hours against independent daily bars: each term of the failure counts only where it's known.

    The hours are summed by day before the join, so rows never multiply.
    """
    day = hours.groupBy("contract", F.date_trunc("day", "start").cast("timestamp_ntz").alias("start")).agg(
        F.min_by("open", "start").alias("h_open"), F.max("high").alias("h_high"), F.min("low").alias("h_low"), F.max_by("close", "start").alias("h_close"), F.sum("volume").alias("h_volume"), F.sum("transactions").alias("h_transactions")
    )
    both = day.join(days, ["contract", "start"], "left")
    known = lambda x: F.coalesce(x, F.lit(False))
    differs = known(F.abs(F.col("h_volume") - F.col("volume")) >= 50)
    for name in ("open", "high", "low", "close"):
        differs = differs | known(F.col(f"h_{name}") != F.col(name))
    status = F.when(F.col("volume").isNull(), "no_daily_bar").when(differs, "failed").otherwise("agreed")
    return both.select("contract", "start", "h_volume", "h_transactions", "volume", status.alias("status"))


def exclusions(contracts: DataFrame, checked: DataFrame, reconciled: DataFrame) -> DataFrame:
    """One row for each excluded thing of three grains: grain, contract, at, reason, n."""
    a = contracts.filter("reason is not null").select(F.lit("reference").alias("grain"), "contract", F.lit(None).cast("timestamp_ntz").alias("at"), "reason", F.lit(1).cast("long").alias("n"))
    b = checked.filter("reason is not null").groupBy("contract", "start", "reason").agg(F.count("*").alias("n")).select(F.lit("hour").alias("grain"), "contract", F.col("start").alias("at"), "reason", "n")
    c = reconciled.filter("status = 'failed'").select(F.lit("contract_day").alias("grain"), "contract", F.col("start").alias("at"), F.lit("reconciliation_failed").alias("reason"), F.lit(1).cast("long").alias("n"))
    return a.unionByName(b).unionByName(c)


def exclusion_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grain", "reason").agg(F.sum("n").alias("n"), F.count_distinct("contract").alias("contracts"))


def provenance(fetches: DataFrame) -> DataFrame:
    """How each contract was fetched: its kinds in order, whether by one alone, its last time."""
    return fetches.groupBy("contract").agg(F.count("*").alias("fetches"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max("at").alias("last_at"), F.when(F.count("*") == 1, F.max("kind")).alias("only_kind"))


def fetch_audit(fetches: DataFrame) -> DataFrame:
    """Counts of each kind: all, empty, late, and the first and last time."""
    return fetches.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("results") == 0).alias("empty"), F.count_if(F.col("results") > 4).alias("many"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_distinct("contract").alias("contracts"))


def without(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``done``."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def missing_windows(calendar: DataFrame, have: DataFrame, group: str) -> DataFrame:
    """Gaps and islands: the runs of consecutive sessions that a group lacks, between its own first and last.

    ``calendar`` has every session of ``have``; a group's sessions are counted out by ordinal, not by a range join.
    """
    span = have.join(F.broadcast(calendar), "session").groupBy(group).agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"))
    wanted = span.select(group, F.explode(F.sequence("a", "b")).alias("ordinal")).join(F.broadcast(calendar), "ordinal").select(group, "session", "ordinal")
    gaps = wanted.join(have.select(group, "session"), [group, "session"], "left_anti")
    island = F.col("ordinal") - F.row_number().over(W.partitionBy(group).orderBy("ordinal"))
    return gaps.withColumn("island", island).groupBy(group, "island").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count("*").alias("sessions")).drop("island")


def mismatched_days(hours: DataFrame, days: DataFrame, least: int = 50) -> DataFrame:
    """For each contract the days on which hourly and daily volumes are ``least`` or more apart, and the days without hours."""
    h = hours.groupBy("contract", F.date_trunc("day", "start").cast("timestamp_ntz").alias("start")).agg(F.sum("volume").alias("hv"))
    both = days.select("contract", "start", "volume").join(h, ["contract", "start"], "left")
    return both.groupBy("contract").agg(F.count_if(F.abs(F.coalesce("hv", F.lit(0)) - F.col("volume")) >= least).alias("mismatched"), F.count_if(F.col("hv").isNull()).alias("without_hours"), F.count("*").alias("days"))


def activity(rows: DataFrame, by: list[str]) -> DataFrame:
    """Liquidity of option rows in each cell: rows, contracts, tickers, volume, active and wide rows, median.

    Rows are summed by contract before anything is counted as different; a cell's
    tickers are a dimension. The median comes from counts of the whole numbers ``oi``.
    """
    by_contract = rows.groupBy(*by, "l_partkey", "ticker").agg(F.count("*").alias("n"), F.sum("oi").alias("volume"), F.count_if(F.col("oi") >= 20).alias("active"))
    sums = by_contract.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("contracts"), F.size(F.collect_set("ticker")).cast("long").alias("tickers"), F.sum("volume").cast("long").alias("volume"), F.sum("active").alias("active"))
    return matched(sums, counted_quantile(rows, by, "oi", 0.5, "median_oi"), by)


def hour_activity(rows: DataFrame) -> DataFrame:
    """Liquidity of hour bars by ticker, side, days to expiry, strike distance, hour, session, validity and reason.

    Contracts and sessions of a cell are counted as different after bars were summed
    by both; unknown keys are keys, and a cell without a known volume has no median.
    """
    keys = ["ticker", "side", "dte_band", "strike_band", "hour", "regular", "valid", "reason"]
    named = rows.withColumns({"side": F.coalesce("side", F.lit("")), "ticker": F.coalesce("ticker", F.lit("")), "reason": F.coalesce("reason", F.lit("")), "hour": F.coalesce("hour", F.lit(-1))})
    first = named.groupBy(*keys, "contract", "session").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"), F.sum("transactions").alias("transactions"), F.count_if(F.col("transactions") == 1).alias("single"), F.count_if(F.col("volume") <= 5).alias("small"))
    total = first.groupBy(*keys).agg(F.sum("bars").alias("bars"), F.count_distinct("contract").alias("contracts"), F.count_distinct(F.coalesce("session", F.lit("1900-01-01").cast("date"))).alias("sessions"), *[F.sum(c).alias(c) for c in ("volume", "transactions", "single", "small")])
    return matched(total, counted_quantile(named, keys, "volume", 0.5, "median_volume"), keys)


def minute_cost(n: Column) -> Column:
    """Transactions between 0 and 960, 960 where unknown."""
    return F.coalesce(F.greatest(F.least(n, F.lit(960)), F.lit(0)), F.lit(960))


def plan_windows(days: DataFrame, budget: int = 45_000) -> DataFrame:
    """Days of each contract packed greedily, in order, into windows of at most ``budget`` minutes.

    Each step depends on where the last window began, so a contract's days (one
    for each session, a bounded number) go through one Python group.
    """

    def pack(frame):  # noqa: ANN001, ANN202
        frame = frame.sort_values("session").reset_index(drop=True)
        number, used, out = 0, 0, []
        for cost in frame["cost"]:
            if used and used + cost > budget:
                number, used = number + 1, 0
            used += cost
            out.append(number)
        frame["window"] = out
        return frame[["contract", "session", "cost", "window"]]

    return days.select("contract", "session", F.col("cost").cast("long")).groupBy("contract").applyInPandas(pack, "contract long, session date, cost long, window long")
