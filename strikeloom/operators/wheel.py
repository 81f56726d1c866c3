"""The capture of wheel candidates: lookups around a decision, why a candidate has no outcome, and descriptives of the lattice they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.functions.money import classify
from strikeloom.operators.quantiles import continuous_quantiles, counted, matched
from strikeloom.sources.scratch import written

CELL = ["ticker", "side", "panel", "period", "depth_band", "horizon_band"]
#: Stocks' days that may be broadcast; they are counted first.
MOST_BARS = 100_000
#: Levels of the lattice: from all keys up to everything.
LEVELS = (tuple(CELL), ("ticker", "side", "panel", "period"), ("panel", "period", "depth_band", "horizon_band"), ("panel", "period"), ())


def candidates(days: DataFrame, stocks: DataFrame, sessions: DataFrame, longest: int = 25) -> DataFrame:
    """Every contract-day with what is known at its decision, at entry and at expiry, ``status`` and ``reason``.

    ``days``: contract, ticker, side, session, expiry, strike, mark, volume, valid,
    reconciliation_failed, opening; ``stocks``: ticker, session, open, close, action (a
    dividend or split, null where unknown); ``sessions``: a calendar, broadcast. The
    decision is at ``session``, the entry at the next one. All lookups are
    equi-joins on contract, ticker and day; stocks' days are counted and broadcast, if they are few; actions between entry and expiry are
    counted by differences of running sums, not by a range join. Reasons come in the
    order of the checks; rows that can't be candidates at all have status ``ignored``.
    """
    line = W.orderBy("session")
    calendar = F.broadcast(sessions.select("session", F.row_number().over(line).alias("place"), F.lead("session").over(line).alias("entry")))
    run = W.partitionBy("ticker").orderBy("session").rowsBetween(W.unboundedPreceding, 0)
    acted = stocks.withColumns({"acts": F.sum((F.coalesce("action", F.lit(0.0)) != 0).cast("long")).over(run), "unsure": F.sum(F.col("action").isNull().cast("long")).over(run), "bars": F.count("*").over(run)})
    acted = counted(acted.drop("action"), MOST_BARS)
    at = lambda day, prefix, *columns: acted.select("ticker", F.col("session").alias(day), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    later = days.select("contract", F.col("session").alias("entry"), F.col("opening").alias("option_entry"), F.col("valid").alias("entry_valid"), F.col("reconciliation_failed").alias("entry_failed"))
    # contract-days meet once, before anything else makes them wider
    rows = days.join(calendar, "session", "left").join(later, ["contract", "entry"], "left").join(calendar.select(F.col("session").alias("expiry"), F.col("place").alias("end")), "expiry", "left")
    rows = rows.join(at("session", "decision_", "close", "acts", "unsure", "bars"), ["ticker", "session"], "left").join(at("entry", "entry_", "open"), ["ticker", "entry"], "left").join(at("expiry", "expiry_", "close", "acts", "unsure", "bars"), ["ticker", "expiry"], "left")
    rows = rows.withColumn("horizon", F.col("end") - F.col("place"))
    good = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    inside = classify(F.col("side"), F.col("decision_close"), F.col("strike")) == "itm"
    path = F.col("horizon") - (F.col("expiry_bars") - F.col("decision_bars"))
    ignored = (
        F.when(~good("decision_close"), "decision_missing_verified_stock").when(~F.coalesce(F.col("horizon").between(1, longest), F.lit(False)) | F.col("entry").isNull(), "outside_horizons")
        .when(~F.coalesce("valid", F.lit(False)) | ~good("mark") | ~good("volume"), "invalid_decision_observation").when(~F.coalesce(inside, F.lit(False)), "outside_strict_moneyness")
    )
    no_entry = F.when(~good("entry_open"), "missing_verified_stock_open").when(F.coalesce(classify(F.col("side"), F.col("entry_open"), F.col("strike")) != "itm", F.lit(True)), "opening_moneyness_changed").when(~good("option_entry"), "missing_opening_bucket")
    excluded = (
        F.when(F.coalesce("reconciliation_failed", F.lit(False)) | ~F.coalesce("entry_valid", F.lit(True)) | F.coalesce("entry_failed", F.lit(False)), "reconciliation_failure").when(~good("expiry_close"), "missing_verified_expiry_close")
        .when(path > 0, "stock_session_missing").when(F.col("expiry_unsure") > F.col("decision_unsure"), "actions_unknown").when(F.col("expiry_acts") > F.col("decision_acts"), "corporate_action")
    )
    rows = rows.withColumns({"ignored_": ignored, "no_entry_": no_entry, "excluded_": excluded})
    status = F.when(F.col("ignored_").isNotNull(), "ignored").when(F.col("no_entry_").isNotNull(), "no_entry").when(F.col("excluded_").isNotNull(), "excluded").otherwise("scored")
    return rows.select(*days.columns, "entry", "horizon", "decision_close", F.col("entry_open").alias("stock_entry"), "option_entry", "expiry_close", status.alias("status"), F.coalesce("ignored_", "no_entry_", "excluded_").alias("reason"))


def capture_descriptives(rows: DataFrame) -> DataFrame:
    """Of each level of the lattice (LEVELS): cells, origins, expiries, contracts, scored ones, and mean and median of the cells' returns.

    ``rows``: CELL, origin, expiry, scored, ret, time_yield. A cell is an origin and
    expiry within all keys, so that a large grid of strikes has no more weight than a
    small one. Rows are summed into cells once, which are written; all levels come from the written cells,
    their medians from counts at each level (``continuous_quantiles``). Keys
    that a level leaves out are null and told apart by ``level``; null keys are keys.
    """
    cells = rows.groupBy(*CELL, "origin", "expiry").agg(F.count("*").alias("contracts"), F.count_if("scored").alias("scored"), F.sum(F.when(F.col("scored"), F.col("ret"))).alias("returns"), F.sum("time_yield").alias("yields"))
    cells = written(cells.withColumns({"cell_return": F.try_divide("returns", "scored"), "cell_yield": F.try_divide("yields", "contracts")}).drop("returns", "yields"), "cells")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in keys else F.lit(None).cast("string")).alias(c) for c in CELL]) for k, keys in enumerate(LEVELS)]))
    placed = cells.select(each.alias("at"), *[c for c in cells.columns if c not in CELL]).select("at.*", *[c for c in cells.columns if c not in CELL])
    by = ["level", *CELL]
    # origins and expiries of a level are days: summed by each before they are counted as different
    dated = placed.groupBy(*by, "origin").agg(F.count("*").alias("cells"), F.sum("contracts").alias("contracts"), F.sum("scored").alias("scored"), F.sum("cell_return").alias("returns"), F.count("cell_return").alias("returned"), F.sum("cell_yield").alias("yields"))
    sums = dated.groupBy(*by).agg(
        F.sum("cells").alias("cells"), F.count("origin").alias("origins"), F.sum("contracts").alias("contracts"), F.sum("scored").alias("scored"),
        F.try_divide(F.sum("returns"), F.sum("returned")).alias("mean_return"), F.try_divide(F.sum("yields"), F.sum("cells")).alias("mean_yield"),
    )
    expiries = placed.groupBy(*by, "expiry").agg(F.lit(1)).groupBy(*by).agg(F.count("expiry").alias("expiries"))
    sums = matched(sums, expiries, by).select(*by, "cells", "origins", "expiries", "contracts", "scored", "mean_return", "mean_yield")
    return matched(sums, continuous_quantiles(placed, by, "cell_return", {"median_return": 0.5}), by)
