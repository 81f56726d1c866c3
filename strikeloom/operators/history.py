"""What was known before an origin: matured samples, expanding empirical chances, training rows, the trading time that remains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRID = (-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5)  # fixed values: standardised thresholds
LOOKBACK = 1096  # days


def running_counts(samples: DataFrame, origins: DataFrame, group: list[str], at: Column, names: list[str], prefix: str) -> DataFrame:
    """``origins`` (group, day) with the sums of ``names`` over their group's samples whose ``at`` is before ``day``.

    Both are laid on one line, origins before samples of the same day, and summed
    up along it: one shuffle, no range join.
    """
    zero = [F.lit(0).cast("long").alias(n) for n in names]
    line = samples.select(*group, at.alias("day"), F.lit(1).alias("kind"), *names).unionByName(origins.select(*group, "day", F.lit(0).alias("kind"), *zero))
    before = W.partitionBy(*group).orderBy("day", "kind").rowsBetween(W.unboundedPreceding, -1)
    summed = line.select(*group, "day", "kind", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{prefix}{n}") for n in names])
    return summed.filter("kind = 0").drop("kind")


def prior_counts(samples: DataFrame, origins: DataFrame, group: list[str]) -> DataFrame:
    """For each origin (group, day) the samples that had matured before it, from the last LOOKBACK days: ``n``, and how many lay above and below each of GRID.

    ``samples``: group, origin, maturity (dates), z. What is too old is taken off what
    has matured, as every maturity lies within the lookback.
    """
    signs = {"n": F.lit(1).cast("long")}
    for i, t in enumerate(GRID):
        signs |= {f"above{i}": (F.col("z") > t).cast("long"), f"below{i}": (F.col("z") < t).cast("long")}
    rows = samples.withColumns(signs)
    names = list(signs)
    days = origins.select(*group, "day").distinct()
    matured = running_counts(rows, days, group, F.col("maturity"), names, "m_")
    old = running_counts(rows, days, group, F.date_add("origin", LOOKBACK), names, "o_")
    both = matured.join(old, [*group, "day"])
    return both.select(*group, "day", *[(F.col(f"m_{n}") - F.col(f"o_{n}")).alias(n) for n in names])


def validation_records(samples: DataFrame, validation: DataFrame, group: list[str], least: int = 20) -> DataFrame:
    """Each validation outcome at every threshold and side with its empirical chance from samples matured before it; origins with fewer than ``least`` are left out.

    ``validation``: group, day (its origin), z. One row for each origin, threshold and
    side: ``hit``, ``chance``, ``n``.
    """
    counts = prior_counts(samples, validation, group).filter(F.col("n") >= least)
    each = []
    for i, t in enumerate(GRID):
        each += [F.struct(F.lit(t).alias("threshold"), F.lit("call").alias("side"), (F.col("z") > t).alias("hit"), (F.col(f"above{i}") / F.col("n")).alias("chance"))]
        each += [F.struct(F.lit(t).alias("threshold"), F.lit("put").alias("side"), (F.col("z") < t).alias("hit"), (F.col(f"below{i}") / F.col("n")).alias("chance"))]
    rows = validation.join(counts, [*group, "day"]).withColumn("x", F.explode(F.array(*each)))
    return rows.select(*group, "day", "n", "x.*")


def training_rows(stocks: DataFrame, origins: int = 12, horizons: int = 25, first: int = 60) -> DataFrame:
    """ticker, place, horizon and the forward log return at ``origins`` evenly spaced places of each ticker's bars, horizons 1 to 25.

    ``stocks``: ticker, ts, close, split. A horizon with a split in it is left out.
    Bars are numbered by a window; the later closes come as one sliced frame.
    """
    w = W.partitionBy("ticker").orderBy("ts")
    ahead = w.rowsBetween(1, horizons)
    rows = stocks.withColumns({"place": F.row_number().over(w) - 1, "size": F.count("*").over(W.partitionBy("ticker")), "later": F.collect_list("close").over(ahead), "splits": F.collect_list("split").over(ahead)})
    step = (F.col("size") - horizons - 1 - first) / F.lit(float(origins - 1))
    chosen = F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(origins - 1)), lambda k: F.floor(k * F.col("step") + first)), F.col("place").cast("long"))
    rows = rows.withColumn("step", step).filter((F.col("size") > first + horizons) & chosen)
    each = rows.select("ticker", "ts", "place", "close", "splits", F.posexplode("later").alias("k", "price"))
    clean = F.aggregate(F.slice("splits", 1, F.col("k") + 1), F.lit(0.0), lambda a, x: a + x) <= 0
    return each.filter(clean).select("ticker", "ts", "place", (F.col("k") + 1).alias("horizon"), F.log(F.try_divide("price", "close")).alias("target"))


def remaining_fraction(quotes: DataFrame, sessions: DataFrame) -> DataFrame:
    """``quotes`` (completed, expiry, at) with the share of trading seconds between both sessions that is left after ``at``; null outside.

    ``sessions``: session, open_at, close_at. Seconds are run up along the calendar
    once and looked up by session: no range join. ``last`` is the latest session up to
    the expiry.
    """
    seconds = F.expr("timestampdiff(SECOND, open_at, close_at)")
    line = sessions.withColumns({"upto": F.sum(seconds).over(W.orderBy("session")), "own": seconds})
    days = line.select("session", "close_at", "upto")
    # expiries and quote days that are no sessions take the session before them
    every = quotes.select(F.col("expiry").alias("d")).union(quotes.select(F.to_date("at").alias("d"))).union(sessions.select(F.col("session").alias("d"))).distinct()
    w = W.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    known = every.join(line.withColumnRenamed("session", "d"), "d", "left").withColumn("s", F.when(F.col("upto").isNotNull(), F.struct(F.col("d").alias("session"), "open_at", "close_at", "upto", "own")))
    known = known.select("d", F.last("s", True).over(w).alias("s"))
    start = days.toDF("completed", "start_at", "start_sum")
    rows = quotes.join(start, "completed", "left")
    rows = rows.join(known.select(F.col("d").alias("expiry"), F.col("s").alias("end")), "expiry", "left")
    rows = rows.withColumn("day_", F.to_date("at")).join(known.select(F.col("d").alias("day_"), F.col("s").alias("now")), "day_", "left").drop("day_")
    begun = F.expr("greatest(0L, least(now.own, timestampdiff(SECOND, now.open_at, at)))")
    spent = F.col("now.upto") - F.col("now.own") + begun - F.col("start_sum")
    total = F.col("end.upto") - F.col("start_sum")
    good = (F.col("end.session") > F.col("completed")) & (F.col("at") >= F.col("start_at")) & (F.col("at") < F.col("end.close_at"))
    return rows.withColumn("fraction", F.when(good & (total > 0), (total - spent) / total)).drop("start_at", "start_sum", "end", "now")


NORMAL = tuple(0.5 * (1 + math.erf(t / math.sqrt(2))) for t in GRID)


def empirical_gate(samples: DataFrame, validation: DataFrame, blocks: DataFrame, group: list[str], least_blocks: int = 30, least_validation: int = 10) -> DataFrame:
    """Whether the empirical chances of a group beat the normal ones on outcomes after them: deltas of Brier score and log loss, and a reason if not.

    ``blocks``: group, blocks (independent ones). Records are those of
    ``validation_records``; both kinds of chances are clipped for the log loss alone.
    """
    records = validation_records(samples, validation, group)
    each = F.element_at(F.map_from_arrays(F.array(*map(F.lit, GRID)), F.array(*map(F.lit, NORMAL))), F.col("threshold"))
    base = F.when(F.col("side") == "call", 1 - each).otherwise(each)
    y = F.col("hit").cast("double")
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = lambda p: -F.log(F.when(F.col("hit"), clip(p)).otherwise(1 - clip(p)))
    scored = records.groupBy(*group).agg(F.count_distinct("day").alias("validated"), F.avg((F.col("chance") - y) ** 2 - (base - y) ** 2).alias("brier_delta"), F.avg(loss(F.col("chance")) - loss(base)).alias("log_delta"))
    out = blocks.join(scored, group, "left").withColumn("validated", F.coalesce("validated", F.lit(0)))
    better = (F.col("brier_delta") < -1e-6) & (F.col("log_delta") <= 1e-12)
    reason = F.when(F.col("blocks") < least_blocks, "insufficient_independent_blocks").when(F.col("validated") < least_validation, "insufficient_validation_blocks").when(~better, "empirical_score_gate_failed")
    return out.withColumn("reason", reason)


def years_to_close(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rows`` (expiry, at) with ``years``: seconds from ``at`` to the close of the expiry's session over those of 365 days; null without one, or after it."""
    close = F.broadcast(sessions.select(F.col("session").alias("expiry"), "close_at"))
    seconds = F.expr("timestampdiff(SECOND, at, close_at)")
    return rows.join(close, "expiry", "left").withColumn("years", F.when(seconds > 0, seconds / 31_536_000)).drop("close_at")
