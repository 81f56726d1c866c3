"""Rules of live pricing and labels as ordered reasons: the first that holds is the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds (unknown counts as not), else null."""
    out = None
    for holds, name in rules:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def spot_reason(bid: Column, ask: Column, skew_s: Column, realtime: Column, age_s: Column) -> Column:
    """Why an underlying quote can't be used: spread over 2 %, fetched apart, delayed, too old or from the future."""
    return first_reason((bid.isNull() | ask.isNull() | (bid <= 0), "missing"), (ask < bid, "crossed"), ((ask - bid) / ((ask + bid) / 2) > 0.02, "wide"), (F.abs(skew_s) > 120, "skewed"), (~F.coalesce(realtime, F.lit(False)), "delayed"), ((age_s < -60) | (age_s > 300), "stale"))


def label_reason(rows: DataFrame) -> DataFrame:
    """``reason`` why an outcome can't be labelled, and ``outcome`` where it can.

    ``rows``: side, strike, expiry, as_of, standard, split, close_a, close_b (two
    sources that must agree within half a cent).
    """
    reason = first_reason(
        (~F.coalesce("standard", F.lit(False)), "nonstandard_terms"), (F.col("expiry") > F.col("as_of"), "not_expired"), (F.coalesce("split", F.lit(False)), "split"),
        (F.col("close_a").isNull(), "no_first_source"), (F.col("close_b").isNull(), "no_second_source"), (F.abs(F.col("close_a") - F.col("close_b")) > 0.005, "sources_disagree"),
    )
    from strikeloom.functions.money import classify

    return rows.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNull(), classify(F.col("side"), F.col("close_a"), F.col("strike"))))


def capture_targets(watches: DataFrame, sessions: DataFrame, now: str, minutes: tuple[int, ...] = (600, 780, 930), lookback: int = 35) -> DataFrame:
    """Capture windows due by ``now``: each watch at 10:00, 13:00 and 15:30 of each session it was open for.

    Sessions (at most ``lookback`` days) and minutes are small and broadcast.
    """
    at = F.lit(now).cast("timestamp_ntz")
    recent = sessions.filter(F.col("session") >= F.date_sub(at.cast("date"), lookback))
    slot = F.explode(F.array(*[F.lit(m) for m in minutes]))
    grid = recent.withColumn("minute", slot).withColumn("target", F.col("session").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("minute")))
    grid = grid.filter((F.col("target") >= F.col("open_at")) & (F.col("target") < F.col("close_at")) & (F.col("target") <= at))
    return watches.join(F.broadcast(grid), (F.col("created_at") <= F.col("target")) & (F.col("session") <= F.col("expiry")))


def captured(targets: DataFrame, issued: DataFrame, grace_min: int = 5) -> DataFrame:
    """Targets with their state: captured within the grace, else missed.

    Time is cut into steps of the grace, of which a target's span touches two, so
    that a target meets the issuances of two steps and not all of its contract.
    """
    step = lambda at: F.floor(F.unix_seconds(at.cast("timestamp")) / (60 * grace_min))
    spans = targets.select("contract", "target").distinct().withColumn("step", F.explode(F.array(step(F.col("target")), step(F.col("target")) + 1)))
    hit = spans.join(issued.select("contract", "issued_at", step(F.col("issued_at")).alias("step")), ["contract", "step"])
    hit = hit.filter((F.col("issued_at") >= F.col("target")) & (F.col("issued_at") < F.col("target") + F.make_dt_interval(mins=F.lit(grace_min))))
    done = hit.select("contract", "target", F.lit("captured").alias("state")).distinct()
    return targets.join(done, ["contract", "target"], "left").withColumn("state", F.coalesce("state", F.lit("missed")))


def merged_sides(calls: DataFrame, puts: DataFrame, key: list[str]) -> DataFrame:
    """Calls and puts of a strike in one row; a side that isn't listed is null."""
    a = calls.select(*key, *[F.col(c).alias(f"call_{c}") for c in calls.columns if c not in key])
    b = puts.select(*key, *[F.col(c).alias(f"put_{c}") for c in puts.columns if c not in key])
    return a.join(b, key, "full_outer")


def refreshed_tail(stored: DataFrame, fetched: DataFrame, key: str, overlap: int = 30) -> DataFrame:
    """Stored bars and the fetched ones after them, per ticker; tickers whose overlap changed are taken anew."""
    w = W.partitionBy("ticker").orderBy(F.desc(key))
    tail = stored.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= overlap).drop("n_")
    changed = tail.exceptAll(fetched.select(*stored.columns).join(tail.select("ticker", key), ["ticker", key], "left_semi").select(*stored.columns)).select("ticker").distinct()
    kept = stored.join(changed, "ticker", "left_anti")
    last = kept.groupBy("ticker").agg(F.max(key).alias("last_"))
    new = fetched.join(last, "ticker", "left").filter(F.col("last_").isNull() | (F.col(key) > F.col("last_"))).select(*stored.columns)
    return kept.unionByName(new)
