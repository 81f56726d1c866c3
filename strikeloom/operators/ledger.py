"""Forecast ledger: revisions, as-of joins, due labels, idempotent appends, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate combined before the shuffle."""
    kept = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("last_")).select(*key, "last_.*")


def labels_as_of(issued: DataFrame, labels: DataFrame, cutoff: str) -> DataFrame:
    """Every forecast issued by the cutoff with the latest label revision known then (null if none was)."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    known = latest(labels.filter(F.col("checked_at") <= at), ["contract"], [F.col("checked_at"), F.col("key")])
    return issued.filter(F.col("issued_at") <= at).join(known, "contract", "left")


def due_labels(issued: DataFrame, labels: DataFrame, as_of: str, most: int) -> DataFrame:
    """Contracts whose label is to be checked, most urgent first: never checked, then by when they fell due.

    A valid label falls due after a day, any other after an hour.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    last = latest(labels, ["contract"], [F.col("checked_at"), F.col("key")])
    due = F.when(F.col("status") == "valid", F.col("checked_at") + F.expr("INTERVAL '1' DAY")).otherwise(F.col("checked_at") + F.expr("INTERVAL '1' HOUR"))
    rows = issued.select("contract").distinct().join(last, "contract", "left").withColumn("due_at", due)
    return rows.filter(F.col("due_at").isNull() | (F.col("due_at") <= at)).orderBy(F.col("due_at").asc_nulls_first(), "contract").limit(most)


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, carry: list[str], tie: str) -> DataFrame:
    """For each left row the last right row of its key at or before its time (``tie``: the larger wins at one time).

    Both sides are laid on one time line and the last right row is carried
    forward: one shuffle by key, no range join, and never more rows than both have.
    """
    own = [c for c in left.columns if c not in key]
    a = left.select(*key, F.col(left_time).alias("t_"), F.lit(1).alias("side_"), F.struct(*own).alias("own_"), F.lit(None).alias("seen_"), F.lit(None).alias("tie_"))
    b = right.select(*key, F.col(right_time).alias("t_"), F.lit(0).alias("side_"), F.lit(None).alias("own_"), F.struct(*carry).alias("seen_"), F.col(tie).alias("tie_"))
    line = W.partitionBy(*key).orderBy("t_", "side_", "tie_").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("seen_", F.last("seen_", ignorenulls=True).over(line))
    return both.filter("side_ = 1").select(*key, "own_.*", *[F.col(f"seen_.{c}").alias(c) for c in carry])


def append_new(stored: DataFrame, arriving: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Stored rows and, of the arriving, the first of each key that isn't stored."""
    kept = [c for c in arriving.columns if c not in key]
    first = arriving.groupBy(*key).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("f_")).select(*key, "f_.*")
    return stored.unionByName(first.join(stored.select(*key), key, "left_anti"))


def upsert_latest(stored: DataFrame, arriving: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the latest of both sides."""
    return latest(stored.unionByName(arriving), key, order)


def coverage(issued: DataFrame, labels: DataFrame) -> DataFrame:
    """Attempted, issued (with a label) and scored (with a valid one) forecasts of each ticker and model."""
    last = latest(labels, ["contract"], [F.col("checked_at"), F.col("key")])
    rows = issued.join(last.select("contract", "status"), "contract", "left")
    return rows.groupBy("ticker", "model").agg(F.count("*").alias("attempted"), F.count("status").alias("labelled"), F.count_if(F.col("status") == "valid").alias("scored"))


def panel_coverage(issued: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions expected and recorded for each ticker in each quarter."""
    got = issued.select("ticker", F.to_date("issued_at").alias("session")).distinct()
    quarter = F.concat(F.year("session").cast("string"), F.lit("Q"), F.quarter("session").cast("string")).alias("quarter")
    expected = calendar.groupBy(quarter).agg(F.count("*").alias("expected"))
    recorded = got.groupBy("ticker", quarter).agg(F.count("*").alias("recorded"))
    grid = got.select("ticker").distinct().join(F.broadcast(expected))
    return grid.join(recorded, ["ticker", "quarter"], "left").withColumn("recorded", F.coalesce("recorded", F.lit(0)))


def window_states(events: DataFrame, key: list[str]) -> DataFrame:
    """State of each window: captured stands over missed, missed over pending."""
    rank = F.when(F.col("state") == "captured", 2).when(F.col("state") == "missed", 1).otherwise(0)
    return events.groupBy(*key).agg(F.max(rank).alias("r"), F.count("*").alias("events")).withColumn("state", F.element_at(F.array(F.lit("pending"), F.lit("missed"), F.lit("captured")), F.col("r") + 1)).drop("r")


def due_interpolated(curve: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rates at wanted years, linear between the points around them; null outside the curve.

    A curve is a dozen points: they are gathered in one row for each, joined by
    its key, and looked through in order.
    """
    points = curve.groupBy("curve").agg(F.array_sort(F.collect_list(F.struct("years", "rate"))).alias("points"))
    after = F.filter("points", lambda p: p["years"] > F.col("years"))
    upto = F.filter("points", lambda p: p["years"] <= F.col("years"))
    hit = wanted.join(points, "curve", "left").withColumns({"p1": F.get(after, 0), "p0": F.element_at(F.when(F.size(upto) > 0, upto), -1)})
    hit = hit.withColumns({"y0": F.col("p0.years"), "r0": F.col("p0.rate"), "y1": F.col("p1.years"), "r1": F.col("p1.rate")})
    return hit.drop("points", "p0", "p1").withColumn("rate", F.col("r0") + (F.col("r1") - F.col("r0")) * (F.col("years") - F.col("y0")) / (F.col("y1") - F.col("y0")))
