"""What a contest of a candidate against the baseline reports besides its deltas: attempts, calibration, subgroups, latencies, CRPS.

All reports are aggregates of pairs (``inference.evaluated``) or attempts; a unit is
a ticker, origin and horizon, and the mean over its contracts counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.operators.quantiles import continuous_quantiles

UNIT = ["ticker", "origin", "horizon"]
#: Support that a subgroup needs to be read by itself (fixed values).
LEAST_UNITS, LEAST_DATES = 100, 10


def _attempts(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Attempts of both methods with ``kind``: kept, later (another vintage than the unit's first baseline) or orphan (no baseline in the unit)."""
    base = rows.filter(F.col("method") == baseline)
    chosen = base.groupBy(*UNIT).agg(F.min_by(F.struct("vintage"), F.struct("issued", "seq")).alias("v")).select(*UNIT, F.col("v.vintage").alias("chosen"), F.lit(True).alias("has"))
    own = rows.filter(F.col("method").isin(baseline, candidate)).join(chosen, UNIT, "left")
    same = F.col("vintage").eqNullSafe(F.col("chosen")) & ((F.col("method") == baseline) | F.col("vintage").isNotNull())
    return own.withColumn("kind", F.when(F.col("has").isNull(), "orphan").when(same, "kept").otherwise("later")).drop("chosen", "has")


def attempt_counts(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """One row: attempts left out as later vintages or repeats, contract cells, and how many of them each method tried and had a probability for.

    Of a cell's attempts by a method the first issued counts; cells of orphans have no baseline.
    """
    own = _attempts(rows, baseline, candidate)
    cells = own.filter("kind <> 'later'").groupBy(*UNIT, "contract").agg(
        F.max((F.col("kind") == "orphan").cast("int")).alias("orphan"),
        *[F.count_if((F.col("method") == m) & (F.col("kind") == "kept")).alias(name) for m, name in ((baseline, "n_base"), (candidate, "n_candidate"))],
        *[F.min_by("probability", F.when((F.col("method") == m) & (F.col("kind") == "kept"), F.struct("issued", "seq"))).alias(name) for m, name in ((baseline, "p_base"), (candidate, "p_candidate"))],
    )
    sums = cells.agg(
        F.count("*").alias("cells_attempted"), F.count_if(F.col("orphan") == 1).alias("orphan_cells"), F.sum(F.greatest(F.col("n_base") - 1, F.lit(0)) + F.greatest(F.col("n_candidate") - 1, F.lit(0))).alias("duplicates_excluded"),
        F.count_if(F.col("n_base") > 0).alias("baseline_attempted"), F.count("p_base").alias("baseline_available"), F.count_if(F.col("p_base").isNotNull() & F.col("p_candidate").isNotNull()).alias("candidate_available"),
    )
    later = own.agg(F.count_if(F.col("kind") == "later").alias("later_vintages_excluded"))
    return sums.withColumn("one", F.lit(1)).join(later.withColumn("one", F.lit(1)), "one").drop("one").fillna(0)


def unit_scores(pairs: DataFrame) -> DataFrame:
    """Means of each unit's scored contracts: Brier scores of both, and CRPS of both where both have it (``crps_base``, ``crps_candidate`` of the pairs)."""
    y = F.col("itm").cast("double")
    both = F.col("crps_base").isNotNull() & F.col("crps_candidate").isNotNull()
    return pairs.filter("outcome = 'scored'").groupBy(*UNIT).agg(
        *[F.avg((F.col(p) - y) * (F.col(p) - y)).alias(name) for p, name in (("p_base", "brier_baseline"), ("p_candidate", "brier_candidate"))],
        *[F.avg(F.when(both, F.col(c))).alias(name) for c, name in (("crps_base", "crps_baseline"), ("crps_candidate", "crps_candidate"))], F.count("*").alias("contracts"),
    )


def calibration_by_side(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """side, bin, units, forecast and observed: of a unit's contracts in a bin the means, then the mean of units; the last bin is closed."""
    place = F.least(F.floor(F.col("p_candidate") * bins), F.lit(bins - 1)).cast("int")
    units = pairs.filter("outcome = 'scored'").groupBy("side", place.alias("bin"), *UNIT).agg(F.avg("p_candidate").alias("p"), F.avg(F.col("itm").cast("double")).alias("y"))
    return units.groupBy("side", "bin").agg(F.count("*").alias("units"), F.avg("p").alias("forecast"), F.avg("y").alias("observed"))


def subgroups(pairs: DataFrame, categories: list[str], least_units: int = LEAST_UNITS, least_dates: int = LEAST_DATES) -> DataFrame:
    """category, value, units, dates, brier_delta and whether they are enough: a unit's contracts of the value are one mean."""
    y = F.col("itm").cast("double")
    delta = (F.col("p_candidate") - y) ** 2 - (F.col("p_base") - y) ** 2
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in categories]))
    rows = pairs.filter("outcome = 'scored'").select(*UNIT, delta.alias("delta"), each.alias("x")).select(*UNIT, "delta", "x.*")
    units = rows.groupBy("category", "value", *UNIT).agg(F.avg("delta").alias("delta"))
    # dates are summed before they are counted as different
    dates = units.groupBy("category", "value", "origin").agg(F.count("*").alias("n"), F.sum("delta").alias("sum"))
    out = dates.groupBy("category", "value").agg(F.sum("n").alias("units"), F.count("*").alias("dates"), (F.sum("sum") / F.sum("n")).alias("brier_delta"))
    return out.withColumn("supported", (F.col("units") >= least_units) & (F.col("dates") >= least_dates))


def latencies(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """label (prepare, lookup), n, p50 and p95 of the candidate's milliseconds, of the first issued attempt of each ticker and origin (prepare) or unit (lookup); negative and unknown ones are left out."""
    own = _attempts(rows, baseline, candidate).filter((F.col("kind") == "kept") & (F.col("method") == candidate))
    first = lambda key, column, label: own.groupBy(*key).agg(F.min_by(F.struct(F.col(column).alias("ms")), F.struct("issued", "seq")).alias("x")).select(F.lit(label).alias("label"), "x.ms")
    timed = first(["ticker", "origin"], "prepare_ms", "prepare").unionByName(first(UNIT, "lookup_ms", "lookup")).filter("ms >= 0 and not isnan(ms)")
    return continuous_quantiles(timed, ["label"], "ms", {"p50": 0.5, "p95": 0.95}).join(timed.groupBy("label").agg(F.count("*").alias("n")), "label")
