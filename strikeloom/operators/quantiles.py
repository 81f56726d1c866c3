"""Exact quantiles and running sums of groups of any size: no group is held in a heap or sorted in one task.

Groups' ranges and counts in buckets are the only things that meet: they are few
rows a group, whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups whose ranges may be broadcast; they are counted first.
MOST_GROUPS = 10_000


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on ``keys`` for which null is a key like any other; the keys of ``left`` stay."""
    other = right.select(*[F.col(k).alias(f"{k} of right") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"{k} of right"]) for k in keys], F.lit(True))
    return left.join(other, same, how).drop(*[f"{k} of right" for k in keys])


def counted(groups: DataFrame, most: int = MOST_GROUPS) -> DataFrame:
    """``groups``, computed once and broadcast if there are ``most`` at most; beyond that joins shuffle."""
    kept = groups.limit(most + 1).collect()
    if len(kept) > most:
        return groups
    return F.broadcast(groups.sparkSession.createDataFrame(kept, groups.schema))


def counted_quantile(rows: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """The continuous quantile of each group of values that have few distinct ones (small integers): counted, then interpolated between two of them."""
    atoms = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_"))
    w = W.partitionBy(*by)
    run = atoms.withColumns({"upto_": F.sum("n_").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "all_": F.sum("n_").over(w)})
    place = (F.col("all_") - 1) * share
    low = F.min(F.when(F.col("upto_") > F.floor(place), F.col(value)))
    high = F.min(F.when(F.col("upto_") > F.ceil(place), F.col(value)))
    part = F.max(place - F.floor(place))
    return run.groupBy(*by).agg((low + (high - low) * part).alias(name))


def bucketed(rows: DataFrame, ranges: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """``rows`` with ``bucket_``: where ``value`` lies between its group's least_ and most_ (``ranges``, see ``counted``), in ``buckets`` equal steps."""
    width = F.col("most_") - F.col("least_")
    step = F.when(width > 0, F.floor((F.col(value) - F.col("least_")) / width * buckets)).otherwise(0)
    return matched(rows, ranges.select(*by, "least_", "most_"), by, "inner").withColumn("bucket_", F.least(step, F.lit(buckets - 1)).cast("int")).drop("least_", "most_")


def ordered_values(rows: DataFrame, ranges: DataFrame, by: list[str], value: str, ranks: dict[str, Column], buckets: int = 1024) -> DataFrame:
    """For each group (by) the values of the given ranks, from 1; a rank is an expression of the group's ``count_``.

    ``ranges`` has by, least_, most_ and count_ of each group, a row each. Rows are
    counted in buckets; only those of the buckets that a rank falls in are counted by
    value. Null groups are groups; ``value`` is never null.
    """
    placed = bucketed(rows, ranges, by, value, buckets)
    counts = placed.groupBy(*by, "bucket_").agg(F.count("*").alias("n_"))
    return values_in_buckets(placed, counts, ranges, by, value, ranks)


def stepped(value: Column, steps: int = 32) -> Column:
    """A bucket of ``value`` that needs no range: ``steps`` for each factor of e beyond a millionth. It never falls as ``value`` grows; null for null."""
    step = F.floor(F.least(F.log1p(F.abs(value) * 1e6) * steps, F.lit(1e6))).cast("int")
    return F.when(value < 0, -step).otherwise(step)


def values_in_buckets(placed: DataFrame, counts: DataFrame, ranges: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``ordered_values`` of rows with a ``bucket_``, counted by it (``counts``: by, bucket_, n_); ``ranges`` has by and count_ of each group."""
    w = W.partitionBy(*by).orderBy("bucket_")
    run = matched(counts.withColumn("upto_", F.sum("n_").over(w.rowsBetween(W.unboundedPreceding, 0))), ranges.select(*by, "count_"), by, "inner")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    hit = run.withColumn("asked_", asked).filter((F.col("upto_") >= F.col("asked_.rank")) & (F.col("upto_") - F.col("n_") < F.col("asked_.rank")))
    hit = hit.groupBy(*by, "bucket_").agg(F.collect_list(F.struct("asked_.name", (F.col("asked_.rank") - (F.col("upto_") - F.col("n_"))).alias("rank"))).alias("asked_"))
    hit = counted(hit, MOST_GROUPS * len(ranks))
    atoms = matched(placed, hit.select(*by, "bucket_"), [*by, "bucket_"], "left_semi").groupBy(*by, "bucket_", value).agg(F.count("*").alias("n_"))
    inside = W.partitionBy(*by, "bucket_").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    each = matched(atoms.withColumn("upto_", F.sum("n_").over(inside)), hit, [*by, "bucket_"], "inner").withColumn("asked_", F.explode("asked_"))
    each = each.filter(F.col("upto_") >= F.col("asked_.rank"))
    return each.groupBy(*by).agg(*[F.min(F.when(F.col("asked_.name") == name, F.col(value))).alias(name) for name in ranks])


def lower_quantile(rows: DataFrame, ranges: DataFrame, by: list[str], value: str, share: float, name: str, buckets: int = 1024) -> DataFrame:
    """The smallest value of each group up to which at least ``share`` of its rows lie; ``ranges`` as for ``ordered_values``."""
    return ordered_values(rows, ranges, by, value, {name: F.greatest(F.ceil(F.col("count_") * share), F.lit(1))}, buckets)


def value_ranges(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, least_, most_ and count_ of the known values of each group (of the whole table, if ``by`` is empty)."""
    return counted(rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("least_"), F.max(value).alias("most_"), F.count("*").alias("count_")))


def continuous_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], ranges: DataFrame | None = None) -> DataFrame:
    """Quantiles of each group, interpolated between the two nearest known values; groups without one are left out."""
    known = rows.filter(F.col(value).isNotNull()).select(*by, value)
    ranges = ranges if ranges is not None else value_ranges(known, by, value)
    place = {name: (F.col("count_") - 1) * F.lit(share) for name, share in shares.items()}
    ranks = {f"{side} {name}": f(p) + 1 for name, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = matched(ordered_values(known, ranges, by, value, ranks), ranges.select(*by, "count_"), by, "inner")
    part = {name: p - F.floor(p) for name, p in place.items()}
    low, high = (lambda name, side=side: F.col(f"{side} {name}") for side in ("low", "high"))
    return found.select(*by, *[(low(name) + (high(name) - low(name)) * part[name]).alias(name) for name in shares])


def running(rows: DataFrame, by: list[str], order: str, amount: str, bucket: Column, name: str = "upto") -> DataFrame:
    """``rows`` (one for each group and ``order``) with the running sum of ``amount`` along ``order``, and the group's ``total``.

    ``bucket`` grows with ``order`` and deals a group; buckets are summed by
    themselves, only their sums are run up along the group.
    """
    placed = rows.withColumn("bucket_", bucket)
    sums = placed.groupBy(*by, "bucket_").agg(F.sum(amount).alias("sum_"))
    w = W.partitionBy(*by)
    starts = sums.select(*by, "bucket_", F.coalesce(F.sum("sum_").over(w.orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start_"), F.sum("sum_").over(w).alias("total"))
    inside = W.partitionBy(*by, "bucket_").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return placed.withColumn("own_", F.sum(amount).over(inside)).join(starts, [*by, "bucket_"]).withColumn(name, F.col("start_") + F.col("own_")).drop("bucket_", "own_", "start_")
