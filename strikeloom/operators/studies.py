"""Studies: cost grids, expiry economics, summaries, scores, calibration, tails, frontiers, bootstraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.operators.quantiles import bucketed, continuous_quantiles, counted, matched, running, stepped, values_in_buckets
from strikeloom.sources.scratch import written

HAIRCUTS, FEES, SLIPPAGE = (0.0, 0.05, 0.10, 0.20), (0.0, 0.65), (0, 10, 25)


def cost_grid(entries: DataFrame, haircuts: tuple[float, ...] = HAIRCUTS, fees: tuple[float, ...] = FEES, slippage: tuple[int, ...] = SLIPPAGE) -> DataFrame:
    """Each entry under every haircut, fee and (calls only) slippage, with its economics at expiry.

    ``entries``: side, strike, entry (stock price), premium, close. A grid of
    24 or 8 rows for an entry is made by exploding one of two literal arrays, without a join.
    """
    cells = [(h, f, s) for h in haircuts for f in fees for s in slippage]
    grid = [F.struct(F.lit(h).alias("haircut"), F.lit(f).alias("fee"), F.lit(s).alias("slip")) for h, f, s in cells]
    still = [g for g, (_, _, s) in zip(grid, cells, strict=True) if s == 0]
    call = F.col("side") == "call"
    rows = entries.withColumn("g", F.explode(F.when(call, F.array(*grid)).otherwise(F.array(*still) if still else F.slice(F.array(*grid), 1, 0))))
    rows = rows.select(*entries.columns, "g.*")
    paid = F.col("entry") * (1 + F.col("slip") / 10000.0)
    got = F.col("premium") * (1 - F.col("haircut"))
    profit = F.when(call, (F.least("close", "strike") - paid + got) * 100).otherwise((got - F.greatest(F.col("strike") - F.col("close"), F.lit(0.0))) * 100) - F.col("fee")
    capital = F.when(call, paid * 100).otherwise(F.col("strike") * 100)
    benchmark = F.when(call, (F.col("close") - paid) * 100).otherwise(F.lit(0.0))
    return rows.withColumns({"profit": profit, "capital": capital, "benchmark": benchmark, "ret": F.try_divide(profit, capital), "excess": F.try_divide(profit - benchmark, capital), "assigned": F.when(call, F.col("close") > F.col("strike")).otherwise(F.col("close") < F.col("strike"))})


def strategy_summary(grid: DataFrame, by: list[str]) -> DataFrame:
    """Count, means and the 5 % lower quantile of each cell of the grid.

    The grid is made twice as it is read: for sums and counts in steps of the return, written
    once, which give the means and the step of each cell's quantile, and for the values in that step.
    """
    ret, hit = F.col("ret"), F.col("assigned").cast("long")
    placed = grid.select(*by, "ret", "excess", "assigned").withColumn("bucket_", stepped(ret))
    sums = {"ret_": F.sum(ret), "rets_": F.count(ret), "excess_": F.sum("excess"), "excesses_": F.count("excess"), "hits_": F.sum(hit), "known_": F.count(hit), "losses_": F.count_if(ret < 0)}
    steps = written(placed.groupBy(*by, "bucket_").agg(F.count("*").alias("n_"), *[x.alias(name) for name, x in sums.items()]), "summary")
    mean = lambda total, count, name: F.try_divide(F.sum(total), F.sum(count)).alias(name)
    known = steps.groupBy(*by).agg(F.sum("n_").alias("n"), mean("ret_", "rets_", "mean_ret"), mean("excess_", "excesses_", "mean_excess"), mean("hits_", "known_", "assigned"), mean("losses_", "rets_", "losses"), F.sum("rets_").alias("count_"))
    q = values_in_buckets(placed.filter("ret is not null").select(*by, "ret", "bucket_"), steps.filter("bucket_ is not null").select(*by, "bucket_", "n_"), known.select(*by, "count_"), by, "ret", {"q05": F.greatest(F.ceil(F.col("count_") * 0.05), F.lit(1))})
    return matched(known.drop("count_"), q, by)


def reward_per_day(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ratio of summed returns to summed days, median, share of losses; the median by counts, in no one buffer."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum("ret"), F.sum("days")).alias("reward"), F.avg((F.col("ret") < 0).cast("double")).alias("losses"))
    return matched(sums, continuous_quantiles(rows, by, "ret", {"median": 0.5}), by)


def scored(rows: DataFrame) -> DataFrame:
    """Brier score and log loss (probability clipped to 1e-6) of ``p`` against ``y``."""
    q = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col("y").cast("double")
    return rows.withColumns({"brier": (F.col("p") - y) * (F.col("p") - y), "log_loss": -F.log(F.when(F.col("y"), q).otherwise(1 - q))})


def calibration(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Reliability table: forecasts and outcomes in equal bins, the last closed."""
    b = F.least(F.greatest(F.floor(F.col("p") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("forecast"), F.avg(F.col("y").cast("double")).alias("observed"))


def unit_means(rows: DataFrame, unit: list[str], metric: str, valid: Column) -> DataFrame:
    """Mean and number of valid values in each unit."""
    return rows.groupBy(*unit).agg(F.avg(F.when(valid, F.col(metric))).alias("mean"), F.count_if(valid).alias("n"), F.count("*").alias("rows"))


def tail_stats(rows: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Left quantile and mean of the lowest ``alpha`` of the weight of ``x``, the atom on the border counted in part.

    Equal values (whole numbers, such as basis points) are summed first; the running
    weight then needs one row for each value, and is taken in stretches of 64.
    """
    atoms = rows.groupBy(*by, "x").agg(F.sum("w").alias("w"))
    run = running(atoms, by, "x", "w", F.floor(F.col("x") / 64))
    mass = F.col("total") * alpha
    part = F.greatest(F.lit(0.0), F.least(F.col("w").cast("double"), mass - (F.col("upto") - F.col("w"))))
    return run.withColumns({"part": part, "reached": F.col("upto") >= mass}).groupBy(*by).agg(F.min(F.when(F.col("reached"), F.col("x"))).alias("quantile"), F.try_divide(F.sum(F.col("x") * F.col("part")), F.sum("part")).alias("shortfall"), F.sum("w").alias("weight"))


def terciles(rows: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Two linear tercile edges over distinct keys, and how many there are; by counts in buckets, so that no task has all values."""
    each = rows.groupBy(*key).agg(F.min(value).alias(value))
    edges = continuous_quantiles(each, [], value, {"low": 1 / 3, "high": 2 / 3})
    return matched(each.agg(F.count("*").alias("n")), edges, []).select("low", "high", "n")


def pareto(rows: DataFrame, group: list[str], high: str, low: str) -> DataFrame:
    """Rows that no other of their group beats: none has more of ``high`` and not more of ``low``.

    With two criteria a sort does: going down ``high``, a row stays if its ``low``
    is under all before it. Equal points stay together. The sort is by ranges of
    ``high``, so that a large group isn't sorted in one task; groups' ranges are counted
    and broadcast if they are few. A null group is a group; rows without a criterion are
    on no frontier.
    """
    rows = rows.filter(F.col(high).isNotNull() & F.col(low).isNotNull())
    points = rows.groupBy(*group, high).agg(F.min(low).alias("best_"))
    ranges = counted(rows.groupBy(*group).agg(F.min(high).alias("least_"), F.max(high).alias("most_")))
    placed = bucketed(points, ranges, group, high, 256)
    # the best of all buckets above, then of all points above in the bucket
    above = W.partitionBy(*group).orderBy(F.desc("bucket_")).rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(*group, "bucket_").agg(F.min("best_").alias("b_")).select(*group, "bucket_", F.min("b_").over(above).alias("start_"))
    w = W.partitionBy(*group, "bucket_").orderBy(F.desc(high)).rowsBetween(W.unboundedPreceding, -1)
    before = F.least("start_", F.min("best_").over(w))
    front = matched(placed, starts, [*group, "bucket_"], "inner").withColumn("before_", before).filter("before_ is null or best_ < before_").select(*group, high, F.col("best_").alias(low))
    return matched(rows, front, [*group, high, low], "left_semi")


def blocked_dates(days: DataFrame, group: list[str], embargo: int) -> DataFrame:
    """Dates chosen greedily, each ``embargo`` sessions or more after the last chosen.

    Every choice depends on the one before it; a group is a calendar of distinct
    dates (bounded), which one Python call walks through.
    """
    def pick(frame):  # noqa: ANN001, ANN202
        frame = frame.sort_values("ordinal")
        chosen, free = [], None
        for n in frame["ordinal"]:
            ok = free is None or n >= free
            chosen.append(ok)
            if ok:
                free = n + embargo
        return frame[chosen]

    kind = days.select(*group, "ordinal").distinct()
    return kind.groupBy(*group).applyInPandas(pick, kind.schema)


def bootstrap_interval(units: DataFrame, group: list[str], draws: int = 2000, seed: int = 1729, least: int = 20) -> DataFrame:
    """Mean of units and its 95 % interval from resampled dates; null under ``least`` dates.

    Units are summed by date in Spark, so a group reaches Python as one row for each date.
    """
    dates = units.groupBy(*group, "date").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    schema = ", ".join(f"{n} {t}" for n, t in dates.dtypes if n in group) + ", dates long, mean double, low double, high double"

    def resample(key, frame):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("date")
        s, n = frame["s"].to_numpy(float), frame["n"].to_numpy(float)
        low = high = None
        if len(s) >= least:
            rng = np.random.default_rng(seed)
            means = []
            for at in range(0, draws, 256):
                pick = rng.integers(0, len(s), (min(256, draws - at), len(s)))
                means.append(s[pick].sum(axis=1) / n[pick].sum(axis=1))
            low, high = np.quantile(np.concatenate(means), [0.025, 0.975])
        return pd.DataFrame([[*key, len(s), s.sum() / n.sum(), low, high]], columns=[*group, "dates", "mean", "low", "high"])

    return dates.groupBy(*group).applyInPandas(resample, schema)


def moving_block_interval(rows: DataFrame, group: list[str], draws: int = 2000, seed: int = 1729, block: int = 26) -> DataFrame:
    """Reward for a day with a 95 % interval from moving blocks of ``block`` calendar sessions.

    Rows are summed by session in Spark; ``ordinal`` is the session's.
    """
    days = rows.groupBy(*group, "ordinal").agg(F.sum("ret").alias("s"), F.sum("days").alias("d"))
    schema = ", ".join(f"{n} {t}" for n, t in days.dtypes if n in group) + ", sessions long, reward double, low double, high double"

    def resample(key, frame):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        first, last = int(frame["ordinal"].min()), int(frame["ordinal"].max())
        s, d = np.zeros(last - first + 1), np.zeros(last - first + 1)
        s[frame["ordinal"] - first], d[frame["ordinal"] - first] = frame["s"], frame["d"]
        n, low, high = len(s), None, None
        if n >= 8 * block:
            cs, cd = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(d)])
            starts = np.random.default_rng(seed).integers(0, n - block + 1, (draws, -(-n // block)))
            low, high = np.quantile((cs[starts + block] - cs[starts]).sum(axis=1) / (cd[starts + block] - cd[starts]).sum(axis=1), [0.025, 0.975])
        return pd.DataFrame([[*key, n, s.sum() / d.sum(), low, high]], columns=[*group, "sessions", "reward", "low", "high"])

    return days.groupBy(*group).applyInPandas(resample, schema)
