"""Price series by window frames: returns, volatilities, features, forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECAY, FRAME = 0.94, 60


def by_ticker(*keys: str) -> W:
    return W.partitionBy("ticker", *keys).orderBy("ts")


def log_returns(stocks: DataFrame) -> DataFrame:
    """``ret``: log of the close over the one before; null for the first."""
    return stocks.withColumn("ret", F.log(F.try_divide(F.col("close"), F.lag("close").over(by_ticker()))))


def ewma(returns: Column, frame: int = FRAME, decay: float = DECAY) -> Column:
    """Root of the weighted mean square of an array of returns, the newest last; null unless all are there."""
    n = F.size(returns)
    total = F.aggregate(F.transform(returns, lambda x, i: x * x * F.pow(F.lit(decay), (n - 1 - i).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    weights = (1 - decay**frame) / (1 - decay)
    variance = total / weights
    return F.when((n == frame) & (variance > 1e-16), F.sqrt(variance))


def ewma_volatility(stocks: DataFrame, frame: int = FRAME) -> DataFrame:
    """``vol``: exponentially weighted over the last ``frame`` returns; null where one is missing."""
    rows = log_returns(stocks)
    last = F.collect_list("ret").over(by_ticker().rowsBetween(-(frame - 1), 0))
    return rows.withColumn("frame_", last).withColumn("vol", ewma(F.col("frame_"), frame)).drop("frame_")


def features(stocks: DataFrame, calendar: DataFrame) -> DataFrame:
    """5- and 20-session returns and the 20-return deviation, over sessions without gaps only."""
    rows = stocks.join(F.broadcast(calendar.withColumnRenamed("session", "ts")), "ts")
    rows = rows.withColumn("island", F.col("ordinal") - F.row_number().over(by_ticker()))
    w = by_ticker("island")
    rows = rows.withColumns({"ret": F.log(F.try_divide(F.col("close"), F.lag("close").over(w))), "ret5": F.try_divide(F.col("close"), F.lag("close", 5).over(w)) - 1, "ret20": F.try_divide(F.col("close"), F.lag("close", 20).over(w)) - 1})
    inside = w.rowsBetween(-19, 0)
    dev = F.when(F.count("ret").over(inside) == 20, F.stddev_samp("ret").over(inside) * (252**0.5))
    return rows.withColumn("vol20", dev)


def har(stocks: DataFrame) -> DataFrame:
    """Squared return and its regressors: the last, the mean of the last 5 and of the last 22 before it."""
    w = by_ticker()
    rows = log_returns(stocks).withColumn("v", F.col("ret") * F.col("ret"))
    full = lambda n: F.when(F.count("v").over(w.rowsBetween(-n, -1)) == n, F.avg("v").over(w.rowsBetween(-n, -1)))
    return rows.withColumns({"v1": F.lag("v").over(w), "v5": full(5), "v22": full(22)})


def variance_shares(stocks: DataFrame, frame: int = FRAME) -> DataFrame:
    """Overnight part of the variance over the last ``frame`` sessions."""
    w = by_ticker()
    rows = stocks.withColumns({"night": F.log(F.try_divide(F.col("open"), F.lag("close").over(w))), "day": F.log(F.try_divide("close", "open"))})
    last = w.rowsBetween(-(frame - 1), 0)
    n, d = F.avg(F.col("night") * F.col("night")).over(last), F.avg(F.when(F.col("night").isNotNull(), F.col("day") * F.col("day"))).over(last)
    return rows.withColumn("share", F.when(F.count("night").over(last) == frame, F.try_divide(n, n + d)))


def trailing(stocks: DataFrame) -> DataFrame:
    """Trailing means and deviations of returns, range and volume ratio over 5 and 22 sessions."""
    w = by_ticker()
    rows = log_returns(stocks).withColumn("range", F.log(F.try_divide("high", "low")))
    out = {}
    for n in (5, 22):
        f = w.rowsBetween(-(n - 1), 0)
        full = F.count("ret").over(f) == n
        out |= {f"mean{n}": F.when(full, F.avg("ret").over(f)), f"dev{n}": F.when(full, F.stddev_pop("ret").over(f)), f"range{n}": F.when(full, F.avg(F.col("range") * F.col("range")).over(f) / (4 * 0.6931471805599453))}
    full = F.count("*").over(w.rowsBetween(-21, 0)) == 22
    out["volume_ratio"] = F.when(full, F.try_divide(F.avg("volume").over(w.rowsBetween(-4, 0)), F.avg("volume").over(w.rowsBetween(-21, 0))))
    return rows.withColumns(out)


def forward_returns(stocks: DataFrame, calendar: DataFrame, horizons: list[int], frame: int = 20) -> DataFrame:
    """Forward log return of each horizon in sessions over trailing volatility and its root; gaps in the calendar stay gaps.

    The grid is every ticker's span of sessions, so ``lead`` counts sessions and not rows.
    """
    span = stocks.join(F.broadcast(calendar), stocks["ts"] == calendar["session"]).groupBy("ticker").agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"))
    grid = span.select("ticker", F.explode(F.sequence("a", "b")).alias("ordinal")).join(F.broadcast(calendar), "ordinal").select("ticker", F.col("session").alias("ts"))
    rows = grid.join(stocks.select("ticker", "ts", "close"), ["ticker", "ts"], "left")
    w = by_ticker()
    rows = rows.withColumn("ret", F.log(F.try_divide(F.col("close"), F.lag("close").over(w))))
    last = w.rowsBetween(-(frame - 1), 0)
    rows = rows.withColumn("vol", F.when(F.count("ret").over(last) >= 5, F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(last))))
    rows = rows.withColumns({f"close{h}": F.lead("close", h).over(w) for h in horizons})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"close{h}").alias("later")) for h in horizons]))
    rows = rows.select("ticker", "ts", "close", "vol", each.alias("x")).select("ticker", "ts", "close", "vol", "x.*")
    return rows.filter("close is not null and later is not null and vol > 0").withColumn("z", F.log(F.try_divide("later", "close")) / (F.col("vol") * F.sqrt(F.col("horizon").cast("double"))))


def corporate_actions(stocks: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """For each session the actions in the ``horizon`` sessions from it on, as a difference of running counts, not a range join."""
    w = by_ticker()
    flagged = stocks.join(events.withColumn("hit", F.lit(1)), ["ticker", "ts"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return flagged.withColumns({"actions": F.sum("hit").over(w.rowsBetween(0, horizon)), "complete": F.count("*").over(w.rowsBetween(1, horizon)) == horizon})


def every_kth(calendar: DataFrame, k: int, last: int) -> DataFrame:
    """Every k-th session from the first, the last ``last`` of them."""
    return calendar.filter((F.col("ordinal") - 1) % k == 0).orderBy(F.desc("session")).limit(last)
