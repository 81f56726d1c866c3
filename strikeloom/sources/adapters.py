"""Domain tables read from the generic test tables: prices, quotes, bars, forecasts and labels.

Each view has the same meaning as the SQL of its name in ``strikeloom.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TODAY = "1996-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: ticker, ts, open, high, low, close, volume."""
    o = table(spark, sf_dir, "orders")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("ts")).agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").alias("volume"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their ordinals: a dimension of a few thousand days."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session")).distinct()
    return days.withColumn("ordinal", F.row_number().over(W.orderBy("session")))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option rows: ids, ticker, side, strike, spot, bid, ask, oi, expiry, dte."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    bid = F.col("p_retailprice") * F.col("l_discount") / 5
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("p_brand").alias("ticker"), F.when(F.col("l_returnflag") == "A", "call").otherwise("put").alias("side"),
        F.col("p_retailprice").alias("strike"), (F.col("p_retailprice") * (F.col("l_tax") * 5 + 0.8 + F.col("l_linenumber") * 0.003)).alias("spot"),
        bid.alias("bid"), (bid * (F.col("l_tax") + 1)).alias("ask"), F.col("l_quantity").alias("oi"),
        F.to_date("l_shipdate").alias("expiry"), F.datediff(F.to_date("l_shipdate"), F.lit(TODAY).cast("date")).alias("dte"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows of contracts: contract, ticker, reason (null: standard terms)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("contract"), F.col("c_mktsegment").alias("ticker"), F.when(F.col("c_acctbal") < 0, "nonstandard_terms").alias("reason"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bar rows: row_id, contract, kind, ts, cents."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("contract"), F.col("event_type").alias("kind"), "ts", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))


def bars(ticks: DataFrame, unit: str) -> DataFrame:
    """Bars of a ``unit`` (hour, day): contract, start, open, high, low, close, volume, transactions, first_row."""
    return ticks.groupBy("contract", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("start")).agg(F.min_by("cents", "row_id").alias("open"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.max_by("cents", "row_id").alias("close"), F.sum("cents").alias("volume"), F.count("*").alias("transactions"), F.min("row_id").alias("first_row"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays on which there are ticks, with regular hours 9:30 to 16:00."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("session")).distinct().filter(F.weekday("session") < 5)
    at = F.col("session").cast("timestamp_ntz")
    return days.select("session", (at + F.expr("INTERVAL '9:30' HOUR TO MINUTE")).alias("open_at"), (at + F.expr("INTERVAL '16' HOUR")).alias("close_at"))


def issuances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts: contract, ticker, issued_at, model, probability."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("contract"), F.col("o_orderpriority").alias("ticker"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("issued_at"), F.when(F.col("o_orderstatus") == "F", "baseline").otherwise("challenger").alias("model"), (F.col("o_orderkey") % 1000 / 1000.0).alias("probability"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("cents"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label revisions: contract, checked_at, status, key."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")])
    return li.select(F.col("l_orderkey").alias("contract"), F.col("l_shipdate").alias("checked_at"), F.when(F.col("l_linestatus") == "F", "valid").otherwise("pending").alias("status"), key.alias("key"), (F.col("l_returnflag") == "R").alias("itm"))


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario prices (sorted) of equal weight: id, prices."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.sort_array(F.transform("embedding", lambda x: F.floor(F.exp(x.cast("double")) * 1000000 + 0.5) / 10000.0)).alias("prices"))


def option_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call quotes that belong together: of each brand, a two-regime price surface with the table's own noise and spreads.

    ticker, expiry (a quarter's end), strike, spot, years, rate, bid, ask, oi, volume,
    standard. Brands ending in 5 have noise beyond their spreads.
    """
    from strikeloom.operators.regimes import model_values

    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("ticker"), end.alias("expiry"), (650 + F.round(F.pmod((F.col("p_retailprice") - 900) * 60, F.lit(600.0)) / 25) * 25).alias("strike"))
    rows = rows.agg(F.sum(F.col("l_quantity").cast("long")).alias("oi"), F.count("*").alias("volume"), F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("discount"))
    digit = lambda k: F.coalesce(F.substring("ticker", k, 1).try_cast("int"), F.lit(1))
    model = [0.1 + 0.02 * digit(-2), 0.3 + 0.04 * digit(-1), F.lit(1.0) + 0.2 * digit(-2), F.lit(2.0)]
    years = F.datediff("expiry", F.lit(TODAY).cast("date")) / 365.0
    rows = rows.filter("strike > 0").withColumns({"spot": F.lit(950.0), "rate": F.lit(0.03), "years": years, "standard": F.lit(True)})
    value = model_values(*[m.cast("double") for m in model], F.col("spot"), F.col("rate"), F.col("years"), F.col("strike"))["call"]
    half = 0.08 + F.col("tax")
    noise = (F.col("discount") - 0.05) / 0.05 * F.when(digit(-1) == 5, 40).otherwise(0.7) * half
    mid = F.greatest(value, F.lit(0.0)) + noise
    at = lambda x: F.round(F.greatest(x, F.lit(0.0)), 2)
    return rows.select("ticker", "expiry", "strike", "spot", "years", "rate", at(mid - half).alias("bid"), at(mid + half).alias("ask"), "oi", "volume", "standard")
