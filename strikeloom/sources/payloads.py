"""Readers of provider payloads: chains, bars, listings, curves, day files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.functions.money import parse_price

CHAIN_ROW = "struct<expirygroup:string,expiryDate:string,strike:string,c_Bid:string,c_Ask:string,c_Openinterest:string,p_Bid:string,p_Ask:string,p_Openinterest:string,drillDownURL:string>"
CHAIN = f"struct<data:struct<totalRecord:int,lastTrade:string,table:struct<rows:array<{CHAIN_ROW}>>>,status:struct<rCode:int>>"
LISTING = "struct<data:struct<rows:array<struct<symbol:string,name:string,sector:string,industry:string>>>,status:struct<rCode:int>>"
BARS = "struct<data:struct<tradesTable:struct<rows:array<struct<date:string,close:string,volume:string,open:string,high:string,low:string>>>>,status:struct<rCode:int>>"
DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def any_date(text: Column) -> Column:
    """The date in one of the four formats that providers use."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATES])


def count_of(text: Column) -> Column:
    """A whole number not below zero, commas allowed, else null."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.when(plain.rlike(r"^\d{1,18}$"), plain).cast("long")


def chain(payloads: DataFrame) -> DataFrame:
    """Rows of chain payloads (ticker, body): the expiry header goes on to the rows below it in the same payload."""
    p = payloads.withColumns({"p": F.from_json("body", CHAIN), "payload": F.monotonically_increasing_id()}).filter("p.status.rCode = 200")
    rows = p.select("ticker", "payload", F.col("p.data.lastTrade").alias("last_trade"), F.posexplode("p.data.table.rows").alias("pos", "r"))
    down = W.partitionBy("payload").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    header = F.last(F.when(F.trim("r.expirygroup") != "", F.col("r.expirygroup")), ignorenulls=True).over(down)
    listed = F.when(F.col("r.drillDownURL").rlike(r"--\d{6}[CP]"), F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract("r.drillDownURL", r"--(\d{6})[CP]", 1)), F.lit("yyyyMMdd")).cast("date"))
    out = rows.select(
        "ticker", "pos", F.coalesce(listed, any_date(header)).alias("expiry"), parse_price(F.col("r.strike")).alias("strike"),
        *[parse_price(F.col(f"r.{c}")).alias(n) for c, n in (("c_Bid", "call_bid"), ("c_Ask", "call_ask"), ("p_Bid", "put_bid"), ("p_Ask", "put_ask"))],
        count_of(F.col("r.c_Openinterest")).alias("call_oi"), count_of(F.col("r.p_Openinterest")).alias("put_oi"), last_trade_price(F.col("last_trade")).alias("last_price"),
    )
    return out.filter("strike > 0 and expiry is not null")


def unavailable(payloads: DataFrame) -> DataFrame:
    """Chain payloads that say in so many words that there are no options: a good status, no rows, a message."""
    shape = "struct<data:struct<table:struct<rows:array<string>>>,message:string,status:struct<rCode:int,bCodeMessage:string>>"
    p = payloads.withColumn("p", F.from_json("body", shape))
    return p.filter(F.col("p.data.table.rows").isNull() & F.coalesce("p.message", "p.status.bCodeMessage").isNotNull()).select("ticker")


def daily_frame(bars: DataFrame) -> DataFrame:
    """Price bars (ticker, ts, open, high, low, close, volume, split) as a cache keeps them: finite, ordered, one for each day, the last read of a day.

    ``seq`` orders reads. Days whose prices aren't positive and ordered, or whose
    volume is negative, are left out; an unknown split is none.
    """
    last = bars.groupBy("ticker", "ts").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "split"), "seq").alias("b")).select("ticker", "ts", "b.*")
    low, high = F.least("open", "close"), F.greatest("open", "close")
    finite = F.greatest(*[F.abs(c) for c in ("open", "high", "low", "close")]) < float("inf")
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    good = whole & finite & (F.col("low") > 0) & (F.col("low") <= low) & (F.col("high") >= high) & (F.col("volume") >= 0)
    return last.filter(F.coalesce(good, F.lit(False))).withColumn("split", F.coalesce("split", F.lit(0.0)))


def first_positive_close(bars: DataFrame) -> DataFrame:
    """For each ticker and day the first bar (by ``seq``) with a positive close."""
    return bars.filter("close > 0").groupBy("ticker", "ts").agg(F.min_by("close", "seq").alias("close"))


def exhibit(index: Column) -> Column:
    """The one exhibit 99.1 in the listing of a filing (JSON: directory.item[].name, type), null if there's none or more."""
    items = F.from_json(index, "struct<directory:struct<item:array<struct<name:string,type:string>>>>")["directory"]["item"]
    named = F.filter(items, lambda x: F.upper(F.coalesce(x["type"], F.lit(""))).rlike(r"^EX-99\.1$") | F.lower(x["name"]).rlike(r"ex[-_]?99[-_.]?1.*\.html?$"))
    return F.when(F.size(named) == 1, named[0]["name"])


def last_trade_price(text: Column) -> Column:
    """The price in a sentence like ``LAST TRADE: $41.13 (AS OF ...)``."""
    return parse_price(F.nullif(F.regexp_extract(text, r"\$([0-9,]+(\.[0-9]+)?)", 1), F.lit("")))


def listings(payloads: DataFrame) -> DataFrame:
    """First listing of each symbol that has a name."""
    p = payloads.withColumn("p", F.from_json("body", LISTING)).filter("p.status.rCode = 200")
    rows = p.select(F.posexplode("p.data.rows").alias("pos", "r")).select("pos", F.upper(F.trim("r.symbol")).alias("symbol"), F.trim("r.name").alias("name"), "r.sector", "r.industry")
    good = rows.filter(F.col("symbol").rlike("^[A-Z]{1,5}$") & (F.col("name") != ""))
    return good.groupBy("symbol").agg(F.min_by(F.struct("name", "sector", "industry"), "pos").alias("x")).select("symbol", "x.*")


def daily_bars(payloads: DataFrame) -> DataFrame:
    """Bars of history payloads (ticker, body), in order."""
    p = payloads.withColumn("p", F.from_json("body", BARS)).filter("p.status.rCode = 200")
    rows = p.select("ticker", F.explode("p.data.tradesTable.rows").alias("r"))
    return rows.select("ticker", any_date(F.col("r.date")).alias("ts"), *[parse_price(F.col(f"r.{c}")).alias(c) for c in ("open", "high", "low", "close")], count_of(F.col("r.volume")).alias("volume"))


def day_files(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Bars of gzip CSV day files, only of the wanted tickers; nanoseconds become New York dates."""
    schema = "ticker string, volume double, open double, close double, high double, low double, window_start long, transactions long"
    rows = spark.read.schema(schema).option("header", True).csv(path).join(wanted.select("ticker").distinct(), "ticker", "left_semi")
    at = F.timestamp_micros((F.col("window_start") / 1000).cast("long"))
    return rows.withColumn("session", F.to_date(F.from_utc_timestamp(at, "America/New_York")))


def curve(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Points of the latest yield curve of XML files that is known by ``as_of``: years and continuous rate.

    Tenors are the element names BC_1MONTH to BC_30YEAR; a half-yearly yield y becomes 2 ln(1 + y / 2).
    """
    raw = spark.read.format("xml").option("rowTag", "properties").schema("NEW_DATE string, " + ", ".join(f"{t} double" for t, _ in TENORS)).load(path)
    day = raw.withColumn("day", F.to_date(F.substring("NEW_DATE", 1, 10))).filter(F.col("day") <= F.lit(as_of).cast("date"))
    points = F.array(*[F.struct(F.lit(y).alias("years"), (F.log1p(F.col(t) / 200) * 2).alias("rate")) for t, y in TENORS])
    last = day.withColumn("points", F.filter(points, lambda x: x["rate"].isNotNull())).filter(F.size("points") >= 3)
    return last.agg(F.max_by("points", "day").alias("points"), F.max("day").alias("day")).select("day", F.explode("points").alias("x")).select("day", "x.*")


#: Tenors of the curve files (fixed values of the format) in years.
TENORS = [("BC_1MONTH", 1 / 12), ("BC_2MONTH", 2 / 12), ("BC_3MONTH", 0.25), ("BC_4MONTH", 4 / 12), ("BC_6MONTH", 0.5), ("BC_1YEAR", 1.0), ("BC_2YEAR", 2.0), ("BC_3YEAR", 3.0), ("BC_5YEAR", 5.0), ("BC_7YEAR", 7.0), ("BC_10YEAR", 10.0), ("BC_20YEAR", 20.0), ("BC_30YEAR", 30.0)]
