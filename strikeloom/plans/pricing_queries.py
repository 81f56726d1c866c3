"""Queries over pricing rules, labels, capture targets and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.operators import pricing as P
from strikeloom.plans.chain_queries import CONTRACT, IDS
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A


@query(sql("quotes", f"SELECT {IDS}, CASE WHEN bid <= 0 THEN 'missing' WHEN ask < bid THEN 'crossed' WHEN (ask - bid) / ((ask + bid) / 2) > 0.02::DOUBLE THEN 'wide' WHEN abs(l_orderkey % 300 - 100) > 120 THEN 'skewed' WHEN NOT side = 'call' THEN 'delayed' WHEN l_partkey % 400 - 60 < -60 OR l_partkey % 400 - 60 > 300 THEN 'stale' END AS reason FROM quotes"))
def spot_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = P.spot_reason(F.col("bid"), F.col("ask"), F.col("l_orderkey") % 300 - 100, F.col("side") == "call", F.col("l_partkey") % 400 - 60)
    return A.quotes(spark, d).select(*CONTRACT, r.alias("reason"))


LABELLED = "l AS (SELECT *, l_suppkey % 7 > 0 AS standard, l_orderkey % 11 = 0 AS split, CASE WHEN l_partkey % 13 > 0 THEN spot END AS close_a, CASE WHEN l_partkey % 17 > 0 THEN spot + CASE WHEN l_linenumber = 5 THEN 0.01::DOUBLE ELSE 0 END END AS close_b FROM quotes), r AS (SELECT *, CASE WHEN NOT standard THEN 'nonstandard_terms' WHEN expiry > DATE '1999-01-01' THEN 'not_expired' WHEN split THEN 'split' WHEN close_a IS NULL THEN 'no_first_source' WHEN close_b IS NULL THEN 'no_second_source' WHEN abs(close_a - close_b) > 0.005::DOUBLE THEN 'sources_disagree' END AS reason FROM l)"


@query(sql("quotes", f"WITH {LABELLED} SELECT {IDS}, reason, CASE WHEN reason IS NULL THEN CASE WHEN CASE WHEN side = 'call' THEN close_a - strike ELSE strike - close_a END > 0 THEN 'itm' WHEN close_a = strike THEN 'atm' ELSE 'otm' END END AS outcome FROM r"))
def label_reasons(spark: SparkSession, d: str) -> DataFrame:
    q = A.quotes(spark, d).withColumns({"standard": F.col("l_suppkey") % 7 > 0, "split": F.col("l_orderkey") % 11 == 0, "as_of": F.lit("1999-01-01").cast("date"), "close_a": F.when(F.col("l_partkey") % 13 > 0, F.col("spot")), "close_b": F.when(F.col("l_partkey") % 17 > 0, F.col("spot") + F.when(F.col("l_linenumber") == 5, 0.01).otherwise(0.0))})
    return P.label_reason(q).select(*CONTRACT, "reason", "outcome")


@query(sql("ticks sessions", """WITH w AS (SELECT contract, min(ts) AS created_at, max(ts)::DATE AS expiry FROM ticks GROUP BY 1), g AS (SELECT session, open_at, close_at, session::TIMESTAMP + m * INTERVAL '1 minute' AS target FROM sessions, (VALUES (600), (780), (930)) v(m)),
  t AS (SELECT w.contract, g.target FROM w JOIN g ON created_at <= target AND session <= expiry WHERE target >= open_at AND target < close_at AND target <= TIMESTAMP '2024-01-20' AND session >= DATE '2024-01-20' - 35)
  SELECT t.contract, strftime(t.target, '%Y-%m-%d %H:%M') AS target, CASE WHEN EXISTS (SELECT 1 FROM ticks k WHERE k.contract = t.contract AND k.ts >= t.target AND k.ts < t.target + INTERVAL '5 minutes') THEN 'captured' ELSE 'missed' END AS state FROM t"""))
def capture_targets(spark: SparkSession, d: str) -> DataFrame:
    ticks = A.ticks(spark, d)
    watches = ticks.groupBy("contract").agg(F.min("ts").alias("created_at"), F.to_date(F.max("ts")).alias("expiry"))
    targets = P.capture_targets(watches, A.sessions(spark, d), "2024-01-20 00:00:00").select("contract", "target")
    return P.captured(targets, ticks.select("contract", F.col("ts").alias("issued_at"))).select("contract", F.date_format("target", "yyyy-MM-dd HH:mm").alias("target"), "state")


SIDES = "s AS (SELECT ticker, expiry, strike, side, max(floor(bid * 100 + 0.5::DOUBLE)::BIGINT) AS bid, sum(oi)::BIGINT AS oi FROM quotes GROUP BY 1, 2, 3, 4)"


@query(sql("quotes", f"WITH {SIDES} SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.expiry, b.expiry)::VARCHAR AS expiry, coalesce(a.strike, b.strike) AS strike, a.bid AS call_bid, a.oi AS call_oi, b.bid AS put_bid, b.oi AS put_oi FROM (SELECT * FROM s WHERE side = 'call') a FULL JOIN (SELECT * FROM s WHERE side = 'put') b ON a.ticker = b.ticker AND a.expiry = b.expiry AND a.strike = b.strike"))
def merged_sides(spark: SparkSession, d: str) -> DataFrame:
    s = A.quotes(spark, d).groupBy("ticker", F.col("expiry").cast("string").alias("expiry"), "strike", "side").agg(F.max(F.floor(F.col("bid") * 100 + 0.5).cast("long")).alias("bid"), F.sum("oi").cast("long").alias("oi"))
    return P.merged_sides(s.filter("side = 'call'").drop("side"), s.filter("side = 'put'").drop("side"), ["ticker", "expiry", "strike"])


@query(sql("stocks", "SELECT ticker, ts::VARCHAR AS ts, close, volume FROM stocks WHERE ts < DATE '2001-01-01' OR ticker <> '1-URGENT'"))
def price_cache_update(spark: SparkSession, d: str) -> DataFrame:
    s = A.stocks(spark, d).select("ticker", "ts", "close", "volume")
    kept = s.filter("ts < date '2001-01-01' or ticker <> '1-URGENT'")
    return P.refreshed_tail(kept.filter("ts < date '2000-06-01'"), kept, "ts").withColumn("ts", F.col("ts").cast("string"))
