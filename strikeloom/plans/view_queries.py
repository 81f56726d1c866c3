"""Queries over what is shown of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.operators import views as V
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A

CLOCK = V.Clock("1996-02-15 16:00:00", True, "1996-02-15", "1996-02-14", "1996-02-14 21:00:00")
#: Tables made of others, as expressions that both engines read.
SNAPS = "SELECT concat('T', cast(s_suppkey as string)) AS ticker, case when s_suppkey % 13 = 0 then 'Chain unavailable' end AS error, case when s_suppkey % 7 = 0 then timestamp'1996-02-15 15:30:00' else timestamp'1996-02-15 15:50:00' end AS fetched_at, case when s_suppkey % 26 = 0 then timestamp'1996-02-15 15:58:00' end AS refreshed_at, case when s_suppkey % 11 = 0 then date'1996-02-14' else date'1996-02-15' end AS session_date, case when s_suppkey % 17 > 0 then timestamp'1996-02-15 15:49:00' end AS valuation_time, case when s_suppkey % 19 > 0 then 100.0 + s_suppkey % 50 end AS spot, 'feed' AS source, date'1996-02-10' AS rate_session, case when s_suppkey % 3 = 0 then timestamp'1996-02-15 15:40:00' when s_suppkey % 5 > 0 then timestamp'1996-02-15 15:48:30' end AS quote_time, timestamp'1996-02-15 15:49:00' AS quote_fetched_at FROM supplier"
ASKED = "SELECT o_orderkey AS id, concat('T', cast(o_custkey % 120 + 1 as string)) AS ticker, case when o_orderkey % 37 = 0 then 'X' when o_orderkey % 2 = 0 then concat('T', cast(o_custkey % 120 + 1 as string)) end AS root, case when o_orderkey % 2 = 0 then 'call' else 'put' end AS side, date'1996-02-14' + cast(o_orderkey % 20 as int) AS expiry, o_orderkey % 30 AS strike, case when o_orderkey % 9 > 0 then timestamp'1996-02-15 15:50:00' else timestamp'1996-02-15 15:30:00' end AS fetched_at, 'feed' AS source FROM orders"
ODDS = "SELECT concat('T', cast(l_suppkey % 120 + 1 as string)) AS ticker, date'1996-02-14' + cast(l_partkey % 20 as int) AS expiry, l_orderkey % 30 AS strike, case when count(*) > 1 then cast(min(l_partkey) % 1024 as double) / 1024 end AS p, cast(min(l_partkey) % 512 as double) / 1024 AS lower, cast(min(l_partkey) % 1024 + 64 as double) / 1024 AS upper, case when min(l_linenumber) > 2 then 'quote_fit_failed' when min(l_linenumber) = 2 then 'one_tick_unstable' end AS reason FROM lineitem GROUP BY 1, 2, 3"
EXPIRIES = "SELECT DISTINCT concat('T', cast(c_custkey % 120 + 1 as string)) AS ticker, date'1996-02-14' + cast(c_nationkey % 20 as int) AS expiry, 'Dividend exposure' AS reason FROM customer WHERE c_acctbal < 0"
CURVES = "SELECT concat('T', cast(s_suppkey as string)) AS ticker, case when s_suppkey % 4 > 0 then timestamp'1996-02-15 15:50:00' else timestamp'1996-02-15 15:30:00' end AS fitted_at, case when s_suppkey % 6 = 0 then 'curve_fit_failed' end AS failure FROM supplier"


def _made(spark: SparkSession, d: str, text: str) -> DataFrame:
    """A made table; literals of two engines mean the same here, times without zone and decimals as doubles."""
    name = text.split(" FROM ")[1].split()[0]
    rows = spark.sql(text.replace(f" FROM {name}", " FROM {rows}", 1).replace("timestamp'", "timestamp_ntz'"), rows=A.table(spark, d, name))
    return rows.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else c for c, t in rows.dtypes])


def _duck(text: str) -> str:
    return text.replace("100.0 +", "100.0::DOUBLE +")


WITH = f"WITH snaps AS ({_duck(SNAPS)}), asked AS ({ASKED}), odds AS ({_duck(ODDS)}), expiries AS ({EXPIRIES}), curves AS ({CURVES}), good AS (SELECT * FROM snaps WHERE CASE WHEN error IS NOT NULL THEN TIMESTAMP '{CLOCK.now}' < coalesce(refreshed_at, fetched_at) + INTERVAL '15 minutes' ELSE session_date = DATE '{CLOCK.session}' AND TIMESTAMP '{CLOCK.now}' < fetched_at + INTERVAL '15 minutes' END)"
TENTHS = "CASE WHEN o.p BETWEEN 0 AND 1 THEN floor(o.p * 1000 + 0.5::DOUBLE)::BIGINT END"
SIDED = f"CASE WHEN a.side = 'put' THEN 1000 - ({TENTHS}) ELSE {TENTHS} END"
JOINED = "FROM asked a LEFT JOIN good s USING (ticker) LEFT JOIN expiries e USING (ticker, expiry) LEFT JOIN odds o USING (ticker, expiry, strike)"


@query(f"""{WITH}, x AS (SELECT a.id, CASE WHEN a.root <> a.ticker THEN '{V.TERMS}' WHEN s.fetched_at IS NULL THEN '{V.PENDING}' WHEN s.error IS NOT NULL THEN s.error WHEN e.reason IS NOT NULL THEN e.reason WHEN o.strike IS NULL THEN '{V.ABSENT}' WHEN o.p IS NULL THEN coalesce(o.reason, 'Odds unavailable') END AS reason, {SIDED} AS itm,
  CASE WHEN o.lower <= o.upper AND o.upper <= 1 AND o.lower >= 0 THEN floor((1 - (o.upper - o.lower)) * 100 + 0.5::DOUBLE)::BIGINT END AS support, CASE WHEN o.lower <= o.upper AND o.upper <= 1 THEN floor((CASE WHEN a.side = 'put' THEN 1 - o.upper ELSE o.lower END) * 1000 + 0.5::DOUBLE)::BIGINT END AS low {JOINED})
SELECT id, CASE reason WHEN '{V.PENDING}' THEN 'pending' ELSE CASE WHEN reason IS NULL THEN 'available' ELSE 'unavailable' END END AS status, reason, CASE WHEN reason IS NULL THEN itm END AS itm, CASE WHEN reason IS NULL THEN low END AS low, CASE WHEN reason IS NULL THEN support END AS support FROM x""")
def snapshot_odds_views(spark: SparkSession, d: str) -> DataFrame:
    """The odds shown of every order's contract, or why there are none."""
    rows = V.odds_views(*[_made(spark, d, x) for x in (ASKED, SNAPS, EXPIRIES, ODDS)], CLOCK)
    return rows.select("id", "status", "reason", "itm", "low", "support")


@query(f"""{WITH}, known AS (SELECT DISTINCT ticker, expiry, strike FROM odds WHERE strike % 5 > 0),
x AS (SELECT a.id, CASE WHEN a.root <> a.ticker THEN '{V.TERMS}' WHEN s.fetched_at IS NULL THEN '{V.PENDING_CURVE}' WHEN s.error IS NOT NULL OR e.reason IS NOT NULL THEN coalesce(s.error, e.reason) WHEN k.strike IS NULL THEN '{V.TERMS}' WHEN c.fitted_at IS DISTINCT FROM s.fetched_at THEN '{V.FITTING}' WHEN o.p IS NULL THEN coalesce(o.reason, c.failure, 'curve_strike_not_supported') END AS reason, {SIDED} AS itm
  {JOINED} LEFT JOIN known k USING (ticker, expiry, strike) LEFT JOIN curves c USING (ticker))
SELECT id, CASE WHEN reason IN ('{V.PENDING_CURVE}', '{V.FITTING}') THEN 'pending' WHEN reason IS NULL THEN 'available' ELSE 'unavailable' END AS status, reason, CASE WHEN reason IS NULL THEN itm END AS itm, CASE WHEN reason IS NULL THEN true WHEN reason = 'one_tick_unstable' THEN false END AS one_tick_stable FROM x""")
def snapshot_curve_views(spark: SparkSession, d: str) -> DataFrame:
    """The curve odds shown of every order's contract, or why there are none."""
    asked, snaps, expiries, odds, curves = (_made(spark, d, x) for x in (ASKED, SNAPS, EXPIRIES, ODDS, CURVES))
    rows = V.curve_views(asked, snaps, expiries, odds.filter("strike % 5 > 0").select("ticker", "expiry", "strike"), curves, odds, CLOCK)
    return rows.select("id", "status", "reason", "itm", "one_tick_stable")


@query(f"""{WITH}, rates AS (SELECT DISTINCT ticker, expiry, (day(expiry) % 30) / 100.0::DOUBLE AS rate FROM asked WHERE day(expiry) % 6 > 0),
x AS (SELECT a.id, s.spot, o.lower AS bid, o.upper AS ask, r.rate, (a.root IS NULL OR a.root = a.ticker) AND s.fetched_at IS NOT NULL AND s.error IS NULL AND s.spot IS NOT NULL AND s.valuation_time IS NOT NULL AND o.strike IS NOT NULL AS there,
  s.fetched_at = a.fetched_at AND e.reason IS NULL AND a.strike % 10 <> 3 AND NOT (a.strike % 10 = 4 AND a.side = 'put') AND r.rate BETWEEN 0 AND 0.25 AND date_diff('day', s.rate_session, s.valuation_time::DATE) BETWEEN 0 AND 7 AND a.expiry > s.valuation_time::DATE AS fits
  FROM asked a LEFT JOIN good s USING (ticker) LEFT JOIN expiries e USING (ticker, expiry) LEFT JOIN odds o ON o.ticker = a.ticker AND o.expiry = a.expiry AND o.strike = a.strike LEFT JOIN rates r ON r.ticker = a.ticker AND r.expiry = a.expiry)
SELECT id, CASE WHEN there THEN floor(spot * 100 + 0.5::DOUBLE)::BIGINT END AS spot_cents, CASE WHEN there THEN bid END AS bid, coalesce(there AND coalesce(fits, false), false) AS selected FROM x""")
def snapshot_selections(spark: SparkSession, d: str) -> DataFrame:
    """Which of the orders' contracts can be priced from the snapshot that is shown, and their entry quotes."""
    asked, snaps, expiries, odds = (_made(spark, d, x) for x in (ASKED, SNAPS, EXPIRIES, ODDS))
    quotes = odds.select("ticker", F.explode(F.array(F.lit("call"), F.lit("put"))).alias("side"), "expiry", "strike", F.col("lower").alias("bid"), F.col("upper").alias("ask"))
    rates = asked.select("ticker", "expiry").distinct().filter("day(expiry) % 6 > 0").withColumn("rate", F.dayofmonth("expiry") % 30 / 100.0)
    none = lambda t: F.lit(None).cast(t)
    each = asked.select("ticker", "expiry", "strike", "side").distinct()
    blocked = expiries.select("ticker", "expiry", none("long").alias("strike"), none("string").alias("side"))
    blocked = blocked.unionByName(each.filter("strike % 10 = 3").withColumn("side", none("string"))).unionByName(each.filter("strike % 10 = 4 and side = 'put'"))
    rows = V.selections(asked, snaps, quotes, rates, blocked, CLOCK)
    return rows.select("id", F.floor(F.col("spot") * 100 + 0.5).cast("long").alias("spot_cents"), "bid", "selected")


@query(f"{WITH} SELECT ticker, floor(spot * 100 + 0.5::DOUBLE)::BIGINT AS spot_cents FROM good WHERE error IS NULL AND spot IS NOT NULL AND quote_time::DATE = session_date AND date_diff('second', quote_time, TIMESTAMP '{CLOCK.now}') BETWEEN -60 AND 900")
def live_underlyings(spark: SparkSession, d: str) -> DataFrame:
    """Stock quotes that are live."""
    return V.underlying_quotes(_made(spark, d, SNAPS), CLOCK).select("ticker", F.floor(F.col("spot") * 100 + 0.5).cast("long").alias("spot_cents"))


STATES = "SELECT o_orderkey AS ticker, cast(o_orderdate as date) AS expiry, case o_orderkey % 4 when 1 then 'Same-day option quote timing cannot be verified' when 2 then 'Dated Treasury rate is unavailable' when 3 then 'Dividend status could not be verified' end AS reason, case o_custkey % 3 when 0 then 'done' when 1 then 'failed' else 'pending' end AS curve_state, case o_custkey % 5 when 0 then 'failed' when 1 then 'pending' else 'done' end AS dividend_state, o_custkey % 7 = 0 AS dividends_failed, case o_custkey % 11 when 0 then '' when 1 then 'Dividend before expiry' end AS dividend_reason FROM orders"


@query(f"""WITH s AS ({STATES}), f AS (SELECT *, reason IS NULL OR curve_state = 'done' AND dividend_state = 'done' OR reason = '{V.SAME_DAY}' OR reason = '{V.NO_RATE}' AND curve_state = 'done' AS final, dividend_state = 'done' AND NOT dividends_failed AND dividend_reason IS NOT NULL AS known FROM s)
SELECT ticker, expiry::VARCHAR AS expiry, CASE WHEN NOT final AND known THEN coalesce(nullif(dividend_reason, ''), '{V.DIVIDENDS}') ELSE reason END AS reason, CASE WHEN final OR known THEN NULL WHEN 'failed' IN (curve_state, dividend_state) THEN 'acquisition' WHEN 'pending' IN (curve_state, dividend_state) THEN 'pending' END AS state FROM f""")
def page_input_states(spark: SparkSession, d: str) -> DataFrame:
    """What stands of every expiry's reason while its inputs are fetched."""
    return V.input_states(_made(spark, d, STATES)).withColumn("expiry", F.col("expiry").cast("string"))
