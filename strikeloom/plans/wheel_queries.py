"""Queries over the wheel's capture and the lattice of its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators import wheel as H
from strikeloom.plans.chain_queries import up
from strikeloom.plans.inference_queries import WHEEL, _trades
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A

DAYS = "days AS (SELECT o_orderkey AS contract, o_orderpriority AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'call' ELSE 'put' END AS side, o_orderdate::DATE + k::INT AS session, o_orderdate::DATE + (o_orderkey % 35)::INT AS expiry, o_totalprice * (0.6::DOUBLE + (o_orderkey % 9) * 0.1::DOUBLE) AS strike, CASE WHEN o_orderkey % 17 > 0 THEN o_totalprice / 50 END AS mark, o_custkey % 7 AS volume, o_orderkey % 19 > 0 AS valid, o_orderkey % 23 = 0 AS reconciliation_failed, CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / 60 END AS opening FROM orders, range(3) r(k))"
BARS = "bars AS (SELECT ticker, ts AS session, open, close, CASE WHEN day(ts) % 30 = 3 THEN 1.0::DOUBLE WHEN day(ts) % 30 <> 4 THEN 0.0 END AS action FROM stocks), acted AS (SELECT *, sum((coalesce(action, 0) <> 0)::INT) OVER w AS acts, sum((action IS NULL)::INT) OVER w AS unsure, count(*) OVER w AS bars FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session))"
CANDIDATES = f"""{DAYS}, {BARS}, c2 AS (SELECT session, ordinal AS place, lead(session) OVER (ORDER BY session) AS entry FROM cal),
found AS (SELECT d.*, c.entry, e.place - c.place AS horizon, s.close AS decision_close, n.open AS stock_entry, l.opening AS option_entry, x.close AS expiry_close,
  e.place - c.place - (x.bars - s.bars) AS gap, x.unsure - s.unsure AS unsure, x.acts - s.acts AS acts, l.valid AS entry_valid, l.reconciliation_failed AS entry_failed
  FROM days d LEFT JOIN c2 c USING (session) LEFT JOIN c2 e ON e.session = d.expiry LEFT JOIN acted s ON s.ticker = d.ticker AND s.session = d.session LEFT JOIN acted n ON n.ticker = d.ticker AND n.session = c.entry
  LEFT JOIN acted x ON x.ticker = d.ticker AND x.session = d.expiry LEFT JOIN days l ON l.contract = d.contract AND l.session = c.entry),
why AS (SELECT *, CASE WHEN decision_close IS NULL OR decision_close <= 0 THEN 'decision_missing_verified_stock' WHEN horizon IS NULL OR horizon NOT BETWEEN 1 AND 25 OR entry IS NULL THEN 'outside_horizons' WHEN NOT valid OR mark IS NULL OR mark <= 0 OR volume <= 0 THEN 'invalid_decision_observation'
    WHEN CASE side WHEN 'call' THEN decision_close <= strike ELSE decision_close >= strike END THEN 'outside_strict_moneyness' END AS ignored,
  CASE WHEN stock_entry IS NULL OR stock_entry <= 0 THEN 'missing_verified_stock_open' WHEN CASE side WHEN 'call' THEN stock_entry <= strike ELSE stock_entry >= strike END THEN 'opening_moneyness_changed' WHEN option_entry IS NULL OR option_entry <= 0 THEN 'missing_opening_bucket' END AS no_entry,
  CASE WHEN reconciliation_failed OR NOT coalesce(entry_valid, true) OR coalesce(entry_failed, false) THEN 'reconciliation_failure' WHEN expiry_close IS NULL OR expiry_close <= 0 THEN 'missing_verified_expiry_close' WHEN gap > 0 THEN 'stock_session_missing' WHEN unsure > 0 THEN 'actions_unknown' WHEN acts > 0 THEN 'corporate_action' END AS excluded FROM found)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    key, price, day = F.col("o_orderkey"), F.col("o_totalprice"), F.to_date("o_orderdate")
    days = o.select(
        key.alias("contract"), F.col("o_orderpriority").alias("ticker"), F.when(key % 2 == 0, "call").otherwise("put").alias("side"), F.date_add(day, F.col("k")).alias("session"), F.date_add(day, (key % 35).cast("int")).alias("expiry"), (price * (0.6 + key % 9 * 0.1)).alias("strike"),
        F.when(key % 17 > 0, price / 50).alias("mark"), (F.col("o_custkey") % 7).alias("volume"), (key % 19 > 0).alias("valid"), (key % 23 == 0).alias("reconciliation_failed"), F.when(F.col("o_custkey") % 5 > 0, price / 60).alias("opening"),
    )
    marked = F.when(F.dayofmonth("ts") % 30 == 3, 1.0).when(F.dayofmonth("ts") % 30 != 4, 0.0)
    stocks = A.stocks(spark, d).select("ticker", F.col("ts").alias("session"), "open", "close", marked.alias("action"))
    return H.candidates(days, stocks, A.calendar(spark, d).select("session"))


@query(sql("stocks cal", f"WITH {CANDIDATES} SELECT contract, session::VARCHAR AS session, entry::VARCHAR AS entry, horizon::INT AS horizon, CASE WHEN ignored IS NOT NULL THEN 'ignored' WHEN no_entry IS NOT NULL THEN 'no_entry' WHEN excluded IS NOT NULL THEN 'excluded' ELSE 'scored' END AS status, coalesce(ignored, no_entry, excluded) AS reason FROM why"))
def wheel_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every contract-day's status and reason, after all lookups around its decision."""
    return _candidates(spark, d).select("contract", F.col("session").cast("string").alias("session"), F.col("entry").cast("string").alias("entry"), F.col("horizon").cast("int").alias("horizon"), "status", "reason")


@query(sql("stocks cal", f"WITH {CANDIDATES}, s AS (SELECT ticker, side, CASE WHEN ignored IS NOT NULL THEN 'ignored' WHEN no_entry IS NOT NULL THEN 'no_entry' WHEN excluded IS NOT NULL THEN 'excluded' ELSE 'scored' END AS status, coalesce(ignored, no_entry, excluded) AS reason FROM why) SELECT ticker, side, status, reason, count(*) AS n FROM s GROUP BY ALL"))
def wheel_capture_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many contract-days of each ticker and side came to each status and reason."""
    return _candidates(spark, d).groupBy("ticker", "side", "status", "reason").agg(F.count("*").alias("n"))


PANEL = "CASE WHEN origin < DATE '1997-01-01' THEN 'primary' WHEN origin < DATE '1998-01-01' THEN 'supplement' END"
PERIOD = "CASE WHEN expiry < DATE '1996-06-01' THEN 'development' WHEN origin >= DATE '1996-06-01' THEN 'holdout' ELSE 'purged' END"
DEPTH = "CASE WHEN abs(strike / spot - 1) < 0.1::DOUBLE THEN 'near' WHEN abs(strike / spot - 1) < 0.2::DOUBLE THEN 'middle' ELSE 'deep' END"
REACH = "CASE WHEN days <= 5 THEN '1-5' WHEN days <= 25 THEN '6-25' ELSE 'over' END"
KEYS = ", ".join(H.CELL)
SETS = ", ".join("(" + ", ".join(keys) + ")" for keys in H.LEVELS)
LEVEL = "CASE grouping(" + KEYS + ") " + " ".join(f"WHEN {sum(1 << (len(H.CELL) - 1 - i) for i, c in enumerate(H.CELL) if c not in keys)} THEN {k}" for k, keys in enumerate(H.LEVELS)) + " END"


@query(sql("", f"""WITH {WHEEL}, t AS (SELECT *, {PANEL} AS panel, {PERIOD} AS period, {DEPTH} AS depth_band, {REACH} AS horizon_band, mark / strike AS time_yield FROM trades),
c AS (SELECT {KEYS}, origin, expiry, count(*) AS contracts, count(*) FILTER (traded) AS scored, sum(ret) FILTER (traded) / nullif(count(*) FILTER (traded), 0) AS r, sum(time_yield) / count(*) AS y FROM t GROUP BY ALL)
SELECT {LEVEL}::INT AS level, {KEYS}, count(*) AS cells, count(DISTINCT origin) AS origins, count(DISTINCT expiry) AS expiries, sum(contracts)::BIGINT AS contracts, sum(scored)::BIGINT AS scored, {up('(avg(r) + 1e-9::DOUBLE)', 100000)} AS mean_e5, {up('(avg(y) + 1e-9::DOUBLE)', 100000)} AS yield_e5, {up('(quantile_cont(r, 0.5) + 1e-9::DOUBLE)', 100000)} AS median_e5
FROM c GROUP BY GROUPING SETS ({SETS})"""))
def wheel_descriptives(spark: SparkSession, d: str) -> DataFrame:
    """Descriptives of all candidates at five levels of the lattice, in one pass over its cells."""
    rows = _trades(spark, d).select("ticker", "side", "origin", "expiry", F.expr("CASE WHEN origin < DATE'1997-01-01' THEN 'primary' WHEN origin < DATE'1998-01-01' THEN 'supplement' END").alias("panel"), F.expr("CASE WHEN expiry < DATE'1996-06-01' THEN 'development' WHEN origin >= DATE'1996-06-01' THEN 'holdout' ELSE 'purged' END").alias("period"),
        F.expr("CASE WHEN abs(strike / spot - 1) < 0.1D THEN 'near' WHEN abs(strike / spot - 1) < 0.2D THEN 'middle' ELSE 'deep' END").alias("depth_band"), F.expr("CASE WHEN days <= 5 THEN '1-5' WHEN days <= 25 THEN '6-25' ELSE 'over' END").alias("horizon_band"), F.col("traded").alias("scored"), "ret", F.try_divide("mark", "strike").alias("time_yield"))
    e5 = lambda c: F.when(F.col(c).isNotNull(), M.half_up(F.col(c) + 1e-9, 100_000))  # noqa: E731  (halves go up in both engines)
    return H.capture_descriptives(rows).select("level", *H.CELL, "cells", "origins", "expiries", "contracts", "scored", e5("mean_return").alias("mean_e5"), e5("mean_yield").alias("yield_e5"), e5("median_return").alias("median_e5"))
