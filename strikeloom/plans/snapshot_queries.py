"""Queries over the archive snapshot, from hours and daily bars laid out of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators import archive as R
from strikeloom.operators import snapshot as P
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A

#: Hour bars, references, sessions and daily bars of two sources, with every fault among them.
BASE = """raw AS (SELECT event_id AS row_id, user_id AS contract, date_trunc('hour', ts)::TIMESTAMP AS start, floor(value * 100 + 0.5::DOUBLE)::BIGINT AS cents, event_id AS k FROM events),
bars AS (SELECT row_id, contract, CASE WHEN k % 53 > 0 THEN start END AS start, epoch_ms(start) + (k % 37 = 0)::INT AS t, CASE WHEN k % 31 > 0 THEN 'u' END AS underlying,
  cents AS open, cents + k % 7 AS high, cents - k % 5 AS low, cents + k % 3 - (k % 5 > 0)::INT AS close, k % 23 AS volume, k % 19 AS transactions, CASE WHEN k % 13 > 0 THEN k % 2 = 0 END AS adjusted FROM raw),
refs AS (SELECT c_custkey AS contract, c_mktsegment AS ticker, c_acctbal >= 0 AS ok, CASE WHEN c_acctbal < 0 THEN 'nonstandard_terms' END AS why, DATE '2024-01-25' + (c_custkey % 29)::INT AS expiry, DATE '2024-01-24' + (c_custkey % 29)::INT AS expiry_session, CASE WHEN c_custkey % 2 = 0 THEN 'call' ELSE 'put' END AS side, c_custkey % 9 AS strike FROM customer WHERE c_custkey % 17 > 0),
days_open AS (SELECT DISTINCT ts::DATE AS session FROM events),
hours_open AS (SELECT session, session::TIMESTAMP + INTERVAL '870 minutes' AS open_at, session::TIMESTAMP + INTERVAL '21 hours' AS close_at FROM days_open WHERE isodow(session) < 6),
dups AS (SELECT contract, t, count(*) AS copies FROM bars GROUP BY 1, 2 HAVING count(*) > 1),
located AS (SELECT *, timezone('America/New_York', timezone('UTC', start))::DATE AS session FROM bars),
hour_rows AS (SELECT b.*, r.expiry, r.expiry_session, r.side, start + INTERVAL '1 hour' AS "end", coalesce(start < close_at AND start + INTERVAL '1 hour' > open_at, false) AS regular, coalesce(start = date_trunc('hour', open_at), false) AS opening,
  CASE WHEN r.contract IS NULL THEN 'missing_reference' WHEN NOT r.ok THEN r.why WHEN underlying IS NULL THEN 'missing_hour_identity'
    WHEN start IS NULL OR epoch_ms(start) <> b.t THEN 'timestamp_conflict' WHEN copies IS NOT NULL THEN 'duplicate_hour'
    WHEN open <= 0 OR low <= 0 OR close <= 0 OR high < low OR open < low OR open > high OR close < low OR close > high THEN 'invalid_ohlc'
    WHEN volume <= 0 OR transactions <= 0 THEN 'invalid_activity' WHEN adjusted IS NULL THEN 'unknown_adjustment' WHEN b.session > r.expiry_session THEN 'post_expiry_bar' END AS reason
  FROM located b LEFT JOIN refs r USING (contract) LEFT JOIN hours_open s ON s.session = b.session LEFT JOIN dups d ON d.contract = b.contract AND d.t = b.t),
hours_ AS (SELECT *, reason IS NULL AS valid FROM hour_rows)"""


def _bars(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = A.table(spark, d, "events").select(k.alias("row_id"), F.col("user_id").alias("contract"), start.alias("at"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), k.alias("k"))
    k, c = F.col("k"), F.col("cents")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', at)")
    return rows.select("row_id", "contract", F.when(k % 53 > 0, F.col("at")).alias("start"), (ms + (k % 37 == 0).cast("int")).alias("t"), F.when(k % 31 > 0, "u").alias("underlying"), c.alias("open"), (c + k % 7).alias("high"), (c - k % 5).alias("low"), (c + k % 3 - (k % 5 > 0).cast("int")).alias("close"), (k % 23).alias("volume"), (k % 19).alias("transactions"), F.when(k % 13 > 0, k % 2 == 0).alias("adjusted"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    shift = (k % 29).cast("int")
    return A.table(spark, d, "customer").filter(k % 17 > 0).select(k.alias("contract"), F.col("c_mktsegment").alias("ticker"), (F.col("c_acctbal") >= 0).alias("ok"), F.when(F.col("c_acctbal") < 0, "nonstandard_terms").alias("why"), F.date_add(F.lit("2024-01-25").cast("date"), shift).alias("expiry"), F.date_add(F.lit("2024-01-24").cast("date"), shift).alias("expiry_session"), F.when(k % 2 == 0, "call").otherwise("put").alias("side"), (k % 9).alias("strike"))


def _open(spark: SparkSession, d: str) -> DataFrame:
    days = A.table(spark, d, "events").select(F.to_date("ts").alias("session")).distinct().filter(F.weekday("session") < 5)
    at = F.col("session").cast("timestamp_ntz")
    return days.select("session", (at + F.expr("INTERVAL '14:30' HOUR TO MINUTE")).alias("open_at"), (at + F.expr("INTERVAL '21' HOUR")).alias("close_at"))


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return P.hour_checks(_bars(spark, d), _refs(spark, d).drop("ticker", "strike"), _open(spark, d))


@query(f"WITH {BASE} SELECT row_id, session::VARCHAR AS session, regular, opening, reason, valid FROM hours_")
def snapshot_hour_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _hours(spark, d).select("row_id", F.col("session").cast("string").alias("session"), "regular", "opening", "reason", "valid")


DAILY = """daily AS (SELECT min(k) AS row_id, r.contract, CASE WHEN min(k) % 41 > 0 THEN start::DATE END AS session, epoch_ms(start::DATE::TIMESTAMP) + 64800000 + CASE WHEN min(k) % 29 = 0 THEN 86400000 ELSE 0 END AS t,
  arg_min(cents, k) AS open, max(cents) AS high, min(cents) - (min(k) % 43 = 0)::INT * 100000 AS low, arg_max(cents, k) AS close, sum(k % 23)::BIGINT AS volume, sum(k % 19)::BIGINT AS transactions, CASE WHEN min(k) % 27 > 0 THEN r.contract % 3 > 0 END AS adjusted,
  CASE WHEN min(k) % 47 > 0 THEN CASE WHEN (r.contract + (min(k) % 33 = 0)::INT) % 2 = 0 THEN 'call' ELSE 'put' END END AS side, r.contract % 9 AS strike, DATE '2024-01-25' + (r.contract % 29)::INT AS expiry, CASE WHEN r.contract % 11 = 0 THEN min(k) % 2 ELSE 1 END AS load FROM raw r GROUP BY r.contract, start::DATE),
fetched AS (SELECT contract, CASE WHEN contract % 3 > 0 THEN 'rest' ELSE 'flatfile' END AS source, count(*) - (contract % 10 = 0)::INT AS results, min(t) AS t, DATE '2024-01-01' AS from_date, DATE '2024-12-31' AS to_date FROM daily GROUP BY contract
  UNION ALL SELECT contract, 'rest', 1, 0, DATE '2024-01-01', DATE '2024-12-31' FROM daily WHERE contract % 14 = 0),
once AS (SELECT contract, count(*) AS fetches, CASE WHEN count(*) = 1 THEN max(source) END AS source, max(results) AS results, min(from_date) AS from_date, max(to_date) AS to_date FROM fetched GROUP BY contract),
coherent AS (SELECT contract, count(*) AS daily_rows, count(DISTINCT load) AS bar_loads, count(load) AS load_rows, count(session) AS dated_rows, min(session) AS first_date, max(session) AS last_date, count(adjusted) AS adjustment_rows, bool_and(adjusted) AS all_adjusted, bool_and(NOT adjusted) AS all_unadjusted FROM daily GROUP BY contract),
kinds AS (SELECT o.contract, CASE WHEN fetches = 1 AND daily_rows = results AND bar_loads = 1 AND load_rows = daily_rows AND dated_rows = daily_rows AND adjustment_rows = daily_rows AND first_date >= from_date AND last_date <= to_date AND ((source = 'rest' AND all_adjusted) OR (source = 'flatfile' AND all_unadjusted)) THEN source END AS kind FROM once o LEFT JOIN coherent USING (contract)),
daily_rows_ AS (SELECT d.*, k.kind, timezone('America/New_York', timezone('UTC', make_timestamp(d.t * 1000)))::DATE AS day,
  CASE WHEN kind = 'rest' THEN 'rest_daily' WHEN kind = 'flatfile' THEN 'database_flat_daily' ELSE 'database_daily_unknown' END AS name,
  CASE WHEN r.contract IS NULL THEN 'missing_reference' WHEN NOT r.ok THEN r.why WHEN d.side IS NULL THEN 'missing_daily_identity' WHEN d.side <> r.side OR d.strike <> r.strike OR d.expiry <> r.expiry THEN 'daily_identity_conflict' WHEN session IS NULL THEN 'invalid_daily_date'
    WHEN session <> day THEN 'timestamp_conflict' WHEN open <= 0 OR low <= 0 OR close <= 0 OR high < low OR open < low OR open > high OR close < low OR close > high THEN 'invalid_ohlc' WHEN volume <= 0 OR transactions <= 0 THEN 'invalid_activity' WHEN adjusted IS NULL THEN 'unknown_adjustment' END AS reason
  FROM daily d LEFT JOIN refs r USING (contract) LEFT JOIN kinds k USING (contract)),
checked_daily AS (SELECT *, coalesce(reason IS NULL AND session = day, false) AS valid FROM daily_rows_)"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    raw = A.table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("user_id").alias("contract"), F.to_date(F.date_trunc("hour", "ts")).alias("day"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    rows = raw.groupBy("contract", "day").agg(F.min("k").alias("row_id"), F.min_by("cents", "k").alias("open"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.max_by("cents", "k").alias("close"), F.sum(F.col("k") % 23).alias("volume"), F.sum(F.col("k") % 19).alias("transactions"))
    k, c = F.col("row_id"), F.col("contract")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(day as timestamp_ntz))")
    side = F.when((c + (k % 33 == 0).cast("int")) % 2 == 0, "call").otherwise("put")
    return rows.select("row_id", "contract", F.when(k % 41 > 0, F.col("day")).alias("session"), (ms + 64_800_000 + F.when(k % 29 == 0, 86_400_000).otherwise(0)).alias("t"), "open", "high", (F.col("low") - (k % 43 == 0).cast("int") * 100_000).alias("low"), "close", "volume", "transactions", F.when(k % 27 > 0, c % 3 > 0).alias("adjusted"), F.when(k % 47 > 0, side).alias("side"), (c % 9).alias("strike"), F.date_add(F.lit("2024-01-25").cast("date"), (c % 29).cast("int")).alias("expiry"), F.when(c % 11 == 0, k % 2).otherwise(1).alias("load"))


def _fetched(daily: DataFrame) -> DataFrame:
    c = F.col("contract")
    a = daily.groupBy("contract").agg(F.count("*").alias("n")).select("contract", F.when(c % 3 > 0, "rest").otherwise("flatfile").alias("source"), (F.col("n") - (c % 10 == 0).cast("int")).alias("results"))
    b = daily.filter(c % 14 == 0).select("contract", F.lit("rest").alias("source"), F.lit(1).cast("long").alias("results"))
    return a.unionByName(b).withColumns({"from_date": F.lit("2024-01-01").cast("date"), "to_date": F.lit("2024-12-31").cast("date")})


def _checked_daily(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    return P.daily_checks(daily, _refs(spark, d).drop("ticker"), P.qualified(_fetched(daily), daily))


@query(f"WITH {BASE}, {DAILY} SELECT row_id, session::VARCHAR AS session, name, reason, valid FROM checked_daily")
def daily_validity(spark: SparkSession, d: str) -> DataFrame:
    return _checked_daily(spark, d).select("row_id", F.col("session").cast("string").alias("session"), "name", "reason", "valid")


@query(f"WITH {BASE}, {DAILY} SELECT c.contract, kind, daily_rows, bar_loads, dated_rows, adjustment_rows, all_adjusted, all_unadjusted FROM coherent c JOIN kinds USING (contract)")
def daily_coherence(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    return P.coherence(daily).join(P.qualified(_fetched(daily), daily), "contract").select("contract", "kind", "daily_rows", "bar_loads", "dated_rows", "adjustment_rows", "all_adjusted", "all_unadjusted")


@query(f"WITH {BASE}, {DAILY} SELECT name, count(*) AS n FROM checked_daily GROUP BY name")
def rows_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _checked_daily(spark, d).groupBy("name").agg(F.count("*").alias("n"))


ROLLED = """rolled AS (SELECT contract, session, arg_min(expiry, (t, row_id)) AS expiry, arg_min(expiry_session, (t, row_id)) AS expiry_session, arg_min(side, (t, row_id)) AS side, arg_min(open, (t, row_id)) FILTER (u) AS hourly_open, max(high) FILTER (u) AS hourly_high, min(low) FILTER (u) AS hourly_low, arg_max(close, (t, row_id)) FILTER (u) AS mark, arg_max(start, (t, row_id)) FILTER (u) AS closing_start, arg_max("end", (t, row_id)) FILTER (u) AS closing_end,
  coalesce(sum(volume) FILTER (u), 0)::BIGINT AS volume, coalesce(sum(transactions) FILTER (u), 0)::BIGINT AS transactions, arg_min(open, (t, row_id)) FILTER (u AND opening) AS opening_open, arg_min(start, (t, row_id)) FILTER (u AND opening) AS opening_start, arg_min("end", (t, row_id)) FILTER (u AND opening) AS opening_end, count(*) FILTER (regular) AS regular_hours, count(*) AS archive_hours,
  arg_min(adjusted, (t, row_id)) FILTER (u) AS adjusted, bool_or(NOT valid AND regular) AS invalid_regular_bar, arg_min(reason, (t, row_id)) FILTER (reason IS NOT NULL) AS bar_reason FROM (SELECT *, regular AND valid AS u FROM hours_) GROUP BY contract, session),
days_ AS (SELECT *, date_diff('day', session, expiry) AS calendar_dte FROM rolled)"""


@query(f"""WITH {BASE}, {ROLLED} SELECT contract, session::VARCHAR AS session, expiry::VARCHAR AS expiry, expiry_session::VARCHAR AS expiry_session, side, hourly_open, hourly_high, hourly_low, mark, closing_start::VARCHAR AS closing_start, closing_end::VARCHAR AS closing_end, volume, transactions, opening_open, opening_start::VARCHAR AS opening_start, opening_end::VARCHAR AS opening_end, regular_hours, archive_hours, adjusted, invalid_regular_bar, bar_reason, calendar_dte FROM days_""")
def snapshot_contract_days(spark: SparkSession, d: str) -> DataFrame:
    return P.day_rollup(_hours(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("session", "expiry", "expiry_session", "closing_start", "closing_end", "opening_start", "opening_end")})


def _kept(p: str, where: str) -> str:
    values = ", ".join(f"arg_min({c}, (t, row_id)) AS {p}_{c}" for c in ("volume", "transactions", "open", "high", "low", "close", "adjusted"))
    return f"{p} AS (SELECT contract, session, count(*) AS {p}_rows, {values}, bool_and(valid) AS {p}_valid FROM checked_daily WHERE {where} GROUP BY contract, session)"


def _differs(p: str) -> str:
    prices = " OR ".join(f"abs({p}_{a} - {b}) > 1e-9" for a, b in (("open", "hourly_open"), ("close", "mark"), ("high", "hourly_high"), ("low", "hourly_low")))
    return f"(coalesce({p}_volume <> volume, false) OR coalesce({p}_transactions <> transactions, false) OR coalesce({p}_adjusted = adjusted AND ({prices}), false))"


RECONCILED = f"""{_kept("database", "row_id % 6 > 0")}, {_kept("flat", "row_id % 5 > 0")},
reconciled AS (SELECT *, coalesce(database_rows, 0) > 1 OR coalesce(flat_rows, 0) > 1 OR coalesce(NOT database_valid, false) OR coalesce(NOT flat_valid, false) OR {_differs("database")} OR (database_volume IS NULL AND {_differs("flat")}) AS reconciliation_failed,
  database_rows IS NULL AND flat_rows IS NULL AS validation_missing, database_rows IS NULL AND flat_rows IS NOT NULL AS flat_reconstructed, coalesce(database_volume <> flat_volume, false) AS source_volume_conflict,
  coalesce(mark > 0 AND volume > 0 AND transactions > 0 AND NOT invalid_regular_bar AND session <= expiry_session, false) AS valid,
  CASE WHEN invalid_regular_bar THEN bar_reason WHEN regular_hours = 0 THEN 'no_regular_session_bar' WHEN mark IS NULL THEN 'no_valid_regular_mark' WHEN session > expiry_session THEN 'post_expiry_bar' END AS reason
  FROM days_ LEFT JOIN database USING (contract, session) LEFT JOIN flat USING (contract, session))"""
FLAGS = ["reconciliation_failed", "validation_missing", "flat_reconstructed", "source_volume_conflict", "valid"]


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    daily = _checked_daily(spark, d)
    return P.reconciled(P.day_rollup(_hours(spark, d)), daily.filter("row_id % 6 > 0"), daily.filter("row_id % 5 > 0"))


@query(f"WITH {BASE}, {DAILY}, {ROLLED}, {RECONCILED} SELECT contract, session::VARCHAR AS session, {', '.join(FLAGS)}, reason FROM reconciled")
def snapshot_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).select("contract", F.col("session").cast("string").alias("session"), *FLAGS, "reason")


@query(f"WITH {BASE}, {DAILY}, {ROLLED}, {RECONCILED} SELECT count(*) AS observed, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in FLAGS)} FROM reconciled")
def coverage_counters(spark: SparkSession, d: str) -> DataFrame:
    return P.coverage(_reconciled(spark, d))


@query(f"""WITH {BASE}, {DAILY}, {ROLLED}, {RECONCILED} SELECT contract, NULL AS session, 'reference' AS grain, why AS reason, 1::BIGINT AS count FROM refs WHERE NOT ok
UNION ALL SELECT contract, session::VARCHAR, 'hour', coalesce(reason, 'outside_regular_session'), count(*) FROM hours_ WHERE NOT valid OR NOT regular GROUP BY contract, session, reason, regular
UNION ALL SELECT contract, session::VARCHAR, 'contract_day', CASE WHEN NOT valid THEN reason WHEN reconciliation_failed THEN 'daily_hour_reconciliation' ELSE 'daily_validation_missing' END, 1 FROM reconciled WHERE NOT valid OR reconciliation_failed OR validation_missing
UNION ALL SELECT contract, NULL, 'reference', 'identical_duplicate_reference', 1 FROM refs WHERE contract % 23 = 0""")
def snapshot_exclusions(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    return P.exclusion_rows(refs, _hours(spark, d), _reconciled(spark, d), refs.filter("contract % 23 = 0")).withColumn("session", F.col("session").cast("string"))


@query(sql("stocks", "SELECT o_orderkey AS row_id, o_orderdate::DATE::VARCHAR AS session, close AS stock_close, CASE WHEN close IS NULL THEN 'unverified' ELSE 'verified' END AS stock_status FROM orders LEFT JOIN (SELECT * FROM stocks WHERE ts < DATE '1998-01-01') s ON s.ticker = o_orderpriority AND s.ts = o_orderdate::DATE"))
def verified_stock_close(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.to_date("o_orderdate").alias("session"), F.col("o_orderpriority").alias("ticker"))
    return P.with_close(rows, A.stocks(spark, d).filter("ts < date'1998-01-01'")).select("row_id", F.col("session").cast("string").alias("session"), "stock_close", "stock_status")


DTE_BAND = "CASE WHEN date_diff('day', h.session, h.expiry) <= 0 THEN 'expired_or_same_day' WHEN date_diff('day', h.session, h.expiry) <= 7 THEN '1_7_days' WHEN date_diff('day', h.session, h.expiry) <= 35 THEN '8_35_days' ELSE 'over_35_days' END"
STRIKE_BAND = "CASE WHEN s.close IS NULL THEN 'unverified_stock' WHEN s.close = 0 THEN 'worthless_stock' WHEN r.strike * 4000.0::DOUBLE / s.close - 1 < -0.1::DOUBLE THEN 'far_below' WHEN r.strike * 4000.0::DOUBLE / s.close - 1 < -0.025::DOUBLE THEN 'below' WHEN r.strike * 4000.0::DOUBLE / s.close - 1 < 0.025::DOUBLE THEN 'near' WHEN r.strike * 4000.0::DOUBLE / s.close - 1 < 0.1::DOUBLE THEN 'above' ELSE 'far_above' END"


@query(f"""WITH {BASE}, closes AS (SELECT user_id AS contract, ts::DATE AS session, max(value) * 100 AS close FROM events GROUP BY 1, 2)
SELECT coalesce(r.ticker, '') AS ticker, coalesce(h.side, '') AS side, {DTE_BAND} AS dte_band, {STRIKE_BAND} AS strike_band, coalesce(hour(timezone('America/New_York', timezone('UTC', start))), -1)::INT AS hour, regular, valid, coalesce(reason, '') AS reason, count(*) AS bars, count(DISTINCT h.contract) AS contracts,
  count(DISTINCT coalesce(h.session, DATE '1900-01-01')) AS sessions, sum(volume)::BIGINT AS volume, sum(transactions)::BIGINT AS transactions, count(*) FILTER (transactions = 1) AS single, count(*) FILTER (volume <= 5) AS small, quantile_cont(volume, 0.5) AS median_volume
FROM hours_ h LEFT JOIN refs r USING (contract) LEFT JOIN closes s ON s.contract = h.contract AND s.session = h.session GROUP BY ALL""")
def hour_activity(spark: SparkSession, d: str) -> DataFrame:
    closes = A.table(spark, d, "events").groupBy(F.col("user_id").alias("contract"), F.to_date("ts").alias("session")).agg((F.max("value") * 100).alias("stock"))
    rows = _hours(spark, d).join(_refs(spark, d).select("contract", "ticker", "strike"), "contract", "left").join(closes, ["contract", "session"], "left")
    left = F.datediff("expiry", "session")
    dte = F.when(left <= 0, "expired_or_same_day").when(left <= 7, "1_7_days").when(left <= 35, "8_35_days").otherwise("over_35_days")
    distance = F.try_divide(F.col("strike") * 4000.0, F.col("stock")) - 1
    strike = F.when(F.col("stock").isNull(), "unverified_stock").when(F.col("stock") == 0, "worthless_stock").otherwise(M.bands(distance, [-0.1, -0.025, 0.025, 0.1], ["far_below", "below", "near", "above", "far_above"]))
    strike = F.when((F.col("stock") != 0) & F.col("strike").isNull(), "far_above").otherwise(strike)
    return R.hour_activity(rows.withColumns({"dte_band": dte, "strike_band": strike, "hour": F.hour(P.local_time(F.col("start"), "America/New_York"))}))
