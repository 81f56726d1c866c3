"""Queries over bars, the archive and price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators import archive as R
from strikeloom.operators import series as S
from strikeloom.plans.chain_queries import up
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A

CHECKED = """checked AS (SELECT row_id, contract, start, kind, cents, ts, copies,
    coalesce(start < close_at AND start + INTERVAL '1 hour' > open_at, false) AS regular,
    CASE WHEN known IS NULL THEN 'missing_reference' WHEN reason_ IS NOT NULL THEN reason_ WHEN ts IS NULL THEN 'missing_timestamp' WHEN copies > 1 THEN 'duplicate_hour' WHEN cents <= 0 THEN 'invalid_price' WHEN open_at IS NULL THEN 'no_session' END AS reason
  FROM (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS start, ts::DATE AS session, count(*) OVER (PARTITION BY contract, date_trunc('hour', ts), kind) AS copies FROM ticks) t
  LEFT JOIN (SELECT contract, true AS known, reason AS reason_ FROM contracts) c USING (contract) LEFT JOIN sessions s USING (session))"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return R.hour_validity(A.ticks(spark, d), A.contracts(spark, d), A.sessions(spark, d))


@query(sql("ticks contracts sessions", f"WITH {CHECKED} SELECT row_id, copies, regular, reason FROM checked"))
def hour_validity_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("row_id", "copies", "regular", "reason")


@query(sql("ticks", "SELECT contract, date_trunc('hour', ts)::TIMESTAMP::VARCHAR AS start, kind, count(*) AS copies, count(DISTINCT struct_pack(c := cents, t := ts)) AS variants FROM ticks GROUP BY ALL HAVING count(*) > 1"))
def duplicate_hour_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = A.ticks(spark, d).withColumn("start", F.date_trunc("hour", "ts").cast("timestamp_ntz").cast("string"))
    return R.duplicate_keys(rows, ["contract", "start", "kind"], ["cents", "ts"])


@query(sql("ticks", """SELECT contract, ts::DATE::VARCHAR AS session, count(*) AS rows, count(*) FILTER (u) AS usable_rows, arg_min(cents, row_id) FILTER (u) AS opening, arg_max(cents, row_id) FILTER (u) AS mark, max(cents) FILTER (u) AS high, min(cents) FILTER (u) AS low, coalesce(sum(cents) FILTER (u), 0)::BIGINT AS volume, count(*) FILTER (NOT u) AS invalid_rows,
  strftime(min(ts) FILTER (u), '%H:%M:%S') AS first_at, strftime(max(ts) FILTER (u), '%H:%M:%S') AS last_at FROM (SELECT *, kind <> 'error' AND cents > 200 AS u FROM ticks) GROUP BY ALL"""))
def contract_day_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = R.contract_days(A.ticks(spark, d).withColumn("usable", (F.col("kind") != "error") & (F.col("cents") > 200)))
    return out.withColumns({"session": F.col("session").cast("string"), "first_at": F.date_format("first_at", "HH:mm:ss"), "last_at": F.date_format("last_at", "HH:mm:ss")})


RECONCILED = """hday AS (SELECT contract, date_trunc('day', start)::TIMESTAMP AS start, arg_min(open, start) AS h_open, max(high) AS h_high, min(low) AS h_low, arg_max(close, start) AS h_close, sum(volume)::BIGINT AS h_volume, sum(transactions)::BIGINT AS h_transactions FROM hours GROUP BY 1, 2),
  reconciled AS (SELECT h.contract, h.start, h_volume, h_transactions, d.volume, CASE WHEN d.volume IS NULL THEN 'no_daily_bar' WHEN coalesce(abs(h_volume - d.volume) >= 50, false) OR coalesce(h_open <> d.open, false) OR coalesce(h_high <> d.high, false) OR coalesce(h_low <> d.low, false) OR coalesce(h_close <> d.close, false) THEN 'failed' ELSE 'agreed' END AS status FROM hday h LEFT JOIN days d USING (contract, start))"""


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    t = A.ticks(spark, d)
    return R.reconcile(A.bars(t, "hour"), A.bars(t.filter("kind <> 'error'"), "day"))


@query(sql("hours days", f"WITH {RECONCILED} SELECT contract, start::DATE::VARCHAR AS session, h_volume, h_transactions, volume, status FROM reconciled"))
def daily_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).select("contract", F.to_date("start").cast("string").alias("session"), "h_volume", "h_transactions", "volume", "status")


EXCLUDED = """excluded AS (SELECT 'reference' AS grain, contract, NULL::TIMESTAMP AS at, reason, 1::BIGINT AS n FROM contracts WHERE reason IS NOT NULL
  UNION ALL SELECT 'hour', contract, start, reason, count(*) FROM checked WHERE reason IS NOT NULL GROUP BY contract, start, reason
  UNION ALL SELECT 'contract_day', contract, start, 'reconciliation_failed', 1 FROM reconciled WHERE status = 'failed')"""


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    return R.exclusions(A.contracts(spark, d), _checked(spark, d), _reconciled(spark, d))


@query(sql("hours days contracts sessions", f'WITH {CHECKED}, {RECONCILED}, {EXCLUDED} SELECT grain, contract, "at"::VARCHAR AS "at", reason, n FROM excluded'))
def exclusion_union(spark: SparkSession, d: str) -> DataFrame:
    return _excluded(spark, d).withColumn("at", F.col("at").cast("string"))


@query(sql("hours days contracts sessions", f"WITH {CHECKED}, {RECONCILED}, {EXCLUDED} SELECT grain, reason, sum(n)::BIGINT AS n, count(DISTINCT contract) AS contracts FROM excluded GROUP BY ALL"))
def exclusion_reason_totals(spark: SparkSession, d: str) -> DataFrame:
    return R.exclusion_totals(_excluded(spark, d))


FETCHES = "fetches AS (SELECT l_orderkey AS contract, 'hour_' || lower(l_returnflag) AS kind, l_shipdate AS at, (l_quantity % 7)::BIGINT AS results FROM lineitem UNION ALL SELECT o_orderkey, 'day', o_orderdate, o_custkey % 5 FROM orders)"


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    li, o = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    a = li.select(F.col("l_orderkey").alias("contract"), F.concat(F.lit("hour_"), F.lower("l_returnflag")).alias("kind"), F.col("l_shipdate").alias("at"), (F.col("l_quantity") % 7).cast("long").alias("results"))
    b = o.select(F.col("o_orderkey").alias("contract"), F.lit("day").alias("kind"), F.col("o_orderdate").alias("at"), (F.col("o_custkey") % 5).alias("results"))
    return a.unionByName(b)


@query(f"""WITH {FETCHES} SELECT contract, count(*) AS fetches, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max("at")::DATE::VARCHAR AS last_at, CASE WHEN count(*) = 1 THEN max(kind) END AS only_kind FROM fetches GROUP BY contract""")
def fetch_provenance(spark: SparkSession, d: str) -> DataFrame:
    return R.provenance(_fetches(spark, d)).withColumn("last_at", F.to_date("last_at").cast("string"))


@query(f"""WITH {FETCHES} SELECT kind, count(*) AS n, count(*) FILTER (results = 0) AS empty, count(*) FILTER (results > 4) AS many, min("at")::DATE::VARCHAR AS first_at, max("at")::DATE::VARCHAR AS last_at, count(DISTINCT contract) AS contracts FROM fetches GROUP BY kind""")
def fetch_audit_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return R.fetch_audit(_fetches(spark, d)).withColumns({"first_at": F.to_date("first_at").cast("string"), "last_at": F.to_date("last_at").cast("string")})


@query(f"WITH {FETCHES} SELECT o_orderkey AS contract, o_orderpriority AS ticker FROM orders WHERE o_orderkey NOT IN (SELECT contract FROM fetches WHERE kind = 'hour_r')")
def contracts_without_fetch(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("contract"), F.col("o_orderpriority").alias("ticker"))
    return R.without(rows, _fetches(spark, d).filter("kind = 'hour_r'"), "contract")


@query(sql("stocks cal", """WITH span AS (SELECT ticker, min(ts) AS a, max(ts) AS b FROM stocks GROUP BY 1),
  gaps AS (SELECT ticker, session, ordinal FROM span JOIN cal ON session BETWEEN a AND b ANTI JOIN stocks ON stocks.ticker = span.ticker AND stocks.ts = cal.session),
  i AS (SELECT *, ordinal - row_number() OVER (PARTITION BY ticker ORDER BY ordinal) AS island FROM gaps)
  SELECT ticker, min(session)::VARCHAR AS first_session, max(session)::VARCHAR AS last_session, count(*) AS sessions FROM i GROUP BY ticker, island"""))
def missing_session_windows(spark: SparkSession, d: str) -> DataFrame:
    have = A.stocks(spark, d).select("ticker", F.col("ts").alias("session"))
    return R.missing_windows(A.calendar(spark, d), have, "ticker").withColumns({c: F.col(c).cast("string") for c in ("first_session", "last_session")})


@query(sql("hours days", "WITH h AS (SELECT contract, date_trunc('day', start)::TIMESTAMP AS start, sum(volume) AS hv FROM hours GROUP BY 1, 2) SELECT contract, count(*) FILTER (abs(coalesce(hv, 0) - volume) >= 50) AS mismatched, count(*) FILTER (hv IS NULL) AS without_hours, count(*) AS days FROM days LEFT JOIN h USING (contract, start) GROUP BY contract"))
def volume_mismatch_days(spark: SparkSession, d: str) -> DataFrame:
    t = A.ticks(spark, d)
    return R.mismatched_days(A.bars(t, "hour"), A.bars(t.filter("kind <> 'error'"), "day"))


DTE_BAND = "CASE WHEN dte <= 0 THEN 'expired' WHEN dte <= 7 THEN 'week' WHEN dte <= 35 THEN 'month' ELSE 'later' END"
STRIKE_BAND = "CASE WHEN strike / spot - 1 < -0.1::DOUBLE THEN 'far_below' WHEN strike / spot - 1 < -0.025::DOUBLE THEN 'below' WHEN strike / spot - 1 < 0.025::DOUBLE THEN 'near' WHEN strike / spot - 1 < 0.1::DOUBLE THEN 'above' ELSE 'far_above' END"
ACTIVITY = "count(*) AS n, count(DISTINCT l_partkey) AS contracts, count(DISTINCT ticker) AS tickers, sum(oi)::BIGINT AS volume, count(*) FILTER (oi >= 20) AS active, quantile_cont(oi, 0.5) AS median_oi"


@query(sql("quotes", f"SELECT side, {DTE_BAND} AS dte_band, {STRIKE_BAND} AS strike_band, {ACTIVITY} FROM quotes GROUP BY ALL"))
def liquidity_activity(spark: SparkSession, d: str) -> DataFrame:
    dte = M.bands(F.col("dte"), [1, 8, 36], ["expired", "week", "month", "later"])
    strike = M.bands(F.col("strike") / F.col("spot") - 1, [-0.1, -0.025, 0.025, 0.1], ["far_below", "below", "near", "above", "far_above"])
    return R.activity(A.quotes(spark, d).withColumns({"dte_band": dte, "strike_band": strike}), ["side", "dte_band", "strike_band"])


@query(sql("days contracts", "SELECT ticker, count(*) AS contract_days, count(DISTINCT contract) AS contracts, sum(volume)::BIGINT AS volume, sum(transactions)::BIGINT AS transactions, count(*) FILTER (transactions >= 5) AS active_days, count(*) FILTER (volume >= 20000) AS large_days, min(start)::DATE::VARCHAR AS first_day, max(start)::DATE::VARCHAR AS last_day, quantile_cont(transactions, 0.5) AS median_transactions FROM days JOIN contracts USING (contract) GROUP BY ticker"))
def liquidity_contract_days(spark: SparkSession, d: str) -> DataFrame:
    days = A.bars(A.ticks(spark, d).filter("kind <> 'error'"), "day").join(A.contracts(spark, d), "contract")
    return days.groupBy("ticker").agg(F.count("*").alias("contract_days"), F.count_distinct("contract").alias("contracts"), F.sum("volume").alias("volume"), F.sum("transactions").alias("transactions"), F.count_if(F.col("transactions") >= 5).alias("active_days"), F.count_if(F.col("volume") >= 20000).alias("large_days"), F.to_date(F.min("start")).cast("string").alias("first_day"), F.to_date(F.max("start")).cast("string").alias("last_day"), F.percentile("transactions", F.lit(0.5)).alias("median_transactions"))


@query(sql("ticks contracts", "SELECT t.ticker, count(*) AS contracts, count(*) FILTER (reason IS NOT NULL) AS rejected, count(DISTINCT k.contract) AS with_ticks, coalesce(sum(n), 0)::BIGINT AS ticks FROM contracts t LEFT JOIN (SELECT contract, count(*) AS n FROM ticks GROUP BY 1) k USING (contract) GROUP BY t.ticker"))
def liquidity_archive(spark: SparkSession, d: str) -> DataFrame:
    n = A.ticks(spark, d).groupBy("contract").agg(F.count("*").alias("n")).withColumn("has", F.col("contract"))
    return A.contracts(spark, d).join(n, "contract", "left").groupBy("ticker").agg(F.count("*").alias("contracts"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_distinct("has").alias("with_ticks"), F.coalesce(F.sum("n"), F.lit(0)).alias("ticks"))


@query(sql("ticks", """WITH RECURSIVE c AS (SELECT contract, ts::DATE AS session, least(sum(cents) // 10, 960)::BIGINT AS cost, row_number() OVER (PARTITION BY contract ORDER BY ts::DATE) AS rn FROM ticks GROUP BY contract, ts::DATE),
  p AS (SELECT contract, session, cost, rn, 0::BIGINT AS w, cost AS used FROM c WHERE rn = 1 UNION ALL SELECT c.contract, c.session, c.cost, c.rn, CASE WHEN p.used > 0 AND p.used + c.cost > 2500 THEN p.w + 1 ELSE p.w END, CASE WHEN p.used > 0 AND p.used + c.cost > 2500 THEN c.cost ELSE p.used + c.cost END FROM p JOIN c ON c.contract = p.contract AND c.rn = p.rn + 1)
  SELECT contract, session::VARCHAR AS session, cost, w AS "window" FROM p""").replace("WITH ticks", "WITH RECURSIVE ticks").replace(",\nRECURSIVE c AS", ",\nc AS"))
def plan_download_windows(spark: SparkSession, d: str) -> DataFrame:
    days = A.ticks(spark, d).groupBy("contract", F.to_date("ts").alias("session")).agg(R.minute_cost(F.floor(F.sum("cents") / 10)).alias("cost"))
    return R.plan_windows(days, 2500).withColumn("session", F.col("session").cast("string"))


RETURNS = "r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY ts)) AS ret FROM stocks)"


def r6(x: str) -> str:
    return up(x, 1000000)


@query(sql("stocks cal", f"""WITH i AS (SELECT s.*, c.ordinal - row_number() OVER (PARTITION BY ticker ORDER BY ts) AS island FROM stocks s JOIN cal c ON c.session = s.ts),
  f AS (SELECT *, ln(close / lag(close) OVER w) AS ret, close / lag(close, 5) OVER w - 1 AS ret5, close / lag(close, 20) OVER w - 1 AS ret20 FROM i WINDOW w AS (PARTITION BY ticker, island ORDER BY ts)),
  v AS (SELECT *, CASE WHEN count(ret) OVER g = 20 THEN stddev_samp(ret) OVER g * sqrt(252) END AS vol20 FROM f WINDOW g AS (PARTITION BY ticker, island ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT ticker, ts::VARCHAR AS ts, {r6('ret5')} AS ret5, {r6('ret20')} AS ret20, {r6('vol20')} AS vol20 FROM v"""))
def stock_returns_vol(spark: SparkSession, d: str) -> DataFrame:
    f = S.features(A.stocks(spark, d), A.calendar(spark, d))
    return f.select("ticker", F.col("ts").cast("string").alias("ts"), *[M.half_up(F.col(c), 1_000_000).alias(c) for c in ("ret5", "ret20", "vol20")])


@query(sql("stocks", f"""WITH {RETURNS}, l AS (SELECT ticker, ts, list(ret) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS a, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS rn FROM r),
  u AS (SELECT ticker, ts, unnest(a) AS x, generate_subscripts(a, 1) AS i, len(a) AS n FROM l WHERE rn > 60),
  v AS (SELECT ticker, ts, sum(x * x * pow(0.94::DOUBLE, 60 - i)) / ((1 - pow(0.94::DOUBLE, 60)) / (1 - 0.94::DOUBLE)) AS var, count(x) AS k FROM u GROUP BY 1, 2)
  SELECT l.ticker, l.ts::VARCHAR AS ts, {r6('(CASE WHEN v.k = 60 AND v.var > 1e-16 THEN sqrt(v.var) END)')} AS vol FROM l LEFT JOIN v ON v.ticker = l.ticker AND v.ts = l.ts"""))
def ewma_vol60(spark: SparkSession, d: str) -> DataFrame:
    return S.ewma_volatility(A.stocks(spark, d)).select("ticker", F.col("ts").cast("string").alias("ts"), M.half_up(F.col("vol"), 1_000_000).alias("vol"))


@query(sql("stocks", f"""WITH {RETURNS}, v AS (SELECT *, ret * ret AS v FROM r), f AS (SELECT ticker, ts, v, lag(v) OVER w AS v1, CASE WHEN count(v) OVER a = 5 THEN avg(v) OVER a END AS v5, CASE WHEN count(v) OVER b = 22 THEN avg(v) OVER b END AS v22 FROM v
  WINDOW w AS (PARTITION BY ticker ORDER BY ts), a AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING))
  SELECT ticker, ts::VARCHAR AS ts, {r6('v')} AS v, {r6('v1')} AS v1, {r6('v5')} AS v5, {r6('v22')} AS v22 FROM f"""))
def har_features(spark: SparkSession, d: str) -> DataFrame:
    return S.har(A.stocks(spark, d)).select("ticker", F.col("ts").cast("string").alias("ts"), *[M.half_up(F.col(c), 1_000_000).alias(c) for c in ("v", "v1", "v5", "v22")])


@query(sql("stocks", f"""WITH r AS (SELECT *, ln(open / lag(close) OVER (PARTITION BY ticker ORDER BY ts)) AS night, ln(close / open) AS day FROM stocks),
  f AS (SELECT ticker, ts, count(night) OVER g AS k, avg(night * night) OVER g AS n, avg(CASE WHEN night IS NOT NULL THEN day * day END) OVER g AS d FROM r WINDOW g AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
  SELECT ticker, ts::VARCHAR AS ts, {r6('(CASE WHEN k = 60 THEN n / (n + d) END)')} AS share FROM f"""))
def variance_shares(spark: SparkSession, d: str) -> DataFrame:
    return S.variance_shares(A.stocks(spark, d)).select("ticker", F.col("ts").cast("string").alias("ts"), M.half_up(F.col("share"), 1_000_000).alias("share"))


@query(sql("stocks", f"""WITH {RETURNS}, g AS (SELECT *, ln(high / low) AS rng FROM r), f AS (SELECT ticker, ts, count(ret) OVER a AS ka, avg(ret) OVER a AS mean5, stddev_pop(ret) OVER a AS dev5, avg(rng * rng) OVER a AS range5, count(ret) OVER b AS kb, avg(ret) OVER b AS mean22, stddev_pop(ret) OVER b AS dev22, avg(rng * rng) OVER b AS range22, count(*) OVER b AS n, avg(volume) OVER a AS va, avg(volume) OVER b AS vb FROM g
  WINDOW a AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 21 PRECEDING AND CURRENT ROW))
  SELECT ticker, ts::VARCHAR AS ts, {r6('(CASE WHEN ka = 5 THEN mean5 END)')} AS mean5, {r6('(CASE WHEN ka = 5 THEN dev5 END)')} AS dev5, {r6('(CASE WHEN ka = 5 THEN range5 / (4 * 0.6931471805599453::DOUBLE) END)')} AS range5, {r6('(CASE WHEN kb = 22 THEN mean22 END)')} AS mean22, {r6('(CASE WHEN kb = 22 THEN dev22 END)')} AS dev22, {r6('(CASE WHEN kb = 22 THEN range22 / (4 * 0.6931471805599453::DOUBLE) END)')} AS range22, {r6('(CASE WHEN n = 22 THEN va / vb END)')} AS volume_ratio FROM f"""))
def trailing_features(spark: SparkSession, d: str) -> DataFrame:
    names = ("mean5", "dev5", "range5", "mean22", "dev22", "range22", "volume_ratio")
    return S.trailing(A.stocks(spark, d)).select("ticker", F.col("ts").cast("string").alias("ts"), *[M.half_up(F.col(c), 1_000_000).alias(c) for c in names])


@query(sql("stocks cal", f"""WITH span AS (SELECT ticker, min(ts) AS a, max(ts) AS b FROM stocks GROUP BY 1), g AS (SELECT ticker, session AS ts FROM span JOIN cal ON session BETWEEN a AND b),
  j AS (SELECT g.ticker, g.ts, s.close FROM g LEFT JOIN stocks s ON s.ticker = g.ticker AND s.ts = g.ts), r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY ts)) AS ret FROM j),
  v AS (SELECT *, CASE WHEN count(ret) OVER f >= 5 THEN sqrt(avg(ret * ret) OVER f) END AS vol, lead(close, 1) OVER w AS c1, lead(close, 5) OVER w AS c5, lead(close, 15) OVER w AS c15 FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts), f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  u AS (SELECT ticker, ts, close, vol, 1 AS horizon, c1 AS later FROM v UNION ALL SELECT ticker, ts, close, vol, 5, c5 FROM v UNION ALL SELECT ticker, ts, close, vol, 15, c15 FROM v)
  SELECT ticker, ts::VARCHAR AS ts, horizon, {up('(ln(later / close) / (vol * sqrt(horizon::DOUBLE)))', 100000)} AS z FROM u WHERE close IS NOT NULL AND later IS NOT NULL AND vol > 0"""))
def forward_standardized_returns(spark: SparkSession, d: str) -> DataFrame:
    rows = S.forward_returns(A.stocks(spark, d), A.calendar(spark, d), [1, 5, 15])
    return rows.select("ticker", F.col("ts").cast("string").alias("ts"), "horizon", M.half_up(F.col("z"), 100_000).alias("z"))


@query(sql("stocks", "WITH e AS (SELECT DISTINCT ticker, ts FROM stocks WHERE volume >= 4), f AS (SELECT s.*, CASE WHEN e.ts IS NULL THEN 0 ELSE 1 END AS hit FROM stocks s LEFT JOIN e USING (ticker, ts)) SELECT ticker, ts::VARCHAR AS ts, (sum(hit) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING))::BIGINT AS actions, count(*) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) = 10 AS complete FROM f"))
def corporate_action_interval(spark: SparkSession, d: str) -> DataFrame:
    s = A.stocks(spark, d)
    return S.corporate_actions(s, s.filter("volume >= 4").select("ticker", "ts").distinct(), 10).select("ticker", F.col("ts").cast("string").alias("ts"), "actions", "complete")


@query(sql("cal", "SELECT session::VARCHAR AS session, ordinal FROM cal WHERE (ordinal - 1) % 26 = 0 ORDER BY cal.session DESC LIMIT 40"))
def every_26th_session(spark: SparkSession, d: str) -> DataFrame:
    return S.every_kth(A.calendar(spark, d), 26, 40).withColumn("session", F.col("session").cast("string"))


@query("""WITH e AS (SELECT *, 'O:U' || (user_id % 40) AS ticker, ts::DATE AS day, value * 1.0 AS open FROM events), l AS (SELECT ticker, day, max(event_id) AS event_id FROM e WHERE user_id % 40 < 30 GROUP BY 1, 2)
SELECT ticker, day::VARCHAR AS day, epoch_ms(timezone('America/New_York', day::TIMESTAMP))::BIGINT AS t, floor(value * 100 + 0.5::DOUBLE)::BIGINT AS c_cents, user_id::BIGINT AS n FROM l JOIN e USING (ticker, day, event_id)""")
def flat_day_files(spark: SparkSession, d: str) -> DataFrame:
    """Events written as day files of bars and read back by the day-file source: the last bar of each wanted ticker and day."""
    from strikeloom.sources import flatfiles as X
    from strikeloom.sources.scratch import scratch_dir

    ticker = F.concat(F.lit("O:U"), (F.col("user_id") % 40).cast("string"))
    e = A.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    noon = F.unix_seconds(F.to_timestamp(F.concat(F.to_date("ts").cast("string"), F.lit(" 17:00:00")))) * 1_000_000_000
    rows = e.select(ticker.alias("ticker"), F.lit(1).alias("volume"), *[F.col("value").alias(c) for c in ("open", "close", "high", "low")], noon.alias("window_start"), F.col("user_id").alias("transactions"), F.to_date("ts").alias("day"), "event_id")
    folder = scratch_dir(spark, "day-files")
    rows.repartition("day").sortWithinPartitions("day", "event_id").drop("event_id").write.partitionBy("day").option("header", True).option("compression", "gzip").csv(folder)
    wanted = rows.filter(F.col("transactions") % 40 < 30).select("ticker")
    bars = X.flat_bars(X.read_days(spark, folder), wanted)
    return bars.select("ticker", F.col("day").cast("string").alias("day"), "t", F.floor(F.col("c") * 100 + 0.5).cast("long").alias("c_cents"), "n")
