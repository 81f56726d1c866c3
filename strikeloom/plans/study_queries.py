"""Queries over the ledger, studies, distributions and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import dist as D
from strikeloom.functions import money as M
from strikeloom.operators import ledger as L
from strikeloom.operators import studies as S
from strikeloom.plans.chain_queries import IDS, up
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A

LAST = "last AS (SELECT contract, checked_at, status, key, itm FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY checked_at DESC, key DESC) AS rn FROM revisions) WHERE rn = 1)"


def iso(name: str) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Revisions with equal rows counted once."""
    return A.labels(spark, d).groupBy("contract", "checked_at", "key").agg(F.max("status").alias("status"), F.max("itm").alias("itm"))


REVISIONS = "rev AS (SELECT contract, checked_at, key, max(status) AS status, max(itm) AS itm FROM revisions GROUP BY 1, 2, 3)"
LAST = f"{REVISIONS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY checked_at DESC, key DESC) AS rn FROM rev) WHERE rn = 1)"


@query(sql("revisions", f"WITH {LAST} SELECT contract, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, key, status, itm FROM last"))
def latest_label_revision(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(_labels(spark, d), ["contract"], [F.col("checked_at"), F.col("key")]).withColumn("checked_at", iso("checked_at"))


@query(sql("revisions issuances", f"WITH {REVISIONS}, known AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY checked_at DESC, key DESC) AS rn FROM rev WHERE checked_at <= TIMESTAMP '1998-01-01') WHERE rn = 1) SELECT i.contract, i.model, strftime(k.checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, k.status FROM issuances i LEFT JOIN known k USING (contract) WHERE issued_at <= TIMESTAMP '1998-01-01'"))
def labels_as_of(spark: SparkSession, d: str) -> DataFrame:
    return L.labels_as_of(A.issuances(spark, d), _labels(spark, d), "1998-01-01 00:00:00").select("contract", "model", iso("checked_at").alias("checked_at"), "status")


DUE = "CASE WHEN status = 'valid' THEN checked_at + INTERVAL '1 day' ELSE checked_at + INTERVAL '1 hour' END"


@query(sql("revisions issuances", f"WITH {LAST}, r AS (SELECT i.contract, status, {DUE} AS due_at FROM (SELECT DISTINCT contract FROM issuances) i LEFT JOIN last USING (contract)) SELECT contract, status, strftime(due_at, '%Y-%m-%d %H:%M:%S') AS due_at FROM r WHERE due_at IS NULL OR due_at <= TIMESTAMP '1998-01-01' ORDER BY r.due_at NULLS FIRST, contract LIMIT 500"))
def due_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.due_labels(A.issuances(spark, d), _labels(spark, d), "1998-01-01 00:00:00", 500).select("contract", "status", iso("due_at").alias("due_at"))


@query(sql("issuances revisions", f"WITH {LAST} SELECT i.contract, i.ticker, last.itm FROM issuances i JOIN last USING (contract) WHERE last.status = 'valid' AND i.cents > 10000000"))
def latest_outcome_qualify(spark: SparkSession, d: str) -> DataFrame:
    last = L.latest(_labels(spark, d), ["contract"], [F.col("checked_at"), F.col("key")])
    return A.issuances(spark, d).filter("cents > 10000000").join(last.filter("status = 'valid'"), "contract").select("contract", "ticker", "itm")


@query(sql("issuances", "WITH b AS (SELECT owner, issued_at, max(contract) AS base FROM issuances WHERE model = 'baseline' GROUP BY 1, 2) SELECT c.contract, arg_max(b.base, b.issued_at) AS base FROM issuances c LEFT JOIN b ON b.owner = c.owner AND b.issued_at <= c.issued_at WHERE c.model = 'challenger' GROUP BY c.contract"))
def asof_baseline_match(spark: SparkSession, d: str) -> DataFrame:
    i = A.issuances(spark, d)
    base = i.filter("model = 'baseline'").select("owner", "issued_at", F.col("contract").alias("base"))
    return L.asof_backward(i.filter("model = 'challenger'").select("owner", "contract", "issued_at"), base, ["owner"], "issued_at", "issued_at", ["base"], "base").select("contract", "base")


@query(sql("revisions", "WITH r AS (SELECT contract % 500 AS series, checked_at, max(key) AS key FROM revisions GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY checked_at DESC) AS rn FROM r WHERE checked_at <= TIMESTAMP '1999-01-01') SELECT series, key, strftime(checked_at, '%Y-%m-%d') AS effective FROM l WHERE rn = 1 AND checked_at >= TIMESTAMP '1998-12-20'"))
def effective_schedule_revision(spark: SparkSession, d: str) -> DataFrame:
    r = A.labels(spark, d).groupBy((F.col("contract") % 500).alias("series"), "checked_at").agg(F.max("key").alias("key"))
    last = L.latest(r.filter(F.col("checked_at") <= F.lit("1999-01-01").cast("timestamp_ntz")), ["series"], [F.col("checked_at")])
    return last.filter(F.col("checked_at") >= F.lit("1998-12-20").cast("timestamp_ntz")).select("series", "key", F.date_format("checked_at", "yyyy-MM-dd").alias("effective"))


CURVE = "curve AS (SELECT n_regionkey AS curve, (n_nationkey + 1)::DOUBLE AS years, 0.01 + (n_nationkey * 7 % 25) / 1000.0::DOUBLE AS rate FROM nation)"


@query(f"WITH {CURVE}, steps AS (SELECT curve, years AS y0, rate AS r0, lead(years) OVER w AS y1, lead(rate) OVER w AS r1 FROM curve WINDOW w AS (PARTITION BY curve ORDER BY years)), q AS (SELECT c_custkey, c_custkey % 5 AS curve, (c_custkey % 97) / 4.0::DOUBLE AS years FROM customer) SELECT c_custkey, {up('(r0 + (r1 - r0) * (q.years - y0) / (y1 - y0))', 1000000)} AS rate_e6 FROM q LEFT JOIN steps s ON s.curve = q.curve AND q.years >= y0 AND q.years < y1")
def treasury_interpolation(spark: SparkSession, d: str) -> DataFrame:
    n = A.table(spark, d, "nation")
    curve = n.select(F.col("n_regionkey").cast("long").alias("curve"), (F.col("n_nationkey") + 1).cast("double").alias("years"), (F.col("n_nationkey") * 7 % 25 / 1000.0 + 0.01).alias("rate"))
    wanted = A.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("curve"), (F.col("c_custkey") % 97 / 4.0).alias("years"))
    return L.due_interpolated(curve, wanted).select("c_custkey", M.half_up(F.col("rate"), 1_000_000).alias("rate_e6"))


@query(sql("issuances revisions", f"WITH {LAST} SELECT ticker, model, count(*) AS attempted, count(status) AS labelled, count(*) FILTER (status = 'valid') AS scored FROM issuances LEFT JOIN last USING (contract) GROUP BY ALL"))
def issuance_coverage(spark: SparkSession, d: str) -> DataFrame:
    return L.coverage(A.issuances(spark, d), _labels(spark, d))


@query(sql("issuances cal", "WITH q AS (SELECT DISTINCT ticker, issued_at::DATE AS session FROM issuances), e AS (SELECT year(session) || 'Q' || quarter(session) AS quarter, count(*) AS expected FROM cal GROUP BY 1), r AS (SELECT ticker, year(session) || 'Q' || quarter(session) AS quarter, count(*) AS recorded FROM q GROUP BY 1, 2) SELECT t.ticker, e.quarter, e.expected, coalesce(r.recorded, 0) AS recorded FROM (SELECT DISTINCT ticker FROM q) t CROSS JOIN e LEFT JOIN r ON r.ticker = t.ticker AND r.quarter = e.quarter"))
def panel_coverage(spark: SparkSession, d: str) -> DataFrame:
    return L.panel_coverage(A.issuances(spark, d), A.calendar(spark, d))


STATE = "CASE kind WHEN 'purchase' THEN 'captured' WHEN 'error' THEN 'missed' ELSE 'pending' END"


@query(sql("ticks", f"SELECT contract, ts::DATE::VARCHAR AS session, CASE max(CASE {STATE} WHEN 'captured' THEN 2 WHEN 'missed' THEN 1 ELSE 0 END) WHEN 2 THEN 'captured' WHEN 1 THEN 'missed' ELSE 'pending' END AS state, count(*) AS events FROM ticks GROUP BY ALL"))
def capture_window_states(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("kind") == "purchase", "captured").when(F.col("kind") == "error", "missed").otherwise("pending")
    return L.window_states(A.ticks(spark, d).select("contract", F.to_date("ts").cast("string").alias("session"), state.alias("state")), ["contract", "session"])


@query(sql("issuances", "WITH s AS (SELECT owner, model, contract, cents FROM issuances WHERE contract % 3 = 0), stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, model ORDER BY contract) AS rn FROM s) WHERE rn = 1), a AS (SELECT * FROM (SELECT owner, model, contract, cents, row_number() OVER (PARTITION BY owner, model ORDER BY contract) AS rn FROM issuances WHERE contract % 3 > 0) WHERE rn = 1) SELECT owner, model, contract, cents FROM stored UNION ALL SELECT owner, model, contract, cents FROM a WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.owner = a.owner AND s.model = a.model)"))
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    i = A.issuances(spark, d).select("owner", "model", "contract", "cents")
    key, order = ["owner", "model"], [F.col("contract")]
    stored = L.append_new(i.limit(0), i.filter("contract % 3 = 0"), key, order)
    return L.append_new(stored, i.filter("contract % 3 > 0"), key, order)


@query(sql("issuances", "SELECT owner, contract, cents, model FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY issued_at DESC, contract DESC) AS rn FROM issuances) WHERE rn = 1"))
def latest_good_upsert(spark: SparkSession, d: str) -> DataFrame:
    i = A.issuances(spark, d).select("owner", "contract", "cents", "model", "issued_at")
    stored = L.latest(i.filter("contract % 2 = 0"), ["owner"], [F.col("issued_at"), F.col("contract")])
    return L.upsert_latest(stored, i.filter("contract % 2 = 1"), ["owner"], [F.col("issued_at"), F.col("contract")]).drop("issued_at")


ENTRIES = "entries AS (SELECT *, ask AS premium, spot AS entry, spot * (0.9::DOUBLE + l_orderkey % 21 / 100.0::DOUBLE) AS close FROM quotes WHERE bid > 0)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return A.quotes(spark, d).filter("bid > 0").withColumns({"premium": F.col("ask"), "entry": F.col("spot"), "close": F.col("spot") * (F.col("l_orderkey") % 21 / 100.0 + 0.9)})


def _grid_rows(entries: DataFrame) -> DataFrame:
    g = S.cost_grid(entries)
    return g.select(*IDS.split(", "), "haircut", "fee", "slip", M.cents(F.col("profit")).alias("profit_cents"), M.half_up(F.col("ret"), 1_000_000).alias("ret_e6"), M.half_up(F.col("excess"), 1_000_000).alias("excess_e6"))


GRID = ENTRIES + """, grid AS (SELECT e.*, h AS haircut, f AS fee, s AS slip, entry * (1 + s / 10000.0::DOUBLE) AS paid, premium * (1 - h) AS got FROM entries e, (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2)) a(h), (VALUES (0.0::DOUBLE), (0.65)) b(f), (VALUES (0), (10), (25)) c(s) WHERE side = 'call' OR s = 0),
  econ AS (SELECT *, CASE WHEN side = 'call' THEN (least(close, strike) - paid + got) * 100 ELSE (got - greatest(strike - close, 0.0::DOUBLE)) * 100 END - fee AS profit, CASE WHEN side = 'call' THEN paid * 100 ELSE strike * 100 END AS capital, CASE WHEN side = 'call' THEN (close - paid) * 100 ELSE 0.0::DOUBLE END AS benchmark, CASE WHEN side = 'call' THEN close > strike ELSE close < strike END AS assigned FROM grid)"""


@query(sql("quotes", f"WITH {GRID} SELECT {IDS}, haircut, fee, slip, {up('profit', 100)} AS profit_cents, {up('(profit / capital)', 1000000)} AS ret_e6, {up('((profit - benchmark) / capital)', 1000000)} AS excess_e6 FROM econ"))
def strategy_cost_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid_rows(_entries(spark, d))


@query(sql("quotes", f"WITH {GRID} SELECT {IDS}, haircut, fee, slip, {up('profit', 100)} AS profit_cents, {up('(profit / capital)', 1000000)} AS ret_e6, {up('((profit - benchmark) / capital)', 1000000)} AS excess_e6 FROM econ"))
def strategy_cost_grid_all(spark: SparkSession, d: str) -> DataFrame:
    return _grid_rows(_entries(spark, d))


@query(sql("quotes", f"WITH {GRID} SELECT ticker, side, haircut, fee, slip, count(*) AS n, {up('avg(profit / capital)', 1000000)} AS mean_ret, {up('avg((profit - benchmark) / capital)', 1000000)} AS mean_excess, {up('avg(assigned::INT)', 10000)} AS assigned, {up('avg((profit / capital < 0)::INT)', 10000)} AS losses, {up('quantile_disc(profit / capital, 0.05)', 1000000)} AS q05 FROM econ GROUP BY ALL"))
def strategy_summary(spark: SparkSession, d: str) -> DataFrame:
    s = S.strategy_summary(S.cost_grid(_entries(spark, d)), ["ticker", "side", "haircut", "fee", "slip"])
    big = lambda c: M.half_up(F.col(c), 1_000_000).alias(c)
    return s.select("ticker", "side", "haircut", "fee", "slip", "n", big("mean_ret"), big("mean_excess"), M.e4(F.col("assigned")).alias("assigned"), M.e4(F.col("losses")).alias("losses"), big("q05"))


@query(sql("ticks", "SELECT hour(ts) AS hour, kind, count(*) AS n, floor(avg(cents) + 0.5::DOUBLE)::BIGINT AS mean_cents FROM ticks WHERE hour(ts) IN (9, 10, 13, 15) GROUP BY ALL"))
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = A.ticks(spark, d).withColumn("hour", F.hour("ts")).filter(F.col("hour").isin(9, 10, 13, 15))
    return t.groupBy("hour", "kind").agg(F.count("*").alias("n"), F.floor(F.avg("cents") + 0.5).cast("long").alias("mean_cents"))


SCORED = f"{LAST}, s AS (SELECT i.contract, i.ticker, i.model, i.issued_at, i.probability AS p, last.itm AS y FROM issuances i JOIN last USING (contract))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    last = L.latest(_labels(spark, d), ["contract"], [F.col("checked_at"), F.col("key")])
    return S.scored(A.issuances(spark, d).join(last.select("contract", "itm"), "contract").withColumnsRenamed({"probability": "p", "itm": "y"}))


@query(sql("issuances revisions", f"WITH {SCORED} SELECT ticker, model, count(*) AS n, {up('sum((p - y::INT) * (p - y::INT))', 1000000)} AS brier_sum, {up('avg(-ln(CASE WHEN y THEN least(greatest(p, 1e-6), 1 - 1e-6) ELSE 1 - least(greatest(p, 1e-6), 1 - 1e-6) END))', 1000000)} AS log_loss FROM s GROUP BY ALL"))
def brier_log_loss(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("ticker", "model").agg(F.count("*").alias("n"), M.half_up(F.sum("brier"), 1_000_000).alias("brier_sum"), M.half_up(F.avg("log_loss"), 1_000_000).alias("log_loss"))


def _bins(n: int) -> str:
    return sql("issuances revisions", f"WITH {SCORED} SELECT model, least(greatest(floor(p * {n}), 0), {n - 1})::INT AS bin, count(*) AS n, {up('sum(p)', 1000)} AS forecast_sum, sum(y::INT)::BIGINT AS observed_sum FROM s GROUP BY ALL")


def _calibrated(spark: SparkSession, d: str, n: int) -> DataFrame:
    c = S.calibration(_scored(spark, d), ["model"], n)
    return c.select("model", "bin", "n", M.half_up(F.col("forecast") * F.col("n"), 1000).alias("forecast_sum"), M.half_up(F.col("observed") * F.col("n"), 1).alias("observed_sum"))


@query(_bins(10))
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d, 10)


@query(_bins(10))
def loss_bins(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d, 10)


@query(sql("issuances revisions", f"WITH {SCORED}, u AS (SELECT 'all' AS panel, * FROM s UNION ALL SELECT 'recent', * FROM s WHERE issued_at >= TIMESTAMP '1999-01-01') SELECT panel, model, ticker, count(*) AS n, count(DISTINCT issued_at::DATE) AS dates, {up('sum((p - y::INT) * (p - y::INT))', 1000000)} AS brier_sum, {up('sum(p - y::INT)', 1000)} AS bias_sum FROM u GROUP BY ALL"))
def forecast_descriptives(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    panels = F.when(F.col("issued_at") >= F.lit("1999-01-01").cast("timestamp_ntz"), F.array(F.lit("all"), F.lit("recent"))).otherwise(F.array(F.lit("all")))
    return s.withColumn("panel", F.explode(panels)).groupBy("panel", "model", "ticker").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("issued_at")).alias("dates"), M.half_up(F.sum("brier"), 1_000_000).alias("brier_sum"), M.half_up(F.sum(F.col("p") - F.col("y").cast("int")), 1000).alias("bias_sum"))


@query(sql("issuances revisions", f"WITH {SCORED} SELECT ticker, issued_at::DATE::VARCHAR AS date, {up('sum(CASE WHEN p > 0.1 THEN (p - y::INT) * (p - y::INT) END)', 1000000)} AS total, count(*) FILTER (p > 0.1) AS n, count(*) AS rows FROM s GROUP BY ALL"))
def paired_units(spark: SparkSession, d: str) -> DataFrame:
    u = S.unit_means(_scored(spark, d).withColumn("date", F.to_date("issued_at").cast("string")), ["ticker", "date"], "brier", F.col("p") > 0.1)
    return u.select("ticker", "date", M.half_up(F.col("mean") * F.col("n"), 1_000_000).alias("total"), "n", "rows")


TAIL = "SELECT ticker, side, floor((close / entry - 1) * 10000 + 0.5::DOUBLE)::BIGINT AS x, oi::BIGINT AS w FROM entries"


@query(sql("quotes", f"WITH {ENTRIES}, t AS ({TAIL}), a AS (SELECT ticker, side, x, sum(w) AS w FROM t GROUP BY 1, 2, 3), r AS (SELECT *, sum(w) OVER (PARTITION BY ticker, side) AS total, sum(w) OVER (PARTITION BY ticker, side ORDER BY x) AS upto FROM a), p AS (SELECT *, greatest(0.0::DOUBLE, least(w::DOUBLE, total * 0.05::DOUBLE - (upto - w)::DOUBLE)) AS part FROM r) SELECT ticker, side, min(x) FILTER (upto::DOUBLE >= total * 0.05::DOUBLE) AS quantile, {up('(sum(x * part) / sum(part))', 1000)} AS shortfall, sum(w)::BIGINT AS weight FROM p GROUP BY ALL"))
def tail_stats_weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = _entries(spark, d).select("ticker", "side", F.floor((F.col("close") / F.col("entry") - 1) * 10000 + 0.5).cast("long").alias("x"), F.col("oi").cast("long").alias("w"))
    return S.tail_stats(rows, ["ticker", "side"]).withColumn("shortfall", M.half_up(F.col("shortfall"), 1000))


@query(sql("quotes", f"WITH {GRID} SELECT ticker, side, count(*) AS n, {up('(sum(profit / capital) / sum(dte + 1))', 1000000000)} AS reward_e9, {up('quantile_cont(profit / capital, 0.5)', 1000000)} AS median_e6, {up('avg((profit / capital < 0)::INT)', 10000)} AS losses FROM econ WHERE haircut = 0.1::DOUBLE AND fee = 0.65::DOUBLE AND slip = 0 AND dte > 0 GROUP BY ALL"))
def reward_per_day(spark: SparkSession, d: str) -> DataFrame:
    g = S.cost_grid(_entries(spark, d).filter("dte > 0"), (0.1,), (0.65,), (0,)).withColumn("days", F.col("dte") + 1)
    r = S.reward_per_day(g, ["ticker", "side"])
    return r.select("ticker", "side", "n", M.half_up(F.col("reward"), 1_000_000_000).alias("reward_e9"), M.half_up(F.col("median"), 1_000_000).alias("median_e6"), M.e4(F.col("losses")).alias("losses"))


@query(sql("stocks", f"WITH v AS (SELECT DISTINCT ticker, ts, high / low - 1 AS v FROM stocks) SELECT {up('quantile_cont(v, 1 / 3.0::DOUBLE)', 1000000)} AS low, {up('quantile_cont(v, 2 / 3.0::DOUBLE)', 1000000)} AS high, count(*) AS n FROM v"))
def vol_terciles(spark: SparkSession, d: str) -> DataFrame:
    t = S.terciles(A.stocks(spark, d).withColumn("v", F.try_divide("high", "low") - 1), "v", ["ticker", "ts"])
    return t.select(M.half_up(F.col("low"), 1_000_000).alias("low"), M.half_up(F.col("high"), 1_000_000).alias("high"), "n")


@query(sql("quotes", f"WITH p AS (SELECT ticker, {IDS}, floor(bid * 100 + 0.5::DOUBLE)::BIGINT AS gain, floor(spot * 100 + 0.5::DOUBLE)::BIGINT AS cost FROM quotes) SELECT p.ticker, {IDS}, gain, cost FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.ticker = p.ticker AND q.gain >= p.gain AND q.cost <= p.cost AND (q.gain > p.gain OR q.cost < p.cost))"))
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    p = A.quotes(spark, d).select("ticker", *IDS.split(", "), F.floor(F.col("bid") * 100 + 0.5).cast("long").alias("gain"), F.floor(F.col("spot") * 100 + 0.5).cast("long").alias("cost"))
    return S.pareto(p, ["ticker"], "gain", "cost")


@query(sql("stocks cal", """WITH RECURSIVE s AS (SELECT ticker, ordinal::BIGINT AS ordinal FROM stocks JOIN cal ON session = ts), g AS (SELECT ticker, min(ordinal) AS ordinal FROM s GROUP BY 1 UNION ALL SELECT ticker, (SELECT min(s.ordinal) FROM s WHERE s.ticker = g.ticker AND s.ordinal >= g.ordinal + 6) FROM g WHERE ordinal IS NOT NULL) SELECT ticker, ordinal FROM g WHERE ordinal IS NOT NULL""").replace("WITH stocks", "WITH RECURSIVE stocks").replace(",\nRECURSIVE s AS", ",\ns AS"))
def greedy_block_dates(spark: SparkSession, d: str) -> DataFrame:
    days = A.stocks(spark, d).join(A.calendar(spark, d).withColumnRenamed("session", "ts"), "ts").select("ticker", F.col("ordinal").cast("long").alias("ordinal"))
    return S.blocked_dates(days, ["ticker"], 6)


@query()
def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    u = _scored(spark, d).select("ticker", "model", F.to_date("issued_at").alias("date"), F.col("brier").alias("value"))
    return S.bootstrap_interval(u, ["ticker", "model"])


@query()
def moving_block_ci(spark: SparkSession, d: str) -> DataFrame:
    cal = A.calendar(spark, d).withColumnRenamed("session", "ts")
    rows = A.stocks(spark, d).join(cal, "ts").select("ticker", "ordinal", (F.col("close") / F.col("open") - 1).alias("ret"), F.lit(1).alias("days"))
    return S.moving_block_interval(rows, ["ticker"])


@query(sql("dists", f"SELECT id, {up('(len(list_filter(prices, lambda x: x > 100)) / len(prices)::DOUBLE)', 10000)} AS call_e4, {up('(len(list_filter(prices, lambda x: x < 95)) / len(prices)::DOUBLE)', 10000)} AS put_e4 FROM dists"))
def dist_strict_itm(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prices")
    return A.distributions(spark, d).select("id", M.e4(D.strict_itm(p, "call", F.lit(100.0))).alias("call_e4"), M.e4(D.strict_itm(p, "put", F.lit(95.0))).alias("put_e4"))


@query(sql("dists", f"WITH u AS (SELECT id, unnest(prices) AS x FROM dists) SELECT id, {up('avg(least(x, 105.0::DOUBLE) - 100 + 2.5::DOUBLE)', 10000)} AS call_pnl, {up('avg(2.5::DOUBLE - greatest(95 - x, 0.0::DOUBLE))', 10000)} AS put_pnl, {up('avg((least(x, 105.0::DOUBLE) - 100 + 2.5::DOUBLE < 0)::INT)', 10000)} AS call_loss FROM u GROUP BY id"))
def dist_expected_pnl(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prices")
    call = lambda x: F.least(x, F.lit(105.0)) - 100 + 2.5
    put = lambda x: F.lit(2.5) - F.greatest(F.lit(95.0) - x, F.lit(0.0))
    loss = F.size(F.filter(p, lambda x: call(x) < 0)) / F.size(p)
    return A.distributions(spark, d).select("id", M.e4(D.expected(p, call)).alias("call_pnl"), M.e4(D.expected(p, put)).alias("put_pnl"), M.e4(loss).alias("call_loss"))


@query(sql("dists", f"SELECT id, {up('prices[greatest(ceil(len(prices) * 0.05::DOUBLE), 1)::INT]', 10000)} AS q05, {up('prices[greatest(ceil(len(prices) * 0.5::DOUBLE), 1)::INT]', 10000)} AS q50 FROM dists"))
def dist_left_quantile(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prices")
    return A.distributions(spark, d).select("id", M.e4(D.left_quantile(p, 0.05)).alias("q05"), M.e4(D.left_quantile(p, 0.5)).alias("q50"))


@query(sql("dists", f"WITH u AS (SELECT id, unnest(prices) AS x FROM dists), a AS (SELECT id, avg(abs(x - 101.5::DOUBLE)) AS m FROM u GROUP BY 1), b AS (SELECT u.id, avg(abs(u.x - v.x)) AS m FROM u JOIN u v ON u.id = v.id GROUP BY 1) SELECT id, {up('(a.m - b.m / 2)', 10000)} AS crps FROM a JOIN b USING (id)"))
def dist_crps(spark: SparkSession, d: str) -> DataFrame:
    return A.distributions(spark, d).select("id", M.e4(D.crps(F.col("prices"), F.lit(101.5))).alias("crps"))


@query(sql("dists", f"WITH u AS (SELECT id, 104.0::DOUBLE * exp(ln(unnest(prices) / 100) * 0.5::DOUBLE) AS x FROM dists) SELECT id, {up('avg(x)', 1000)} AS mean, {up('min(x)', 1000)} AS least, {up('max(x)', 1000)} AS most FROM u GROUP BY id"))
def dist_reanchor(spark: SparkSession, d: str) -> DataFrame:
    r = D.reanchored(F.col("prices"), F.lit(100.0), F.lit(104.0), F.lit(0.5))
    x = A.distributions(spark, d).withColumn("r", r)
    return x.select("id", M.half_up(D.expected(F.col("r"), lambda v: v), 1000).alias("mean"), M.half_up(F.array_min("r"), 1000).alias("least"), M.half_up(F.array_max("r"), 1000).alias("most"))


@query(sql("dists", "SELECT id, sha256(array_to_string(list_transform(prices, lambda x: floor(x * 10000 + 0.5::DOUBLE)::BIGINT::VARCHAR), ',')) AS digest FROM dists"))
def dist_digest(spark: SparkSession, d: str) -> DataFrame:
    return A.distributions(spark, d).select("id", D.digest(F.col("prices")).alias("digest"))


QUANTILES = ", ".join(f"{x!r}::DOUBLE" for x in D.normal_quantiles(1024))


@query(sql("stocks", f"WITH r AS (SELECT ticker, ts, close, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY ts)) AS ret FROM stocks), b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) - 1 AS back FROM r), l AS (SELECT ticker, arg_max(close, ts) AS spot, sqrt(sum(ret * ret * pow(0.94::DOUBLE, back)) FILTER (back < 60) / ((1 - pow(0.94::DOUBLE, 60)) / 0.06::DOUBLE)) AS vol FROM b GROUP BY 1 HAVING count(ret) FILTER (back < 60) = 60), u AS (SELECT ticker, unnest([{QUANTILES}]) AS z, spot, vol FROM l), p AS (SELECT ticker, spot * exp(vol * sqrt(10) * z) AS x, spot FROM u) SELECT ticker, {up('ln(avg(x) / max(spot))', 100000)} AS mean_e5, {up('ln(min(x) / max(spot))', 100000)} AS least_e5, {up('ln(max(x) / max(spot))', 100000)} AS most_e5, count(*) FILTER (x > spot * 1.05::DOUBLE) AS above FROM p GROUP BY ticker"))
def lognormal_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The distribution ten sessions ahead of every ticker with 60 returns, from its own exponentially weighted volatility; mean and ends as logarithms over the spot."""
    from strikeloom.operators.series import ewma_volatility

    last = ewma_volatility(A.stocks(spark, d)).groupBy("ticker").agg(F.max_by("close", "ts").alias("spot"), F.max_by("vol", "ts").alias("vol")).filter("vol is not null")
    p = last.withColumn("p", D.lognormal(F.col("spot"), F.col("vol"), F.lit(10)))
    log = lambda x: M.half_up(F.log(x / F.col("spot")), 100_000)
    return p.select("ticker", log(D.expected(F.col("p"), lambda x: x)).alias("mean_e5"), log(F.array_min("p")).alias("least_e5"), log(F.array_max("p")).alias("most_e5"), F.size(F.filter("p", lambda x: x > F.col("spot") * 1.05)).cast("long").alias("above"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, json_valid(props) AS valid FROM events""")
def payload_json_parse(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    parsed = F.from_json("props", "k bigint")
    return e.select("event_id", parsed["k"].alias("k"), parsed.isNotNull().alias("valid"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<[a-z/!?][^>]*>', ' ', 'g'), '&amp;?', '&', 'g'), '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '"'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS text FROM pages""")
def html_text_extract(spark: SparkSession, d: str) -> DataFrame:
    from strikeloom.functions.text import html_text

    return A.table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, regexp_extract(text, '([0-9]{4})-([0-9]{2})-([0-9]{2})', 0) AS found, len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS dates, len(regexp_extract_all(text, '[^.]+\.')) AS sentences FROM documents""")
def forward_schedule_extract(spark: SparkSession, d: str) -> DataFrame:
    from strikeloom.functions.text import dates_in, sentences

    t = F.col("text")
    return A.table(spark, d, "documents").select("doc_id", F.regexp_extract(t, r"([0-9]{4})-([0-9]{2})-([0-9]{2})", 0).alias("found"), F.size(dates_in(t)).cast("long").alias("dates"), F.size(sentences(t)).cast("long").alias("sentences"))


@query()
def sec_release_dates(spark: SparkSession, d: str) -> DataFrame:
    """Announced and actual release dates of all documents, each accepted on a day by its id and retrieved an hour later."""
    from strikeloom.functions.text import actual_results, forward_schedule

    at = F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 365).cast("int"))
    rows = A.table(spark, d, "documents").select("doc_id", "text", at.alias("at"), (at + F.make_dt_interval(hours=F.lit(1))).alias("got"))
    x = rows.select("doc_id", forward_schedule(F.col("text"), F.col("at"), F.col("got")).alias("f"), actual_results(F.col("text"), F.col("at"), F.col("got")).alias("a"))
    return x.select("doc_id", F.col("f.event_date").cast("string").alias("announced"), iso("f.event_at").alias("announced_at"), F.col("f.series_key").alias("quarter"), F.col("a.event_date").cast("string").alias("released"))
