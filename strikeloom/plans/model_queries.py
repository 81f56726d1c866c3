"""Queries over Greeks, odds, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators import boosting as B
from strikeloom.operators import history as H
from strikeloom.operators import curves as V
from strikeloom.operators import models as Mo
from strikeloom.operators import odds as O
from strikeloom.operators import regimes as R
from strikeloom.operators.quantiles import matched
from strikeloom.plans.chain_queries import CONTRACT, up
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A
from strikeloom.streaming import capture as C
from strikeloom.streaming import timers as S


@query()
def iv_greeks(spark: SparkSession, d: str) -> DataFrame:
    from strikeloom.functions.greeks import greeks

    q = A.quotes(spark, d)
    g = greeks("side", "spot", "strike", "dte", F.lit(0.04), "bid", "ask")
    return q.withColumn("g", g).select(*CONTRACT, *[F.round(F.col(f"g.{n}"), 8).alias(n) for n in ("iv", "delta", "gamma", "theta", "vega", "rho")], F.col("g.reason").alias("reason"))


CHAIN = "chain AS (SELECT ticker, strftime(expiry, '%Y-%m') AS month, strike, max(bid) AS bid, min(ask) AS ask FROM quotes WHERE side = 'call' AND bid > 0 GROUP BY 1, 2, 3)"


@query(sql("quotes", f"WITH {CHAIN}, p AS (SELECT a.ticker, a.month, a.strike AS k1, b.strike AS k2, a.bid AS b1, a.ask AS a1, b.bid AS b2, b.ask AS a2 FROM chain a JOIN chain b ON a.ticker = b.ticker AND a.month = b.month AND a.strike < b.strike), u AS (SELECT ticker, month, k2 AS strike, min((a1 - b2) / (k2 - k1)) AS x FROM p GROUP BY 1, 2, 3), l AS (SELECT ticker, month, k1 AS strike, max((b1 - a2) / (k2 - k1)) AS x FROM p GROUP BY 1, 2, 3) SELECT c.ticker, c.month, c.strike, {up('(CASE WHEN u.x IS NOT NULL THEN greatest(least(u.x, 1.0::DOUBLE), 0.0::DOUBLE) END)', 1000000)} AS upper_e6, {up('(CASE WHEN l.x IS NOT NULL THEN greatest(least(l.x, 1.0::DOUBLE), 0.0::DOUBLE) END)', 1000000)} AS lower_e6 FROM chain c LEFT JOIN u USING (ticker, month, strike) LEFT JOIN l USING (ticker, month, strike)"))
def vertical_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = O.vertical_bounds(O.strikes(A.quotes(spark, d)))
    e6 = lambda c: F.when(F.col(c).isNotNull(), M.half_up(F.col(c), 1_000_000))
    return b.select("ticker", "month", "strike", e6("upper").alias("upper_e6"), e6("lower").alias("lower_e6"))


SLOPES = CHAIN + ", m AS (SELECT *, (bid + ask) / 2 AS mid FROM chain), s AS (SELECT *, (lead(mid) OVER w - mid) / (lead(strike) OVER w - strike) AS slope FROM m WINDOW w AS (PARTITION BY ticker, month ORDER BY strike)), t AS (SELECT *, lag(slope) OVER (PARTITION BY ticker, month ORDER BY strike) AS before FROM s)"


@query(sql("quotes", f"WITH {SLOPES} SELECT ticker, month, strike, {up('slope', 1000)} AS slope, {up('(slope - before)', 1000)} AS second, {up('(-(slope + before) / 2)', 1000)} AS digital FROM t"))
def curve_slopes(spark: SparkSession, d: str) -> DataFrame:
    return O.slopes(O.strikes(A.quotes(spark, d))).select("ticker", "month", "strike", *[M.half_up(F.col(c), 1000).alias(c) for c in ("slope", "second", "digital")])


@query(sql("quotes", f"WITH {SLOPES}, p AS (SELECT ticker, month, strike, -(slope + before) / 2 AS p FROM t WHERE slope IS NOT NULL AND before IS NOT NULL), r AS (SELECT ticker, month, coalesce(p < lead(p) OVER (PARTITION BY ticker, month ORDER BY strike) - 0.001::DOUBLE, false) AS rise FROM p) SELECT ticker, month, bool_or(rise) AS broken, count(*) AS strikes FROM r GROUP BY ALL"))
def monotone_odds_guard(spark: SparkSession, d: str) -> DataFrame:
    p = O.slopes(O.strikes(A.quotes(spark, d))).filter("digital is not null").select("ticker", "month", "strike", F.col("digital").alias("p"))
    return O.monotone_guard(p)


@query()
def endpoint_iv_facts(spark: SparkSession, d: str) -> DataFrame:
    """Volatilities of bid, midpoint and ask by themselves, or the reason why one has none."""
    from strikeloom.functions.greeks import endpoint_iv

    q = A.quotes(spark, d).filter("dte > 0")
    at = lambda p: endpoint_iv("side", "spot", "strike", F.col("dte") / 365.0, F.lit(0.04), p)
    rows = q.select("l_orderkey", "l_linenumber", "l_partkey", at(F.col("bid")).alias("b"), at((F.col("bid") + F.col("ask")) / 2).alias("m"), at(F.col("ask")).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.col(f"{x}.{y}").alias(f"{n}_{y}") for x, n in (("b", "bid"), ("m", "mid"), ("a", "ask")) for y in ("tenths", "reason")])


def _chances(odds: DataFrame) -> DataFrame:
    return odds.withColumns({c: F.round(c, 5) for c in ("p", "lower", "upper")})


@query()
def curve_qp_odds(spark: SparkSession, d: str) -> DataFrame:
    """Chances of every usable quote from its expiry's nearest convex curve, or why there's none."""
    rows = R.usable(A.option_surface(spark, d)).filter("reason is null")
    return _chances(V.curve_odds(rows)).select("ticker", "expiry", "strike", "p", "lower", "upper", "reason", "held_out", "inside", "missed")


@query()
def curve_qp_counters(spark: SparkSession, d: str) -> DataFrame:
    """Of each ticker's curves: published chances, held-out quotes inside, reasons; held out are the quotes that the regime fit holds out."""
    rows = R.usable(A.option_surface(spark, d)).filter("reason is null")
    key = ["ticker", "expiry", "strike"]
    held = matched(rows, R.fit_quotes(rows).filter("held_out").select(*key, F.lit(True).alias("held_out")), key).withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    return V.curve_counters(V.curve_odds(held), ["ticker"])


@query()
def regime_odds(spark: SparkSession, d: str) -> DataFrame:
    """Chances of every contract of the surface by its ticker's regime model, or why there's none."""
    rows = R.market_odds(A.option_surface(spark, d))
    return _chances(rows).select("ticker", F.col("expiry").cast("string").alias("expiry"), "strike", "p", "lower", "upper", "reason", F.round("held_out_price", 4).alias("held_out_price"))


@query()
def regime_fits(spark: SparkSession, d: str) -> DataFrame:
    """The regime model of each ticker, its error in spreads, or why it has none."""
    good = R.usable(A.option_surface(spark, d)).filter("reason is null")
    return R.fits(R.fit_quotes(good)).select("ticker", *[F.round(c, 3).alias(c) for c in R.PARAMETERS], F.round("rms", 4).alias("rms"), "fit_reason")


def _candidate(name: str, methods: list[str]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Mo.candidates(A.stocks(spark, d), 10, methods)

    run.__name__ = name
    query()(run)


for _name, _methods in {"student_t_candidate": ["student_t"], "gjr_candidate": ["gjr"], "har_candidate": ["har"], "markov_candidate": ["markov"], "skew_candidate": ["skew_ewma"], "egarch_candidate": ["egarch"], "forecast_candidates": ["lognormal", "student_t", "gjr", "har", "skew_ewma", "egarch", "markov", "earnings_jump", "iv_physical", "ssvi", "pooled"]}.items():
    _candidate(_name, _methods)


@query()
def pooled_model(spark: SparkSession, d: str) -> DataFrame:
    """Boosted mean and deviation of each ticker's return 1, 5, 10 and 25 sessions after its last bar, learned from all tickers' training rows."""
    s = A.stocks(spark, d).withColumn("split", F.lit(0.0))
    f = B.pooled_features(s)
    rows = H.training_rows(s.select("ticker", "ts", "close", "split")).join(f.drop("ts"), ["ticker", "place"])
    model = B.train(rows, list(B.FEATURES), "target")
    last = f.groupBy("ticker").agg(F.max_by(F.struct("ts", *B.FEATURES[1:]), "ts").alias("f")).select("ticker", "f.*", F.explode(F.array(*[F.lit(float(h)) for h in (1, 5, 10, 25)])).alias("horizon"))
    out = B.priced(last, model, list(B.FEATURES))
    return out.select("ticker", F.col("ts").cast("string").alias("ts"), F.col("horizon").cast("int").alias("horizon"), F.round("mean", 8).alias("mean"), F.round("deviation", 8).alias("deviation"), "reason")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    s = C.source(spark, f"{d}/events.parquet")
    return s.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("contract"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))


@query(sql("ticks", "SELECT contract, strftime(date_trunc('hour', ts)::TIMESTAMP, '%Y-%m-%d %H') AS hour, count(*) AS n, sum(cents)::BIGINT AS cents FROM ticks GROUP BY ALL"))
def stream_hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    rows = C.drain(C.hourly(_stream(spark, d)), "update", "hourly")
    return C.latest_windows(rows, ["contract", "start"], ["n", "cents"]).select("contract", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", "cents")


@query(sql("ticks", "SELECT contract, ts::DATE::VARCHAR AS session, CASE max(CASE kind WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 ELSE 0 END) WHEN 2 THEN 'captured' WHEN 1 THEN 'missed' ELSE 'pending' END AS state, count(*) AS events FROM ticks GROUP BY ALL"))
def stream_capture_windows(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("kind") == "purchase", "captured").when(F.col("kind") == "error", "missed").otherwise("pending")
    events = _stream(spark, d).select("contract", F.to_date("at").cast("string").alias("session"), state.alias("state"))
    return C.latest_windows(C.drain(C.capture_states(events), "update", "capture"), ["contract", "session"], ["state", "events"])


@query(sql("ticks", "SELECT DISTINCT contract, kind, ts::DATE::VARCHAR AS session FROM ticks"))
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    events = _stream(spark, d).withColumn("session", F.to_date("at").cast("string"))
    return C.drain(C.deduplicated(events, ["contract", "kind", "session"], "40 days").select("contract", "kind", "session"), "append", "dedup").drop("batch")


TIMED = """t AS (SELECT contract, arg_min(ms + (row_id % 48) * 3600000, (ms, row_id)) AS expiry FROM e WHERE kind = 'signup' GROUP BY contract), u AS (SELECT max(ms) - 60000 AS until FROM e),
  said AS (SELECT contract, CASE kind WHEN 'purchase' THEN 1 ELSE 2 END AS source, ms, row_id, 100 + (row_id % 3) * 0.004::DOUBLE AS close FROM e WHERE kind IN ('purchase', 'view')),
  span AS (SELECT contract, source, close, ms, coalesce(lead(ms) OVER (PARTITION BY contract, source ORDER BY ms, row_id), 1::BIGINT << 60) AS upto FROM said),
  c AS (SELECT contract, expiry, expiry AS due, 1 AS revision FROM t, u WHERE expiry <= until
        UNION ALL SELECT c.contract, c.expiry, c.due + CASE WHEN abs(a.close - b.close) <= 0.005::DOUBLE THEN 86400000 ELSE 3600000 END, c.revision + 1
        FROM c LEFT JOIN span a ON a.contract = c.contract AND a.source = 1 AND a.ms <= c.due AND c.due < a.upto LEFT JOIN span b ON b.contract = c.contract AND b.source = 2 AND b.ms <= c.due AND c.due < b.upto, u
        WHERE c.due + CASE WHEN abs(a.close - b.close) <= 0.005::DOUBLE THEN 86400000 ELSE 3600000 END <= least(until, c.expiry + 259200000))"""


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS row_id, user_id AS contract, event_type AS kind, epoch_us(ts) // 1000 AS ms FROM events), {TIMED}
SELECT c.contract, c.due AS checked_at, c.revision::BIGINT AS revision, CASE WHEN a.close IS NULL OR b.close IS NULL THEN 'pending' WHEN abs(a.close - b.close) > 0.005::DOUBLE THEN 'excluded' ELSE 'valid' END AS status,
  CASE WHEN a.close IS NULL THEN 'no_first_source' WHEN b.close IS NULL THEN 'no_second_source' WHEN abs(a.close - b.close) > 0.005::DOUBLE THEN 'sources_disagree' END AS reason, CASE WHEN abs(a.close - b.close) <= 0.005::DOUBLE THEN round(a.close * 1000)::BIGINT END AS close_mills
FROM c LEFT JOIN span a ON a.contract = c.contract AND a.source = 1 AND a.ms <= c.due AND c.due < a.upto LEFT JOIN span b ON b.contract = c.contract AND b.source = 2 AND b.ms <= c.due AND c.due < b.upto""")
def stream_label_timers(spark: SparkSession, d: str) -> DataFrame:
    """Every check of every contract's label: at its expiry, an hour after a failure, a day after a success, for three days."""
    e = C.source(spark, f"{d}/events.parquet")
    source = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    at = F.col("ts").cast("timestamp")
    rows = e.select(F.col("user_id").alias("contract"), at.alias("at"), F.col("event_id").alias("row"), source.alias("source"), (100 + F.col("event_id") % 3 * 0.004).alias("close"), (F.unix_millis(at) + F.col("event_id") % 48 * S.HOUR).alias("expiry"))
    labels = S.drained(S.label_checks(rows), "label-timers")
    return labels.select("contract", "checked_at", "revision", "status", "reason", F.round(F.col("close") * 1000).cast("long").alias("close_mills"))


FANNED = ["lognormal", "gjr", "student_t", "iv_physical", "earnings_jump"]


@query(f"""WITH e AS (SELECT event_id AS row_id, user_id AS contract, 'T' || (user_id % 9) AS ticker, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'error' THEN event_type END AS data_hash, event_id % 40 AS horizon FROM events),
f AS (SELECT ticker, arg_max(data_hash, (ms, row_id)) FILTER (data_hash IS NOT NULL) AS fitted FROM e GROUP BY 1), m AS (SELECT unnest({FANNED!r}) AS method),
k AS (SELECT ticker, method, CASE WHEN method <> 'gjr' THEN fitted END AS fitted, CASE WHEN method = 'gjr' THEN 'gjr_history_short' END AS why FROM f, m WHERE method IN ('lognormal', 'gjr') OR method = 'student_t' AND ticker < 'T5'),
w AS (SELECT *, ms // 86400000 AS w, row_number() OVER (PARTITION BY ticker, ms // 86400000, contract, data_hash ORDER BY ms, row_id) AS again FROM e),
r AS (SELECT *, CASE WHEN again = 1 THEN sum((again = 1)::INT) OVER (PARTITION BY ticker, w ORDER BY ms, contract, row_id) END AS place FROM w),
x AS (SELECT r.*, m.method, CASE WHEN again > 1 THEN 'already_captured' WHEN place > 8 THEN 'shadow_capacity_exceeded' WHEN data_hash IS NULL THEN 'completed_close_forecast_unavailable' WHEN horizon > 25 AND m.method <> 'lognormal' THEN 'candidate_horizon_unsupported'
  WHEN m.method = 'iv_physical' THEN 'rights_cleared_option_history_unavailable' WHEN m.method = 'earnings_jump' THEN 'verified_release_time_history_unavailable' WHEN k.method IS NULL OR k.fitted IS NULL AND k.why IS NULL THEN 'candidate_not_prepared' WHEN k.why IS NOT NULL THEN k.why WHEN k.fitted <> data_hash THEN 'input_vintage_changed' END AS reason
  FROM r CROSS JOIN m LEFT JOIN k ON k.ticker = r.ticker AND k.method = m.method)
SELECT ticker, contract, row_id AS row, method, CASE WHEN reason = 'shadow_capacity_exceeded' THEN 'capacity' WHEN reason IS NULL THEN 'issued' ELSE 'rejected' END AS outcome, reason FROM x""")
def stream_capture_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a capture attempt, fanned out to five methods: eight different ones a ticker and day, the others as capacity rows or repeats."""
    ticker = F.concat(F.lit("T"), (F.col("user_id") % 9).cast("string"))
    data = F.when(F.col("event_type") != "error", F.col("event_type"))
    shape = lambda e: e.select(F.col("user_id").alias("contract"), ticker.alias("ticker"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("row"), data.alias("data_hash"), (F.col("event_id") % 40).alias("horizon"))
    fitted = shape(A.table(spark, d, "events")).filter("data_hash is not null").groupBy("ticker").agg(F.max_by("data_hash", F.struct("at", "row")).alias("fitted"))
    fitted = fitted.withColumn("method", F.explode(F.array(*[F.lit(m) for m in FANNED[:3]]))).filter("method != 'student_t' or ticker < 'T5'")
    fitted = fitted.select("ticker", "method", F.when(F.col("method") != "gjr", F.col("fitted")).alias("data_hash"), F.when(F.col("method") == "gjr", "gjr_history_short").alias("fit_reason"))
    rows = S.drained(S.fanned_out(shape(C.source(spark, f"{d}/events.parquet")), fitted, FANNED, window=S.DAY), "capture-fan-out")
    return rows.select("ticker", "contract", "row", "method", "outcome", "reason")
