"""Queries of paired inference, contests, calibration evidence and wheel rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators import inference as I
from strikeloom.plans.chain_queries import up
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A

BASELINE, METRICS = "lognormal_ewma", ["brier", "crps"]

#: Scores of three models on the cells of all orders, with gaps, repeats and unknown values.
SCORES = """scores AS (SELECT o_orderkey AS seq, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'primary' ELSE 'supplement' END AS panel, o_orderpriority AS ticker, o_orderdate::DATE AS origin, (o_orderkey % 25 + 1)::INT AS horizon,
  o_orderdate::DATE + (o_orderkey % 25 + 1)::INT AS expiry, o_orderkey % 4 AS contract, model, o_orderkey % 6 > 0 AS eligible, o_custkey % 3 = 0 AS itm, (o_orderkey * (7 + 2 * k) + 13 * k) % 1000 / 1000.0::DOUBLE AS p,
  ((o_orderkey * (7 + 2 * k) + 13 * k) % 1000 / 1000.0::DOUBLE - (o_custkey % 3 = 0)::INT) ** 2 AS brier, CASE WHEN o_orderkey % 9 <> k THEN (o_orderkey * (3 + k)) % 97 / 97.0::DOUBLE END AS crps, o_orderdate + to_seconds(o_orderkey % 50) AS issued, CASE WHEN (o_orderkey + k) % 10 > 0 THEN 'v' || (o_orderkey % 2) END AS vintage
  FROM orders, (VALUES (0, 'lognormal_ewma'), (1, 'student_t'), (2, 'har')) m(k, model) WHERE (o_orderkey + k) % 7 > 0)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    o = A.table(spark, d, "orders")
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("model")) for k, n in enumerate((BASELINE, "student_t", "har"))])
    o = o.select("*", F.explode(names).alias("m")).select("*", "m.*").filter((F.col("o_orderkey") + F.col("k")) % 7 > 0)
    key, k = F.col("o_orderkey"), F.col("k")
    horizon = (key % 25 + 1).cast("int")
    p = (key * (7 + 2 * k) + 13 * k) % 1000 / 1000.0
    itm = F.col("o_custkey") % 3 == 0
    origin = F.to_date("o_orderdate")
    return o.select(
        key.alias("seq"), F.when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "primary").otherwise("supplement").alias("panel"), F.col("o_orderpriority").alias("ticker"), origin.alias("origin"), horizon.alias("horizon"),
        F.date_add(origin, horizon).alias("expiry"), (key % 4).alias("contract"), "model", (key % 6 > 0).alias("eligible"), itm.alias("itm"), p.alias("p"), ((p - itm.cast("int")) * (p - itm.cast("int"))).alias("brier"),
        F.when(key % 9 != k, (key * (3 + k)) % 97 / 97.0).alias("crps"), (F.col("o_orderdate") + F.make_dt_interval(secs=key % 50)).alias("issued"), F.when((key + k) % 10 > 0, F.concat(F.lit("v"), (key % 2).cast("string"))).alias("vintage"),
    )


PAIRS = f"""once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel, ticker, origin, expiry, horizon, contract, model ORDER BY seq) AS rn FROM scores WHERE eligible) WHERE rn = 1),
pairs AS (SELECT c.*, b.brier AS base_brier, b.crps AS base_crps FROM once c JOIN once b USING (panel, ticker, origin, expiry, horizon, contract) WHERE c.model <> '{BASELINE}' AND b.model = '{BASELINE}'),
long AS (SELECT *, 'brier' AS metric, brier AS c, base_brier AS b FROM pairs UNION ALL SELECT *, 'crps', crps, base_crps FROM pairs),
units AS (SELECT panel, model, ticker, origin, horizon, metric, min(expiry) AS expiry, avg(c) AS candidate, avg(b) AS baseline, count(*) AS cells FROM long WHERE c IS NOT NULL AND b IS NOT NULL GROUP BY panel, model, ticker, origin, horizon, metric)"""
PLAN = """panels AS (SELECT session, CASE WHEN session < DATE '1999-01-01' THEN 'primary' ELSE 'supplement' END AS panel FROM cal),
numbered AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY session) - 1 AS n, count(*) OVER (PARTITION BY panel) AS total FROM panels),
edge AS (SELECT panel, session AS boundary FROM numbered WHERE n = floor(total * 0.75)),
plan AS (SELECT panel, band, session AS origin, boundary FROM numbered JOIN edge USING (panel), (VALUES ('1', 2), ('2-5', 6), ('6-25', 26)) g(band, gap) WHERE n % gap = 0),
placed AS (SELECT *, CASE WHEN expiry < boundary THEN 'development' WHEN origin >= boundary THEN 'holdout' END AS period FROM (SELECT *, CASE WHEN horizon = 1 THEN '1' WHEN horizon <= 5 THEN '2-5' ELSE '6-25' END AS band FROM units) JOIN plan USING (panel, band, origin))"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    return I.units(I.pairs(_scores(spark, d), BASELINE, METRICS), METRICS)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    panel = F.when(F.col("session") < F.lit("1999-01-01").cast("date"), "primary").otherwise("supplement")
    return I.schedule(A.calendar(spark, d).select(panel.alias("panel"), "session"))


@query(sql("", f"WITH {SCORES}, {PAIRS} SELECT panel, model, ticker, origin::VARCHAR AS origin, horizon, metric, expiry::VARCHAR AS expiry, {up('candidate', 1000000)} AS candidate_e6, {up('baseline', 1000000)} AS baseline_e6, cells FROM units"))
def challenger_units(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("panel", "model", "ticker", F.col("origin").cast("string").alias("origin"), "horizon", "metric", F.col("expiry").cast("string").alias("expiry"), M.half_up(F.col("candidate"), 1_000_000).alias("candidate_e6"), M.half_up(F.col("baseline"), 1_000_000).alias("baseline_e6"), "cells")


@query(sql("cal", f"WITH {PLAN[: PLAN.index(',' + chr(10) + 'placed AS')]} SELECT panel, band, origin::VARCHAR AS origin, boundary::VARCHAR AS boundary FROM plan"))
def holdout_boundary(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).withColumns({c: F.col(c).cast("string") for c in ("origin", "boundary")})


@query(sql("cal", f"WITH {SCORES}, {PAIRS}, {PLAN} SELECT panel, band, period, metric, model, count(*) AS units, count(DISTINCT origin) AS dates, sum(cells)::BIGINT AS cells, {up('avg(candidate)', 100000)} AS candidate_e5, {up('avg(baseline)', 100000)} AS baseline_e5 FROM placed WHERE period IS NOT NULL GROUP BY ALL"))
def forecast_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = I.in_periods(_units(spark, d), _plan(spark, d))
    return rows.groupBy("panel", "band", "period", "metric", "model").agg(F.count("*").alias("units"), F.count_distinct("origin").alias("dates"), F.sum("cells").alias("cells"), M.half_up(F.avg("candidate"), 100_000).alias("candidate_e5"), M.half_up(F.avg("baseline"), 100_000).alias("baseline_e5"))


@query()
def forecast_inference(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of all comparisons; Brier on the primary holdout with the tail of seven."""
    group = ["panel", "band", "period", "metric", "model"]
    rows = I.in_periods(_units(spark, d), _plan(spark, d)).withColumn("delta", F.col("candidate") - F.col("baseline"))
    adjusted = (F.col("panel") == "primary") & (F.col("period") == "holdout") & (F.col("metric") == "brier")
    return I.paired_interval(I.by_date(rows, group), group, adjusted)


#: Trades of wheel rules: lines of orders that end after they begin.
WHEEL = """trades AS (SELECT l_orderkey AS key, l_linenumber AS line, p_brand AS ticker, CASE WHEN l_returnflag = 'A' THEN 'call' ELSE 'put' END AS side, p_retailprice AS strike, p_retailprice * (l_tax * 5 + 0.8::DOUBLE) AS spot, p_retailprice * l_discount / 5 AS mark, o_orderdate::DATE AS origin, l_shipdate::DATE AS expiry, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) + 1 AS days,
  ((l_orderkey * 31 + l_linenumber * 17) % 401 - 180) / 1000.0::DOUBLE AS ret, (l_orderkey * 13 % 301 - 140) / 1000.0::DOUBLE AS baseline_ret, l_linenumber % 4 > 0 AS traded, 'rule' || (l_partkey % 12) AS rule, (l_orderkey * 7 % 100) / 100.0::DOUBLE AS cushion,
  CASE WHEN l_partkey % 11 > 0 THEN (l_partkey % 100) / 100.0::DOUBLE END AS volatility20, 0.3::DOUBLE AS low, 0.6::DOUBLE AS high, CASE WHEN l_suppkey % 8 > 0 THEN (l_suppkey % 21 - 10) / 100.0::DOUBLE END AS return20, l_suppkey % 12 AS transactions, l_quantity AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate::DATE >= o_orderdate::DATE)"""


def _trades(spark: SparkSession, d: str) -> DataFrame:
    li, p, o = (A.table(spark, d, n) for n in ("lineitem", "part", "orders"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey")).filter(F.to_date("l_shipdate") >= F.to_date("o_orderdate"))
    key, line, part, supp, price = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("p_retailprice")
    return rows.select(
        key.alias("key"), line.alias("line"), F.col("p_brand").alias("ticker"), F.when(F.col("l_returnflag") == "A", "call").otherwise("put").alias("side"), price.alias("strike"), (price * (F.col("l_tax") * 5 + 0.8)).alias("spot"), (price * F.col("l_discount") / 5).alias("mark"),
        F.to_date("o_orderdate").alias("origin"), F.to_date("l_shipdate").alias("expiry"), (F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) + 1).alias("days"), (((key * 31 + line * 17) % 401 - 180) / 1000.0).alias("ret"), ((key * 13 % 301 - 140) / 1000.0).alias("baseline_ret"),
        (line % 4 > 0).alias("traded"), F.concat(F.lit("rule"), (part % 12).cast("string")).alias("rule"), ((key * 7 % 100) / 100.0).alias("cushion"), F.when(part % 11 > 0, (part % 100) / 100.0).alias("volatility20"), F.lit(0.3).alias("low"), F.lit(0.6).alias("high"),
        F.when(supp % 8 > 0, (supp % 21 - 10) / 100.0).alias("return20"), (supp % 12).alias("transactions"), F.col("l_quantity").alias("volume"),
    )


@query()
def strategy_inference(spark: SparkSession, d: str) -> DataFrame:
    """Excess returns of every rule and side by panel, band and period, on the bands' schedules."""
    rows = _trades(spark, d).withColumn("horizon", F.col("days") - 1).filter(F.col("horizon").between(1, 25) & F.col("traded"))
    rows = rows.withColumn("panel", F.when(F.col("origin") < F.lit("1999-01-01").cast("date"), "primary").otherwise("supplement"))
    group = ["panel", "band", "period", "rule", "side"]
    units = I.in_periods(rows, _plan(spark, d)).groupBy(*group, "ticker", "origin").agg(F.avg(F.col("ret") - F.col("baseline_ret")).alias("delta"))
    return I.paired_interval(I.by_date(units, group), group, F.lit(False))


CONDITIONS = """each AS (SELECT t.*, condition, CASE condition WHEN 'volatility_low' THEN volatility20 <= low WHEN 'volatility_middle' THEN volatility20 > low AND volatility20 <= high WHEN 'volatility_high' THEN volatility20 > high WHEN 'trend_positive' THEN return20 > 0 WHEN 'trend_other' THEN return20 <= 0 ELSE transactions >= 5 AND volume >= 20 END AS holds
  FROM trades t, (VALUES ('volatility_low'), ('volatility_middle'), ('volatility_high'), ('trend_positive'), ('trend_other'), ('active')) c(condition))"""


@query(sql("", f"WITH {WHEEL}, {CONDITIONS} SELECT rule, condition, count(*) AS n, count(*) FILTER (holds AND traded) AS traded, {up('sum(CASE WHEN holds THEN ret ELSE baseline_ret END)', 1000)} AS ret_sum FROM each WHERE holds IS NOT NULL GROUP BY ALL"))
def wheel_conditions(spark: SparkSession, d: str) -> DataFrame:
    return I.conditional(_trades(spark, d)).groupBy("rule", "condition").agg(F.count("*").alias("n"), F.count_if("traded").alias("traded"), M.half_up(F.sum("ret"), 1000).alias("ret_sum"))


DAYNAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
RULES = f"""metrics AS (SELECT rule, side, count(*) AS dates, count(DISTINCT expiry) AS expiries, count(*) FILTER (traded) AS traded, count(DISTINCT expiry) FILTER (traded) AS traded_expiries, sum(ret) / sum(days) AS reward, quantile_cont(ret, 0.5) AS median, avg((ret < 0)::INT) AS losses, sum(ret - baseline_ret) / sum(days) AS excess, avg(traded::INT) AS participation, quantile_cont(cushion, [0.25, 0.5, 0.75]) FILTER (traded) AS q,
  {', '.join(f"count(*) FILTER (isodow(origin) = {i + 1}) AS {n}" for i, n in enumerate(DAYNAMES))} FROM trades GROUP BY rule, side)"""


@query(sql("", f"WITH {WHEEL}, {RULES} SELECT rule, side, dates, expiries, traded, traded_expiries, {up('reward', 1000000000)} AS reward_e9, {up('median', 1000000)} AS median_e6, {up('losses', 10000)} AS losses, {up('excess', 1000000000)} AS excess_e9, {up('participation', 10000)} AS participation, {up('q[1]', 10000)} AS q1, {up('q[2]', 10000)} AS q2, {up('q[3]', 10000)} AS q3, {', '.join(DAYNAMES)} FROM metrics"))
def wheel_rule_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = I.rule_metrics(_trades(spark, d), ["rule", "side"])
    q = [M.half_up(F.col("cushion_quartiles")[i], 10_000).alias(f"q{i + 1}") for i in range(3)]
    return m.select("rule", "side", "dates", "expiries", "traded", "traded_expiries", M.half_up(F.col("reward"), 1_000_000_000).alias("reward_e9"), M.half_up(F.col("median"), 1_000_000).alias("median_e6"), M.half_up(F.col("losses"), 10_000).alias("losses"), M.half_up(F.col("excess"), 1_000_000_000).alias("excess_e9"), M.half_up(F.col("participation"), 10_000).alias("participation"), *q, *DAYNAMES)


STATS = "stats AS (SELECT ticker, rule || side AS rule, count(*) AS dates, count(*) FILTER (traded) AS traded, count(DISTINCT expiry) AS expiries, count(DISTINCT expiry) FILTER (traded) AS traded_expiries, floor(sum(ret) / sum(days) * 100000 + 0.5::DOUBLE) AS reward, floor(-min(ret) * 100 + 0.5::DOUBLE) AS tail_loss, floor(avg((ret < 0)::INT) * 100 + 0.5::DOUBLE) AS losses FROM trades GROUP BY ALL)"


@query(sql("", f"""WITH {WHEEL}, {STATS},
  able AS (SELECT * FROM stats WHERE dates >= 20 AND traded >= 20 AND expiries >= 4 AND traded_expiries >= 4 AND reward > 0 AND tail_loss >= 0),
  points AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, reward, tail_loss ORDER BY losses, -dates, rule) AS rn FROM able) WHERE rn = 1),
  front AS (SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.ticker = p.ticker AND o.reward >= p.reward AND o.tail_loss <= p.tail_loss AND (o.reward > p.reward OR o.tail_loss < p.tail_loss))),
  placed AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY reward, losses, -dates, rule) AS place, count(*) OVER (PARTITION BY ticker) AS size, row_number() OVER (PARTITION BY ticker ORDER BY tail_loss, losses, -dates, rule) AS safest FROM front)
  SELECT ticker, max(rule) FILTER (safest = 1) AS conservative, max(rule) FILTER (place = (size - 1) // 2 + 1) AS balanced, max(rule) FILTER (place = size) AS higher_return FROM placed GROUP BY ticker"""))
def wheel_representatives(spark: SparkSession, d: str) -> DataFrame:
    t = _trades(spark, d).withColumn("rule", F.concat("rule", "side"))
    up_ = lambda x, n: F.floor(x * n + 0.5).cast("double")
    stats = t.groupBy("ticker", "rule").agg(F.count("*").alias("dates"), F.count_if("traded").alias("traded"), F.count_distinct("expiry").alias("expiries"), F.count_distinct(F.when(F.col("traded"), F.col("expiry"))).alias("traded_expiries"), up_(F.sum("ret") / F.sum("days"), 100_000).alias("reward"), up_(-F.min("ret"), 100).alias("tail_loss"), up_(F.avg((F.col("ret") < 0).cast("int")), 100).alias("losses"))
    return I.representatives(stats, ["ticker"])


DATED = "dated AS (SELECT rule, origin, sum(ret) AS ret, sum(days)::BIGINT AS days FROM trades GROUP BY rule, origin)"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    rows = _trades(spark, d).groupBy("rule", "origin").agg(F.sum("ret").alias("ret"), F.sum("days").alias("days"))
    cal = A.calendar(spark, d).select(F.col("session").alias("origin"), (F.col("ordinal") - 1).alias("ordinal"))
    return I.matched_rules(rows.join(cal, "origin"), [])


@query(sql("", f"WITH {WHEEL}, {DATED} SELECT a.rule, b.rule AS other_rule, count(*) AS dates, {up('(sum(a.ret) / sum(a.days) - sum(b.ret) / sum(b.days))', 1000000)} AS delta_e6 FROM dated a JOIN dated b ON a.origin = b.origin AND a.rule < b.rule GROUP BY ALL"))
def matched_rule_dates(spark: SparkSession, d: str) -> DataFrame:
    return _dated(spark, d).groupBy("rule", "other_rule").agg(F.count("*").alias("dates"), M.half_up(F.sum("ret") / F.sum("days") - F.sum("other_ret") / F.sum("other_days"), 1_000_000).alias("delta_e6"))


@query()
def wheel_block_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the differences of every two rules from moving calendar blocks."""
    return I.block_comparison(_dated(spark, d), A.calendar(spark, d), ["rule", "other_rule"])


@query(sql("", f"WITH {WHEEL} SELECT ticker, CASE WHEN NOT traded THEN 'cancelled' ELSE 'entered' END AS kind, count(*) AS n, {up('avg((line % 3 = 0)::INT)', 10000)} AS no_entry, {up('avg((line % 6 = 0)::INT)', 10000)} AS known, {up('avg((line % 3 = 0)::INT - (line % 6 = 0)::INT)', 10000)} AS missing FROM trades GROUP BY ALL"))
def entry_rates(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    rows = _trades(spark, d).select("ticker", F.when(~F.col("traded"), "cancelled").otherwise("entered").alias("kind"), F.when(line % 3 == 0, "no_entry").otherwise("scored").alias("status"), F.when(line % 6 == 0, "opening_moneyness_changed").alias("reason"))
    r = I.entry_rates(rows, ["ticker", "kind"])
    return r.select("ticker", "kind", "n", M.half_up(F.col("no_entry"), 10_000).alias("no_entry"), M.half_up(F.col("cancelled"), 10_000).alias("known"), M.half_up(F.col("missing"), 10_000).alias("missing"))


@query(sql("", f"WITH {WHEEL} SELECT CASE WHEN panel = 'primary' THEN CASE WHEN expiry < DATE '1998-01-01' THEN 'development' WHEN origin >= DATE '1998-01-01' THEN 'holdout' ELSE 'purged' END WHEN panel = 'supplement' THEN 'supplement' ELSE 'other_eligible' END AS period, count(*) AS n FROM (SELECT *, CASE WHEN origin < DATE '1999-01-01' THEN 'primary' WHEN origin < DATE '2000-06-01' THEN 'supplement' ELSE 'rest' END AS panel FROM trades) GROUP BY ALL"))
def wheel_periods(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("date")
    panel = F.when(F.col("origin") < at("1999-01-01"), "primary").when(F.col("origin") < at("2000-06-01"), "supplement").otherwise("rest")
    return _trades(spark, d).groupBy(I.period_of(panel, F.col("origin"), F.col("expiry"), at("1998-01-01")).alias("period")).agg(F.count("*").alias("n"))


FEATURES = ["depth", "intrinsic", "time_value", "premium_yield", "time_value_yield", "cushion", "capped_return"]


@query(sql("", f"""WITH {WHEEL}, f AS (SELECT *, CASE WHEN side = 'call' THEN greatest(spot - strike, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS intrinsic, CASE WHEN side = 'call' THEN spot ELSE strike END AS capital, mark * 0.9::DOUBLE - 0.0065::DOUBLE AS net FROM trades)
  SELECT key, line, {', '.join(f"{up(e, 100000)} AS {n}" for n, e in zip(FEATURES, ["(1 - strike / spot)", "intrinsic", "(mark - intrinsic)", "(mark / capital)", "((mark - intrinsic) / capital)", "(1 - (CASE WHEN side = 'call' THEN spot ELSE strike END - net) / spot)", "((net - intrinsic) / capital)"], strict=True))} FROM f"""))
def decision_features(spark: SparkSession, d: str) -> DataFrame:
    return I.decision_features(_trades(spark, d)).select("key", "line", *[M.half_up(F.col(c), 100_000).alias(c) for c in FEATURES])


LOWS = "path AS (SELECT *, spot * 1.01::DOUBLE AS entry, spot * (0.9::DOUBLE + line * 0.03::DOUBLE) AS close, mark AS premium, CASE WHEN key % 5 = 0 THEN [spot * 0.97::DOUBLE, NULL] WHEN key % 5 = 1 THEN [] ELSE [spot * 0.97::DOUBLE, spot * (0.85::DOUBLE + line * 0.03::DOUBLE)] END AS lows FROM trades)"


@query(sql("", f"""WITH {WHEEL}, {LOWS}, a AS (SELECT *, CASE WHEN traded THEN premium * 0.9::DOUBLE * 100 - 0.65::DOUBLE ELSE 0.0::DOUBLE END AS net, CASE WHEN traded THEN CASE WHEN side = 'call' THEN close > strike ELSE close < strike END END AS itm FROM path),
  b AS (SELECT *, CASE WHEN traded THEN CASE WHEN side = 'call' THEN NOT itm ELSE itm END ELSE side = 'call' END AS holds, CASE WHEN traded THEN CASE WHEN side = 'call' THEN entry ELSE strike END - net / 100 WHEN side = 'call' THEN entry END AS even, len(lows) > 0 AND len(list_filter(lows, lambda x: x IS NULL)) = 0 AND (traded OR side = 'call') AS whole FROM a)
  SELECT key, line, {up('net', 100)} AS net_cents, itm, CASE WHEN holds THEN 100 ELSE 0 END AS shares, {up('(net + CASE WHEN holds THEN 0.0::DOUBLE ELSE 100 * strike END)', 100)} AS cash_cents, CASE WHEN traded AND close = strike THEN 'atm_ambiguous' WHEN holds THEN 'shares' ELSE 'cash' END AS state, CASE WHEN whole THEN {up('least(0.0::DOUBLE, list_min(lows) / entry - 1)', 100000)} END AS min_return_e5, CASE WHEN whole THEN list_min(lows) < even END AS breached FROM b"""))
def wheel_expiry_state(spark: SparkSession, d: str) -> DataFrame:
    spot, line, key = F.col("spot"), F.col("line"), F.col("key")
    none = F.lit(None).cast("double")
    lows = F.when(key % 5 == 0, F.array(spot * 0.97, none)).when(key % 5 == 1, F.array().cast("array<double>")).otherwise(F.array(spot * 0.97, spot * (0.85 + line * 0.03)))
    rows = _trades(spark, d).withColumns({"entry": spot * 1.01, "close": spot * (0.9 + line * 0.03), "premium": F.col("mark"), "lows": lows})
    s = I.expiry_state(rows)
    return s.select("key", "line", M.half_up(F.col("net_premium"), 100).alias("net_cents"), "itm", "shares", M.half_up(F.col("cash"), 100).alias("cash_cents"), "state", M.half_up(F.col("min_return"), 100_000).alias("min_return_e5"), "breached")


CONTEST = """contest AS (SELECT *, model AS method, CASE WHEN seq % 17 > 0 THEN p + (seq % 101 = 0)::INT END AS probability, CASE WHEN seq % 34 = 0 THEN 'stale_input' END AS reason, CASE WHEN seq % 23 > 0 THEN itm <> (seq % 29 = 0 AND model = 'har') END AS seen FROM scores),
  base AS (SELECT * FROM contest WHERE method = 'lognormal_ewma'),
  chosen AS (SELECT ticker, origin, horizon, vintage AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY ticker, origin, horizon ORDER BY issued, seq) AS rn FROM base) WHERE rn = 1),
  own AS (SELECT c.*, chosen, h.ticker IS NOT NULL AS has FROM contest c LEFT JOIN chosen h USING (ticker, origin, horizon) WHERE method IN ('lognormal_ewma', 'har')),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, origin, horizon, contract, method ORDER BY issued, seq) AS rn FROM own WHERE has AND vintage IS NOT DISTINCT FROM chosen AND (method = 'lognormal_ewma' OR vintage IS NOT NULL)) WHERE rn = 1),
  b AS (SELECT * FROM kept WHERE method = 'lognormal_ewma'), c AS (SELECT * FROM kept WHERE method = 'har'),
  judged AS (SELECT coalesce(b.ticker, c.ticker) AS ticker, coalesce(b.origin, c.origin) AS origin, coalesce(b.horizon, c.horizon) AS horizon, coalesce(b.contract, c.contract) AS contract,
    CASE WHEN b.ticker IS NULL THEN 'baseline_not_issued' WHEN b.probability IS NULL THEN coalesce(b.reason, 'baseline_unavailable') WHEN c.probability IS NULL AND b.vintage IS NULL THEN 'input_vintage_missing' WHEN c.ticker IS NULL THEN 'candidate_not_issued' WHEN c.probability IS NULL THEN coalesce(c.reason, 'unavailable')
      WHEN b.seen IS NULL OR c.seen IS NULL OR b.seen <> c.seen THEN 'unscorable_or_conflicting_label' WHEN NOT b.probability BETWEEN 0 AND 1 OR NOT c.probability BETWEEN 0 AND 1 THEN 'invalid_probability' ELSE 'scored' END AS outcome, b.probability AS pb, c.probability AS pc, b.seen AS seen FROM b FULL JOIN c USING (ticker, origin, horizon, contract)),
  outcomes AS (SELECT * FROM judged UNION ALL SELECT DISTINCT ticker, origin, horizon, contract, 'baseline_not_issued', NULL::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN FROM own WHERE method = 'har' AND NOT has)"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    rows = _scores(spark, d).select("ticker", "origin", "horizon", "contract", F.col("model").alias("method"), "issued", "seq", "vintage", F.when(s % 17 > 0, F.col("p") + (s % 101 == 0).cast("int")).alias("probability"), F.when(s % 34 == 0, "stale_input").alias("reason"), F.when(s % 23 > 0, F.col("itm") != ((s % 29 == 0) & (F.col("model") == "har"))).alias("itm"))
    return I.evaluated(rows, BASELINE, "har")


@query(sql("", f"WITH {SCORES}, {CONTEST} SELECT ticker, outcome, count(*) AS n FROM outcomes GROUP BY ALL"))
def contest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).groupBy("ticker", "outcome").agg(F.count("*").alias("n"))


CLIP = "least(greatest({0}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"
LOSS = "-ln(CASE WHEN seen THEN {0} ELSE 1 - {0} END)"


@query(sql("", f"WITH {SCORES}, {CONTEST} SELECT ticker, origin::VARCHAR AS origin, horizon, {up('avg((pc - seen::INT) ** 2 - (pb - seen::INT) ** 2)', 100000)} AS brier_e5, {up('avg(' + LOSS.format(CLIP.format('pc')) + ' - ' + LOSS.format(CLIP.format('pb')) + ')', 10000)} AS log_e4, count(*) AS contracts FROM outcomes WHERE outcome = 'scored' GROUP BY ALL"))
def contest_units(spark: SparkSession, d: str) -> DataFrame:
    u = I.unit_deltas(_outcomes(spark, d))
    return u.select("ticker", F.col("origin").cast("string").alias("origin"), "horizon", M.half_up(F.col("brier_delta"), 100_000).alias("brier_e5"), M.half_up(F.col("log_delta"), 10_000).alias("log_e4"), "contracts")


EVIDENCE = """cells AS (SELECT *, CASE WHEN horizon = 1 THEN '1' WHEN horizon <= 5 THEN '2-5' ELSE '6-25' END AS band, CASE contract % 2 WHEN 0 THEN 'near' ELSE 'far' END AS moneyness, CASE WHEN contract < 2 THEN 'call' ELSE 'put' END AS side FROM scores),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract, model, origin ORDER BY issued, seq) AS rn FROM cells) WHERE rn = 1),
  vint AS (SELECT ticker, origin, horizon, model, vintage AS v FROM (SELECT *, row_number() OVER (PARTITION BY ticker, origin, horizon, model ORDER BY issued, seq) AS rk FROM firsts) WHERE rk = 1),
  means AS (SELECT model, band, moneyness, side, ticker, origin, horizon, avg(p) AS p, avg(itm::INT) AS y, max(expiry) AS expiry FROM firsts JOIN vint USING (ticker, origin, horizon, model) WHERE vintage = v GROUP BY ALL)"""


@query(sql("", f"WITH {SCORES}, {EVIDENCE} SELECT model, band, moneyness, side, count(*) AS units, count(DISTINCT ticker) AS tickers, count(DISTINCT origin) AS dates, {up('avg(p)', 1000)} AS predicted_tenths, {up('avg(y)', 1000)} AS observed_tenths, max(expiry)::VARCHAR AS through FROM means GROUP BY ALL HAVING count(DISTINCT ticker) >= 5 AND count(DISTINCT origin) >= 20 AND count(*) >= 100"))
def calibration_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d).withColumns({"band": I.band_of(F.col("horizon")), "moneyness": F.when(F.col("contract") % 2 == 0, "near").otherwise("far"), "side": F.when(F.col("contract") < 2, "call").otherwise("put")})
    e = I.calibration_evidence(rows, 5, 20, 100)
    return e.select("model", "band", "moneyness", "side", "units", "tickers", "dates", M.half_up(F.col("predicted"), 1000).alias("predicted_tenths"), M.half_up(F.col("observed"), 1000).alias("observed_tenths"), F.col("through").cast("string").alias("through"))


@query(sql("", f"WITH {WHEEL}, c AS (SELECT rule, ticker, expiry, avg(ret) AS m, count(ret) AS n FROM trades GROUP BY ALL) SELECT rule, {up('avg(m)', 1000000)} AS mean_e6, count(m) AS cells, sum(n)::BIGINT AS rows FROM c GROUP BY rule"))
def all_contract_means(spark: SparkSession, d: str) -> DataFrame:
    m = I.cell_means(_trades(spark, d), ["ticker", "expiry"], ["rule"], "ret")
    return m.select("rule", M.half_up(F.col("ret"), 1_000_000).alias("mean_e6"), "cells", "rows")


@query(sql("", f"WITH {WHEEL} SELECT rule, side, CASE WHEN NOT traded THEN 'no_entry' WHEN volatility20 IS NULL THEN 'excluded' ELSE 'scored' END AS status, CASE WHEN NOT traded THEN 'opening_moneyness_changed' WHEN volatility20 IS NULL THEN 'history_short' END AS reason, count(*) AS n FROM trades GROUP BY ALL"))
def strategy_exclusions(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(~F.col("traded"), "no_entry").when(F.col("volatility20").isNull(), "excluded").otherwise("scored")
    reason = F.when(~F.col("traded"), "opening_moneyness_changed").when(F.col("volatility20").isNull(), "history_short")
    return I.exclusion_summary(_trades(spark, d).select("rule", "side", status.alias("status"), reason.alias("reason")), ["rule", "side"])
