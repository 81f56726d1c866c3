"""Queries over option quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators import chain as C
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A

CONTRACT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
IDS = ", ".join(CONTRACT)


def up(x: str, scale: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5::DOUBLE))::BIGINT"


INTRINSIC = "greatest(0.0::DOUBLE, CASE WHEN side = 'call' THEN spot - strike ELSE strike - spot END)"
METRICS = f"""
m AS (SELECT *, {up(f"((bid - {INTRINSIC}) * 100)", 100)} AS net_premium_cents,
      {up("(CASE WHEN side = 'call' THEN spot - bid ELSE strike - bid END)", 100)} AS breakeven_cents,
      {up(f"(CASE WHEN (CASE WHEN side = 'call' THEN spot - bid ELSE strike - bid END) > 0 AND dte > 0 THEN (bid - {INTRINSIC}) * 100 / ((CASE WHEN side = 'call' THEN spot - bid ELSE strike - bid END) * 100) * 365 / dte * 100 END)", 10)} AS apr_tenths,
      {up("(abs((strike - spot) / spot) * 100)", 10)} AS to_assignment_tenths FROM quotes)"""
METRIC_NAMES = "net_premium_cents, breakeven_cents, apr_tenths, to_assignment_tenths"


@query(sql("quotes", f"WITH {METRICS.strip()} SELECT {IDS}, side, {METRIC_NAMES} FROM m WHERE oi >= 5 AND side = 'call'"))
def covered_call_metrics(spark: SparkSession, d: str) -> DataFrame:
    q = A.quotes(spark, d).filter((F.col("oi") >= C.MINIMUM_OPEN_INTEREST) & (F.col("side") == "call"))
    return C.decision_metrics(q).select(*CONTRACT, "side", *METRIC_NAMES.split(", ")).orderBy(F.desc("l_orderkey"))


@query(sql("quotes", f"WITH {METRICS.strip()} SELECT {IDS}, side, {METRIC_NAMES} FROM m WHERE oi >= 5 AND side = 'put' AND spot > strike"))
def cash_secured_put_metrics(spark: SparkSession, d: str) -> DataFrame:
    q = A.quotes(spark, d).filter((F.col("oi") >= C.MINIMUM_OPEN_INTEREST) & (F.col("side") == "put"))
    return C.decision_metrics(C.passes_moneyness(q, "otm")).select(*CONTRACT, "side", *METRIC_NAMES.split(", "))


PROFIT = "(bid * 100 - (spot - strike) * 100)"


def rate(over: str, part: str) -> str:
    return up(f"(CASE WHEN {over} > 0 AND dte > 0 THEN {part} / {over} * 365 / dte * 100 END)", 10)


@query(sql("quotes", f"SELECT {IDS}, {up('(spot * 100 - bid * 100)', 100)} AS outlay_cents, {up(PROFIT, 100)} AS called_profit_cents, {rate('(spot * 100 - bid * 100)', PROFIT)} AS apr_outlay_tenths, {rate('(spot * 100)', PROFIT)} AS apr_stock_tenths FROM quotes WHERE side = 'call'"))
def call_contract_columns(spark: SparkSession, d: str) -> DataFrame:
    return C.call_metrics(A.quotes(spark, d)).select(*CONTRACT, "outlay_cents", "called_profit_cents", "apr_outlay_tenths", "apr_stock_tenths")


@query(sql("quotes", f"SELECT {IDS}, {up('(strike * 100)', 100)} AS collateral_cents, {up('(strike * 100 - bid * 100)', 100)} AS net_collateral_cents, {rate('(strike * 100)', 'bid * 100')} AS apr_collateral_tenths, {rate('(strike * 100 - bid * 100)', 'bid * 100')} AS apr_net_tenths, {up('(CASE WHEN spot > 0 THEN (spot - (strike - bid)) / spot * 100 END)', 10)} AS cushion_tenths FROM quotes WHERE side = 'put'"))
def put_contract_columns(spark: SparkSession, d: str) -> DataFrame:
    return C.put_metrics(A.quotes(spark, d)).select(*CONTRACT, "collateral_cents", "net_collateral_cents", "apr_collateral_tenths", "apr_net_tenths", "cushion_tenths")


@query(sql("quotes", f"WITH {METRICS.strip()}, s AS (SELECT *, {up('(CASE WHEN (ask + bid) / 2 > 0 THEN (ask - bid) / ((ask + bid) / 2) * 100 END)', 10)} AS spread_tenths FROM m) SELECT {IDS}, apr_tenths, spread_tenths, dte FROM s WHERE apr_tenths >= 50 AND net_premium_cents >= 100 AND oi >= 5 AND spread_tenths <= 50 AND dte <= 700 AND to_assignment_tenths <= 150"))
def chain_filters_and(spark: SparkSession, d: str) -> DataFrame:
    rows = C.spreads(C.decision_metrics(A.quotes(spark, d)))
    return C.passes(rows, {"apr_tenths": 50, "net_premium_cents": 100, "oi": 5}, {"spread_tenths": 50, "dte": 700, "to_assignment_tenths": 150}).select(*CONTRACT, "apr_tenths", "spread_tenths", "dte")


@query(sql("quotes", f"WITH s AS (SELECT ticker, {up('(ask - bid)', 100)} AS c, {up('(CASE WHEN (ask + bid) / 2 > 0 THEN (ask - bid) / ((ask + bid) / 2) * 100 END)', 10)} AS t FROM quotes) SELECT ticker, CASE WHEN t IS NULL THEN 'unknown' WHEN t < 10 THEN 'tight' WHEN t < 40 THEN 'normal' WHEN t < 70 THEN 'wide' ELSE 'very_wide' END AS band, count(*) AS n, sum(c)::BIGINT AS spread_cents FROM s GROUP BY ALL"))
def spread_pct_and_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = C.spreads(A.quotes(spark, d))
    band = F.coalesce(M.bands(F.col("spread_tenths"), [10, 40, 70], ["tight", "normal", "wide", "very_wide"]), F.lit("unknown"))
    return rows.groupBy("ticker", band.alias("band")).agg(F.count("*").alias("n"), F.sum("spread_cents").alias("spread_cents"))


@query(sql("quotes", """SELECT CASE WHEN 1 - strike / spot > 0 THEN CASE WHEN 1 - strike / spot < 0.025::DOUBLE THEN '0-2.5%' WHEN 1 - strike / spot < 0.05::DOUBLE THEN '2.5-5%' WHEN 1 - strike / spot < 0.1::DOUBLE THEN '5-10%' WHEN 1 - strike / spot < 0.2::DOUBLE THEN '10-20%' ELSE '20%+' END END AS depth,
  CASE WHEN oi = 1 THEN '1' WHEN oi BETWEEN 2 AND 5 THEN '2-5' WHEN oi BETWEEN 6 AND 10 THEN '6-10' WHEN oi BETWEEN 11 AND 25 THEN '11-25' END AS horizon, count(*) AS n FROM quotes GROUP BY ALL"""))
def depth_horizon_bands(spark: SparkSession, d: str) -> DataFrame:
    return A.quotes(spark, d).groupBy(M.depth_band(F.col("spot"), F.col("strike")).alias("depth"), M.horizon_band(F.col("oi")).alias("horizon")).agg(F.count("*").alias("n"))


@query(sql("quotes", """WITH b AS (SELECT side, abs(strike / spot - 1) AS x, CASE WHEN CASE WHEN side = 'call' THEN strike < spot ELSE strike > spot END THEN 'itm' ELSE 'otm' END AS w FROM quotes)
  SELECT side, CASE WHEN x <= 0.05::DOUBLE THEN 'near_atm' WHEN x <= 0.15::DOUBLE THEN 'moderate_' || w ELSE 'far_' || w END AS band, count(*) AS n FROM b GROUP BY ALL"""))
def moneyness_bands(spark: SparkSession, d: str) -> DataFrame:
    return A.quotes(spark, d).groupBy("side", M.moneyness_band(F.col("spot"), F.col("strike"), F.col("side")).alias("band")).agg(F.count("*").alias("n"))


@query(sql("stocks", "SELECT ticker, " + ", ".join(f"min(floor(low * 100 + 0.5::DOUBLE)::BIGINT) FILTER (ts >= DATE '1998-06-01' - {n} AND low > 0) AS low_{n}" for n in (7, 30, 90, 365)) + " FROM stocks WHERE ts < DATE '1998-06-01' AND ts >= DATE '1998-06-01' - 365 GROUP BY ticker"))
def period_lows(spark: SparkSession, d: str) -> DataFrame:
    return C.period_lows(A.stocks(spark, d), "1998-06-01")


@query(sql("quotes", f"""SELECT {IDS}, CASE WHEN bid IS NULL OR ask IS NULL OR bid <= 0 THEN 'missing_quote' WHEN ask < bid THEN 'crossed' WHEN ask = bid THEN 'locked' WHEN ask >= CASE WHEN side = 'call' THEN spot ELSE strike END THEN 'above_cap' WHEN oi < 5 THEN 'inactive' WHEN ask - bid > greatest(0.25::DOUBLE, (ask + bid) / 2 * 0.25::DOUBLE) THEN 'wide_spread' END AS issue FROM quotes"""))
def quote_issues(spark: SparkSession, d: str) -> DataFrame:
    return C.quote_issue(A.quotes(spark, d)).select(*CONTRACT, "issue")


@query(sql("quotes", f"SELECT * FROM (SELECT ticker, strike, expiry::VARCHAR AS expiry, side, {IDS}, count(*) OVER w AS copies, row_number() OVER (w ORDER BY {IDS}) = 1 AS kept FROM quotes WINDOW w AS (PARTITION BY ticker, strike, expiry, side)) WHERE copies > 1"))
def duplicate_contract_flags(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(A.quotes(spark, d).select("ticker", "strike", "expiry", "side", *CONTRACT), ["ticker", "strike", "expiry", "side"], CONTRACT).withColumn("expiry", F.col("expiry").cast("string"))


@query(sql("quotes", f"WITH {METRICS.strip()} SELECT ticker, strftime(expiry, '%Y-%m') AS month, min(apr_tenths) AS least, max(apr_tenths) AS most, count(apr_tenths) AS known, count(*) AS n FROM m GROUP BY ALL"))
def heat_ranges(spark: SparkSession, d: str) -> DataFrame:
    return C.heat_ranges(C.decision_metrics(A.quotes(spark, d)), "apr_tenths")


KEY = "'w1:' || upper(replace(ticker, ' ', '')) || ':' || upper(replace(ticker, ' ', '')) || ':' || side || ':' || expiry::VARCHAR || ':' || strike::DECIMAL(18,3)::VARCHAR"


@query(sql("quotes", f"WITH k AS (SELECT DISTINCT ticker, side, expiry, strike, {KEY} AS key FROM quotes) SELECT key, side AS side_read, expiry::VARCHAR AS expiry_read, floor(strike * 1000 + 0.5::DOUBLE)::BIGINT AS strike_mills FROM k"))
def watch_key_format_parse(spark: SparkSession, d: str) -> DataFrame:
    root = F.upper(F.replace(F.col("ticker"), F.lit(" "), F.lit("")))
    k = A.quotes(spark, d).select("ticker", "side", "expiry", "strike").distinct()
    k = k.withColumn("key", M.watch_key(root, root, F.col("side"), F.col("expiry"), F.col("strike")))
    p = M.parse_watch_key(F.col("key"))
    return k.select("key", p["side"].alias("side_read"), p["expiry"].cast("string").alias("expiry_read"), (p["strike"] * 1000).cast("long").alias("strike_mills"))


@query(sql("quotes", "SELECT DISTINCT 'O:' || upper(replace(ticker, 'Brand#', 'B')) || strftime(expiry, '%y%m%d') || CASE WHEN side = 'call' THEN 'C' ELSE 'P' END || lpad(floor(strike * 1000 + 0.5::DOUBLE)::BIGINT::VARCHAR, 8, '0') AS symbol, side AS side_read, floor(strike * 1000 + 0.5::DOUBLE)::BIGINT AS strike_mills, upper(replace(ticker, 'Brand#', 'B')) AS root_read FROM quotes WHERE expiry >= DATE '2000-01-01'"))
def occ_symbol_parse(spark: SparkSession, d: str) -> DataFrame:
    q = A.quotes(spark, d).filter("expiry >= date '2000-01-01'")
    root = F.upper(F.replace(F.col("ticker"), F.lit("Brand#"), F.lit("B")))
    s = q.select(M.option_symbol(root, F.col("expiry"), F.col("side"), F.col("strike")).alias("symbol"))
    p = M.parse_option_symbol(F.col("symbol"))
    return s.select("symbol", p["side"].alias("side_read"), (p["strike"] * 1000).cast("long").alias("strike_mills"), p["root"].alias("root_read")).distinct()


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN floor(p_retailprice * 100 + 0.5::DOUBLE)::BIGINT WHEN 2 THEN (p_partkey * 100000 + 50)::BIGINT ELSE NULL END AS cents FROM part")
def price_text_parse(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "--").when(k % 4 == 1, F.concat(F.lit("$"), F.format_number("p_retailprice", 2))).when(k % 4 == 2, F.concat(F.format_number((k * 1000).cast("long"), 0), F.lit(".50"))).otherwise(F.lit(" n/a "))
    return p.select("p_partkey", F.round(M.parse_price(text) * 100).cast("long").alias("cents"))


def _policy(name: str):
    bound = {"max_apr": ("(ratio >= 0.9::DOUBLE AND ratio < 1)", "0::BIGINT"), "near_atm": ("(ratio >= 0.975::DOUBLE AND ratio < 1)", up("abs(ratio - 1.0::DOUBLE)", 100000000)), "five_below": ("(ratio >= 0.925::DOUBLE AND ratio <= 0.975::DOUBLE)", up("abs(ratio - 0.95::DOUBLE)", 100000000)), "wider": ("((side = 'call' AND ratio >= 1.025::DOUBLE AND ratio <= 1.075::DOUBLE) OR (side = 'put' AND ratio >= 0.875::DOUBLE AND ratio <= 0.925::DOUBLE))", up("abs(ratio - CASE WHEN side = 'call' THEN 1.05::DOUBLE ELSE 0.9::DOUBLE END)", 100000000))}[name]
    text = sql("quotes", f"WITH {METRICS.strip()}, r AS (SELECT *, strike / spot AS ratio FROM m), e AS (SELECT *, {bound[1]} AS distance FROM r WHERE {bound[0]} AND dte > 0 AND bid > 0), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY distance, apr_tenths DESC NULLS LAST, oi DESC, strike, {IDS}) AS rank FROM e) SELECT ticker, side, {IDS}, distance, apr_tenths FROM k WHERE rank = 1")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.selected(A.quotes(spark, d), name, ["ticker", "side"], CONTRACT).select("ticker", "side", *CONTRACT, "distance", "apr_tenths")

    run.__name__ = f"policy_top1_{name}"
    query(text)(run)


for _name in C.POLICIES:
    _policy(_name)

REWARD = f"((bid * (1 - 0.1::DOUBLE) - {INTRINSIC} - 0.0065::DOUBLE) / CASE WHEN side = 'call' THEN spot ELSE strike END / (dte + 1))"


@query(sql("quotes", f"WITH r AS (SELECT *, {up(REWARD, 1000000000)} AS reward_e9 FROM quotes WHERE dte > 0 AND bid > 0), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY reward_e9 DESC, oi DESC, strike, {IDS}) AS rank FROM r) SELECT ticker, side, {IDS}, reward_e9 FROM k WHERE rank = 1"))
def wheel_top1(spark: SparkSession, d: str) -> DataFrame:
    return C.wheel_selected(A.quotes(spark, d), ["ticker", "side"], CONTRACT).select("ticker", "side", *CONTRACT, "reward_e9")


@query(sql("quotes", f"""WITH cells AS (SELECT band, lo, hi, side, target FROM (VALUES (0, 1, 100), (1, 101, 500), (2, 501, 2000)) h(band, lo, hi), (VALUES ('call'), ('put')) s(side), (VALUES (-20), (-10), (0), (10), (20)) t(target)),
  r AS (SELECT *, {up("(CASE WHEN side = 'call' THEN strike / spot - 1 ELSE 1 - strike / spot END * 100)", 1000000)} AS pct_e6 FROM quotes WHERE dte > 0),
  b AS (SELECT r.ticker, c.band, c.side, c.target, abs(pct_e6 - c.target * 1000000) AS gap, dte, {IDS}, row_number() OVER (PARTITION BY r.ticker, c.band, c.side, c.target ORDER BY abs(pct_e6 - c.target * 1000000), dte, {IDS}) AS rn FROM r JOIN cells c ON r.side = c.side AND dte BETWEEN c.lo AND c.hi)
  SELECT t.ticker, c.band, c.side, c.target, b.gap, b.dte, {", ".join("b." + x for x in CONTRACT)} FROM (SELECT DISTINCT ticker FROM quotes) t CROSS JOIN cells c LEFT JOIN b ON b.ticker = t.ticker AND b.band = c.band AND b.side = c.side AND b.target = c.target AND b.rn = 1"""))
def panel_30_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.panel_cells(A.quotes(spark, d), CONTRACT)


@query(sql("quotes", f"""WITH {METRICS.strip()}, r AS (SELECT *, strike / spot AS ratio FROM m WHERE dte > 0 AND bid > 0), g AS (SELECT *, l_partkey AS id FROM r WHERE oi >= 10),
  a AS (SELECT ticker, side, {IDS}, row_number() OVER (PARTITION BY ticker, side ORDER BY 0, apr_tenths DESC NULLS LAST, oi DESC, strike, {IDS}) AS r1 FROM r WHERE ratio >= 0.9::DOUBLE AND ratio < 1),
  b AS (SELECT ticker, side, {IDS}, row_number() OVER (PARTITION BY ticker, side ORDER BY {up("abs(ratio - 1.0::DOUBLE)", 100000000)}, apr_tenths DESC NULLS LAST, oi DESC, strike, {IDS}) AS r2 FROM r WHERE ratio >= 0.975::DOUBLE AND ratio < 1),
  j AS (SELECT ticker, side, r1, r2, row_number() OVER (PARTITION BY ticker, side ORDER BY r1) AS a, row_number() OVER (PARTITION BY ticker, side ORDER BY r2) AS b FROM a JOIN b USING (ticker, side, {IDS}))
  SELECT ticker, side, count(*) AS matched, {up("(CASE WHEN count(*) >= 2 THEN 1 - 6.0::DOUBLE * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1)) END)", 10000)} AS spearman_e4, count(*) FILTER (r1 <= 3 AND r2 <= 3) AS top3_shared FROM j GROUP BY ALL"""))
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    q = A.quotes(spark, d)
    group = ["ticker", "side"]
    return C.rank_stability(C.ranked(q, "max_apr", group, CONTRACT), C.ranked(q, "near_atm", group, CONTRACT), group, CONTRACT)


@query(sql("quotes", "SELECT ticker, dte FROM (SELECT ticker, dte, row_number() OVER (PARTITION BY ticker ORDER BY abs(dte - 35), dte) AS rn FROM (SELECT DISTINCT ticker, dte FROM quotes WHERE dte > 0)) WHERE rn = 1"))
def nearest_matching_expiry(spark: SparkSession, d: str) -> DataFrame:
    return C.nearest_expiry(A.quotes(spark, d), 35)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 512")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return C.keyset_page(A.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 512)


@query(sql("quotes", f"SELECT expiry::VARCHAR AS expiry, strike, {IDS} FROM quotes WHERE expiry >= DATE '1998-01-01' ORDER BY quotes.expiry, strike DESC, {IDS} LIMIT 250"))
def reveal_limit_250(spark: SparkSession, d: str) -> DataFrame:
    rows = A.quotes(spark, d).filter("expiry >= date '1998-01-01'").select("expiry", "strike", *CONTRACT)
    return C.reveal(rows, "expiry", [F.col("strike").desc(), *[F.col(c) for c in CONTRACT]], 250).withColumn("expiry", F.col("expiry").cast("string"))


@query(sql("quotes", f"WITH {METRICS.strip()} SELECT {IDS}, apr_tenths FROM m WHERE ticker = 'Brand#11' OR ticker = 'Brand#1' ORDER BY apr_tenths DESC NULLS LAST, strike DESC, {IDS} LIMIT 100"))
def null_last_sort_page(spark: SparkSession, d: str) -> DataFrame:
    rows = C.decision_metrics(A.quotes(spark, d).filter("ticker in ('Brand#11', 'Brand#1')"))
    return rows.orderBy(F.col("apr_tenths").desc_nulls_last(), F.col("strike").desc(), *CONTRACT).select(*CONTRACT, "apr_tenths").limit(100)


@query("SELECT CASE WHEN upper(p_brand) LIKE 'BRAND#1%' THEN 0 ELSE 1 END AS rank, p_brand || '-' || p_partkey AS ticker, p_name AS name FROM part WHERE upper(p_brand || '-' || p_partkey) LIKE 'BRAND#1%' OR contains(upper(p_name), 'BRAND#1') ORDER BY rank, ticker LIMIT 20")
def ticker_search(spark: SparkSession, d: str) -> DataFrame:
    names = A.table(spark, d, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"))
    return C.search_tickers(names, "brand#1", 20).select("rank", "ticker", "name")


@query("SELECT c_custkey, sha256(c_name) AS h FROM customer ORDER BY h, c_custkey LIMIT 50")
def hash_rank_sample(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer")
    return c.select("c_custkey", F.sha2("c_name", 256).alias("h")).orderBy("h", "c_custkey").limit(50)
