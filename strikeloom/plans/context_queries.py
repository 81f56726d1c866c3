"""Queries over pages, pricing context, watches, display and what was known before an origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import display as V
from strikeloom.functions import money as M
from strikeloom.operators import context as C
from strikeloom.operators import history as H
from strikeloom.plans.chain_queries import up
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A


def _o(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "orders")


def date(x: str) -> F.Column:
    return F.lit(x).cast("date")


MONEY_SQL = "CASE WHEN {0} IS NULL THEN '—' ELSE (CASE WHEN {0} < 0 THEN '-' ELSE '' END) || '$' || format('{{:,}}', abs({0}) // 100) || '.' || lpad((abs({0}) % 100)::VARCHAR, 2, '0') END"
PERCENT_SQL = "CASE WHEN {0} IS NULL THEN '—' ELSE (CASE WHEN {0} < 0 THEN '-' WHEN {0} > 0 THEN '{1}' ELSE '' END) || (abs({0}) // 10)::VARCHAR || '.' || (abs({0}) % 10)::VARCHAR || '%' END"
CENTS = "CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey * 7919 % 2000003 - 900000) END"


def _cents() -> F.Column:
    K = F.col("o_orderkey")  # noqa: N806
    return F.when(K % 13 > 0, K * 7919 % 2000003 - 900000)


@query(f"SELECT o_orderkey AS key, {MONEY_SQL.format('c')} AS money, {PERCENT_SQL.format('c', '+')} AS pct, {PERCENT_SQL.format('c', '')} AS plain_pct, CASE WHEN c IS NULL THEN '—' ELSE format('{{:,}}', c) END AS whole FROM (SELECT o_orderkey, {CENTS} AS c FROM orders)")
def display_texts(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    c = _cents()
    return _o(spark, d).select(K.alias("key"), V.money_text(c).alias("money"), V.percent_text(c).alias("pct"), V.percent_text(c, False).alias("plain_pct"), V.integer_text(c).alias("whole"))


@query(f"""SELECT o_orderkey AS key, 'T' || (o_orderkey % 9) || ' · ' || strftime(o_orderdate, '%Y-%m-%d') || ' · ' || format('{{:,}}', o_orderkey % 4000) || ' DTE · bid: ' || {MONEY_SQL.format('c')}
  || CASE WHEN lots IS NULL THEN '' WHEN lots = 1 THEN ' · 1 contract · 100 sh' ELSE ' · ' || format('{{:,}}', lots) || ' contracts · ' || format('{{:,}}', lots * 100) || ' sh' END || chr(10) || chr(10) || '| Strike | APR |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {MONEY_SQL.format('(o_orderkey % 9000)')} || ' | ' || {PERCENT_SQL.format('(o_orderkey % 777)', '+')} || ' |' AS text
  FROM (SELECT *, {CENTS} AS c, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 1500 + 1 END AS lots FROM orders)""")
def clipboard_rows(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    lots = F.when(K % 5 > 0, K % 1500 + 1)
    rows = _o(spark, d)
    text = V.row_text(F.concat(F.lit("T"), (K % 9).cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd"), K % 4000, F.lit("bid"), _cents(), lots, ["Strike", "APR"], [V.money_text(K % 9000), V.percent_text(K % 777)])
    return rows.select(K.alias("key"), text.alias("text"))


TOKENS = ["$1,250.50", " -3.5% ", "1,25", "+ $7", "$ -12", "abc", "", "12.", "1000000", "1,000,000.25", "%", "$$5", "0.0001%"]


@query(f"""SELECT o_orderkey AS key, CASE WHEN regexp_full_match(raw, '\\s*([+-]?\\s*\\$?|\\$\\s*[+-]?)\\s*(\\d{{1,3}}(,\\d{{3}})+|\\d+)(\\.\\d+)?\\s*%?\\s*') THEN floor(regexp_replace(raw, '[$%,\\s]', '', 'g')::DECIMAL(30, 10) * 10000 + 0.5)::BIGINT END AS value_e4
  FROM (SELECT o_orderkey, {TOKENS}[o_orderkey % {len(TOKENS)} + 1] AS raw FROM orders)""")
def threshold_parse(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    raw = F.element_at(F.array(*map(F.lit, TOKENS)), (K % len(TOKENS) + 1).cast("int"))
    return _o(spark, d).select(K.alias("key"), F.floor(V.threshold(raw) * 10000 + F.lit("0.5").cast("decimal(2,1)")).cast("long").alias("value_e4"))


BIG = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 9007199254740991 ELSE o_orderkey * 1000 - 5000000 END"


@query(f"""SELECT o_orderkey AS key, CASE WHEN abs(v) <= 9007199254740991 AND lots > 0 AND abs(v::HUGEINT * lots) <= 9007199254740991 THEN (v::HUGEINT * lots)::BIGINT END AS scaled,
  lots > 0 AND (v IS NULL OR abs(v::HUGEINT * lots) <= 9007199254740991) AS safe FROM (SELECT o_orderkey, {BIG} AS v, o_custkey % 50 - 2 AS lots FROM orders)""")
def scaled_money(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    v = F.when(K % 4 == 1, F.lit(V.SAFE)).when(K % 4 != 0, K * 1000 - 5_000_000)
    lots = F.col("o_custkey") % 50 - 2
    return _o(spark, d).select(K.alias("key"), V.scaled(v, lots).alias("scaled"), V.lots_are_safe(lots, [v]).alias("safe"))


@query(f"SELECT o_orderkey AS key, {up('greatest(r * 0.05::DOUBLE, r * (0.05::DOUBLE - 1))', 10000)} AS loss_e4 FROM (SELECT o_orderkey, (o_custkey % 200 - 100) / 8.0::DOUBLE - (o_orderkey % 90 - 45) / 4.0::DOUBLE AS r FROM orders)")
def pinball_loss(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    loss = V.pinball((F.col("o_custkey") % 200 - 100) / 8.0, (K % 90 - 45) / 4.0)
    return _o(spark, d).select(K.alias("key"), M.half_up(loss, 10_000).alias("loss_e4"))


@query("""SELECT key, CASE WHEN p BETWEEN 0 AND 1 THEN floor(p * 1000 + 0.5::DOUBLE)::BIGINT END AS tenths, CASE WHEN ok THEN floor((CASE WHEN put THEN 1 - hi ELSE lo END) * 1000 + 0.5::DOUBLE)::BIGINT END AS low, CASE WHEN ok THEN floor((CASE WHEN put THEN 1 - lo ELSE hi END) * 1000 + 0.5::DOUBLE)::BIGINT END AS high, CASE WHEN ok THEN floor((1 - (hi - lo)) * 100 + 0.5::DOUBLE)::BIGINT END AS score
  FROM (SELECT *, lo >= 0 AND lo <= hi AND hi <= 1 AS ok FROM (SELECT o_orderkey AS key, (o_orderkey % 1100 - 50) / 1024.0::DOUBLE AS p, (o_orderkey % 512) / 1024.0::DOUBLE AS lo, (o_orderkey % 512 + o_custkey % 600 - 40) / 1024.0::DOUBLE AS hi, o_custkey % 2 = 0 AS put FROM orders))""")
def quote_support(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    lo = (K % 512) / 1024.0
    s = V.quote_support(lo, (K % 512 + F.col("o_custkey") % 600 - 40) / 1024.0, F.col("o_custkey") % 2 == 0)
    return _o(spark, d).select(K.alias("key"), V.tenths_of((K % 1100 - 50) / 1024.0).alias("tenths"), s.alias("s")).select("key", "tenths", "s.*")


URL = "CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '//other.host/x' WHEN 2 THEN '/odd' ELSE '/market-activity/stocks/' || (CASE WHEN o_orderkey % 11 = 3 THEN 'zzz' ELSE 'abc' END) || '/option-chain/call-put-options/' || (CASE WHEN o_orderkey % 11 = 4 THEN 'abd' ELSE 'abc' END) || '--' || (CASE WHEN o_orderkey % 11 = 5 THEN '969931' WHEN o_orderkey % 11 = 6 THEN '970101' ELSE '960119' END) || 'c' || lpad((o_orderkey % 500 * 500)::VARCHAR, 8, '0') END"


@query(f"""SELECT o_orderkey AS key, CASE WHEN r IN ('Nasdaq did not provide a contract symbol', 'Nasdaq contract symbol is ambiguous', 'Nasdaq contract symbol is unrecognized') THEN NULL WHEN o_orderkey % 11 = 4 THEN 'ABD' ELSE 'ABC' END AS root, r AS reason FROM (SELECT o_orderkey,
  CASE WHEN u IS NULL THEN 'Nasdaq did not provide a contract symbol' WHEN u = '//other.host/x' THEN 'Nasdaq contract symbol is ambiguous' WHEN u = '/odd' THEN 'Nasdaq contract symbol is unrecognized' WHEN o_orderkey % 11 = 5 THEN 'Nasdaq contract expiry is invalid' WHEN o_orderkey % 11 = 4 THEN 'Adjusted or nonstandard option root' WHEN o_orderkey % 11 = 6 THEN 'Nasdaq contract expiry differs from chain row'
    WHEN o_orderkey % 500 * 500 <> o_orderkey % 400 * 500 THEN 'Nasdaq contract strike differs from chain row' WHEN o_orderkey % 11 = 3 THEN 'Nasdaq contract ticker differs from chain row' END AS r FROM (SELECT *, {URL} AS u FROM orders))""")
def contract_row_identity(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    m = K % 11
    path = F.concat(F.lit("/market-activity/stocks/"), F.when(m == 3, "zzz").otherwise("abc"), F.lit("/option-chain/call-put-options/"), F.when(m == 4, "abd").otherwise("abc"), F.lit("--"), F.when(m == 5, "969931").when(m == 6, "970101").otherwise("960119"), F.lit("c"), F.lpad((K % 500 * 500).cast("string"), 8, "0"))
    url = F.when(m == 1, "//other.host/x").when(m == 2, "/odd").when(m != 0, path)
    strike = ((K % 400 * 500).cast("decimal(18,3)") / 1000).cast("decimal(18,3)")
    return _o(spark, d).select(K.alias("key"), V.identity(url, F.lit("ABC"), F.lit("2096-01-19"), strike).alias("x")).select("key", "x.root", "x.reason")


@query("""SELECT event_id AS key, timezone('America/New_York', timezone('UTC', ts))::DATE::VARCHAR AS day, epoch_ms(timezone('UTC', timezone('America/New_York', timezone('America/New_York', timezone('UTC', ts))::DATE::TIMESTAMP))) AS midnight,
  (timezone('America/New_York', timezone('UTC', ts))::DATE - INTERVAL '24 months')::DATE::VARCHAR AS window_start FROM events""")
def new_york_days(spark: SparkSession, d: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return A.table(spark, d, "events").select(F.col("event_id").alias("key"), V.local_day(ms).cast("string").alias("day"), V.local_midnight(ms).alias("midnight"), V.window_start(V.local_day(ms)).cast("string").alias("window_start"))


DIVIDENDS = """divs AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 9 > 0 THEN 'EQUITY' ELSE 'ETF' END AS quote_type, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -0.1::DOUBLE WHEN 2 THEN 0.0 ELSE 0.5 END AS rate, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE 0.0::DOUBLE END AS past, CASE c_custkey % 4 WHEN 0 THEN DATE '1996-03-01' + (c_custkey % 200)::INT WHEN 1 THEN DATE '1996-05-05' END AS ex FROM customer),
kinds AS (SELECT *, CASE WHEN quote_type <> 'EQUITY' OR coalesce(rate < 0, false) OR coalesce(past < 0, false) THEN 'unknown' WHEN rate > 0 OR past > 0 THEN 'payer' WHEN (rate = 0 OR past = 0) AND ex IS NULL THEN 'nonpayer' ELSE 'unknown' END AS kind FROM divs)"""
GATE = "CASE WHEN coalesce(kind = 'nonpayer' OR (kind = 'payer' AND {e} < ex), false) THEN NULL WHEN kind = 'payer' THEN 'Dividend exposure is unsupported for this expiration' ELSE 'Dividend status could not be verified' END"


def _dividends(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    seconds = F.datediff(F.date_add(date("1996-03-01"), (k % 200).cast("int")), date("1970-01-01")).cast("long") * 86_400 + 43_200
    ex = V.ex_date(F.when(k % 4 == 0, seconds.cast("string")).when(k % 4 == 1, "1996-05-05T00:00:00"))
    rate = F.when(k % 5 == 1, -0.1).when(k % 5 == 2, 0.0).when(k % 5 > 2, 0.5)
    trailing = F.when(k % 3 > 0, 0.0)
    return A.table(spark, d, "customer").select(k.alias("key"), ex.alias("ex"), V.dividend_kind(F.when(k % 9 > 0, "EQUITY").otherwise("ETF"), rate, trailing, ex).alias("kind"))


@query(f"WITH {DIVIDENDS} SELECT key, kind, ex::VARCHAR AS ex, {GATE.format(e='''DATE '1996-06-01' ''')} AS reason FROM kinds")
def dividend_gates(spark: SparkSession, d: str) -> DataFrame:
    return _dividends(spark, d).select("key", "kind", F.col("ex").cast("string").alias("ex"), V.dividend_reason(F.col("kind"), F.col("ex"), date("1996-06-01")).alias("reason"))


@query("SELECT p_partkey AS key FROM (SELECT *, p_name || CASE p_partkey % 6 WHEN 0 THEN ' Warrants' WHEN 1 THEN ' notebook' WHEN 2 THEN ' Preferred A' ELSE '' END AS name, CASE WHEN p_partkey % 7 > 0 THEN p_type ELSE ' ' END AS sector FROM part) WHERE trim(sector) <> '' AND NOT regexp_matches(name, '(?i)\\b(warrants?|rights?|units?|preferred|notes?|bonds?)\\b')")
def peer_listings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 6 == 0, " Warrants").when(k % 6 == 1, " notebook").when(k % 6 == 2, " Preferred A").otherwise(""))
    return A.table(spark, d, "part").filter(V.common_stock(name, F.when(k % 7 > 0, F.col("p_type")).otherwise(" "))).select(k.alias("key"))


CHAINS = """chains AS (SELECT c_custkey AS ticker, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bid, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 0.5::DOUBLE END AS last, c_custkey % 13 = 0 AS truncated, DATE '1996-01-02' - (c_custkey % 6 = 0)::INT AS chain_session, c_custkey % 2 = 0 AS open, CASE WHEN c_custkey % 8 = 0 THEN 'Underlying quote is too wide' END AS spot_reason, CASE WHEN c_custkey % 5 > 0 THEN c_custkey + 1 END AS completed_close FROM customer)"""


def _chains(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").select(k.alias("ticker"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bid"), F.when(k % 4 > 0, k * 0.5).alias("last"), (k % 13 == 0).alias("truncated"), F.date_sub(date("1996-01-02"), (k % 6 == 0).cast("int")).alias("chain_session"), date("1996-01-02").alias("session"), (k % 2 == 0).alias("open"), F.when(k % 8 == 0, "Underlying quote is too wide").alias("spot_reason"), F.when(k % 5 > 0, k + 1).alias("completed_close"))


@query(f"WITH {CHAINS}, lows AS (SELECT o_custkey AS ticker, min(o_totalprice) FILTER (o_orderdate >= DATE '1997-01-01') AS low_recent, min(o_totalprice) AS low_all FROM orders GROUP BY 1) SELECT ticker, {up('CASE WHEN bid > 0 THEN bid WHEN last > 0 THEN last END', 100)} AS price_cents, CASE WHEN bid > 0 THEN 'stock_bid' WHEN last > 0 THEN 'chain_last_trade' END AS source, truncated, {up('low_recent', 100)} AS low_recent_cents, {up('low_all', 100)} AS low_all_cents, 40 AS rate_tenths FROM chains LEFT JOIN lows USING (ticker)")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    lows = _o(spark, d).groupBy(F.col("o_custkey").alias("ticker")).agg(F.min(F.when(F.to_date("o_orderdate") >= date("1997-01-01"), F.col("o_totalprice"))).alias("low_recent"), F.min("o_totalprice").alias("low_all"))
    chains = _chains(spark, d)
    p = C.page_fields(chains.select("ticker", "last", "truncated"), chains.select("ticker", "bid", F.lit(None).cast("double").alias("ask")), lows)
    return p.select("ticker", M.half_up(F.col("price"), 100).alias("price_cents"), "source", "truncated", M.half_up(F.col("low_recent"), 100).alias("low_recent_cents"), M.half_up(F.col("low_all"), 100).alias("low_all_cents"), "rate_tenths")


@query(f"WITH {CHAINS} SELECT ticker, CASE WHEN chain_session <> DATE '1996-01-02' THEN 'Option chain belongs to another quote session' WHEN truncated THEN 'Option-chain coverage is incomplete' WHEN open THEN spot_reason WHEN completed_close IS NULL THEN 'Official completed-session close is unavailable' END AS blocked FROM chains")
def pricing_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.block_reason(_chains(spark, d)).select("ticker", "blocked")


ROWS = """chain_rows AS (SELECT p_brand AS ticker, l_shipdate::DATE AS expiry, l_partkey % 50 AS strike, CASE WHEN l_partkey % 9 > 0 THEN p_brand ELSE 'other' END AS root, CASE WHEN l_suppkey % 10 = 0 THEN 'odd terms' END AS identity_reason, CASE WHEN l_returnflag = 'A' THEN 'call' ELSE 'put' END AS side, CASE WHEN l_linenumber % 3 = 0 THEN 'Option quote is crossed' END AS issue, l_orderkey AS key, l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey),
listed AS (SELECT ticker, expiry, strike, count(*) AS rows, CASE WHEN count(*) > 1 THEN 'Contract appears more than once in the chain' WHEN count(*) FILTER (identity_reason IS NULL AND root = ticker) = 0 THEN 'Contract terms cannot be verified' END AS identity FROM chain_rows GROUP BY ticker, expiry, strike),
dates AS (SELECT ticker, expiry, CASE WHEN extract(day FROM expiry) % 7 > 0 THEN (extract(day FROM expiry) - 3) / 64.0::DOUBLE END AS rate, CASE extract(month FROM expiry) % 3 WHEN 0 THEN 'payer' WHEN 1 THEN 'nonpayer' ELSE 'unknown' END AS kind, DATE '1999-01-01' AS ex FROM (SELECT DISTINCT ticker, expiry FROM chain_rows)),
reasons AS (SELECT *, CASE WHEN expiry <= DATE '1996-01-01' THEN 'Same-day option quote timing cannot be verified' WHEN NOT coalesce(rate BETWEEN 0 AND 0.25::DOUBLE, false) THEN 'Dated Treasury rate is unavailable' ELSE """ + GATE.format(e="expiry") + """ END AS reason FROM dates)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    li, p = A.table(spark, d, "lineitem"), A.table(spark, d, "part")
    part = F.col("l_partkey")
    return li.join(p, part == F.col("p_partkey")).select(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("expiry"), (part % 50).alias("strike"), F.when(part % 9 > 0, F.col("p_brand")).otherwise("other").alias("root"), F.when(F.col("l_suppkey") % 10 == 0, "odd terms").alias("identity_reason"), F.when(F.col("l_returnflag") == "A", "call").otherwise("put").alias("side"), F.when(F.col("l_linenumber") % 3 == 0, "Option quote is crossed").alias("issue"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"))


def _expiries(rows: DataFrame) -> DataFrame:
    day, month = F.dayofmonth("expiry"), F.month("expiry") % 3
    e = rows.select("ticker", "expiry").distinct()
    return C.expiry_reasons(e.withColumns({"today": date("1996-01-01"), "rate": F.when(day % 7 > 0, (day - 3) / 64.0), "dividend": F.when(month == 0, "payer").when(month == 1, "nonpayer").otherwise("unknown"), "next_ex": date("1999-01-01")}))


@query(f"WITH {ROWS} SELECT ticker, expiry::VARCHAR AS expiry, reason FROM reasons")
def expiry_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return _expiries(_rows(spark, d)).select("ticker", F.col("expiry").cast("string").alias("expiry"), "reason")


@query(f"WITH {ROWS} SELECT key, line, coalesce(identity, reason, issue) AS blocked FROM chain_rows JOIN listed USING (ticker, expiry, strike) JOIN reasons USING (ticker, expiry)")
def pricing_selections(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return C.selections(rows, C.contract_issues(rows), _expiries(rows)).select("key", "line", "blocked")


SAVED = "saved AS (SELECT o_custkey AS key, o_orderdate AS created, CASE WHEN o_orderkey % 3 > 0 THEN 'm2' ELSE 'm1' END AS model, o_orderdate::DATE + (o_orderkey % 30)::INT AS session, o_orderkey AS id FROM orders), watches AS (SELECT DISTINCT o_custkey AS key, o_orderdate AS created FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {SAVED} SELECT id FROM saved s WHERE model = 'm2' AND session >= DATE '1997-06-01' AND EXISTS (SELECT 1 FROM watches w WHERE w.key = s.key AND w.created = s.created)")
def last_good_purge(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    o = _o(spark, d)
    saved = o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("created"), F.when(K % 3 > 0, "m2").otherwise("m1").alias("model"), F.date_add(F.to_date("o_orderdate"), (K % 30).cast("int")).alias("session"), K.alias("id"))
    watches = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("created"))
    return C.purged(saved, watches, "m2", "1997-06-01").select("id")


@query("WITH a AS (SELECT o_custkey AS key, max(o_orderdate) AS created FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS key, max(o_orderdate) AS created FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT key, CASE WHEN a.created IS NULL THEN 'added' WHEN b.created IS NULL THEN 'removed' ELSE 'renewed' END AS change FROM a FULL JOIN b USING (key) WHERE a.created IS DISTINCT FROM b.created")
def watch_changes(spark: SparkSession, d: str) -> DataFrame:
    o = _o(spark, d)
    latest = lambda rows: rows.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("created"))
    return C.watch_changes(latest(o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))), latest(o.filter("o_orderstatus = 'F'")))


@query("""WITH t AS (SELECT o_custkey AS key, o_orderdate AS t_at, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'itm' ELSE 'otm' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS close FROM orders),
  w AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN status END IGNORE NULLS) OVER u AS ks, last_value(close IGNORE NULLS) OVER u AS kc, last_value(close IGNORE NULLS) OVER p AS pc FROM t WINDOW u AS (PARTITION BY key ORDER BY t_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY key ORDER BY t_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT seq, coalesce(ks, status) AS stands, kc AS stands_close, coalesce(close IS NOT NULL AND pc <> close, false) AS revised FROM w""")
def outcome_revisions(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    m = K % 3
    rows = _o(spark, d).select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), K.alias("seq"), F.when(m == 0, "pending").when(m == 1, "itm").otherwise("otm").alias("status"), F.when(m > 0, K % 4).alias("close"))
    return C.outcome_revisions(rows).select("seq", "stands", "stands_close", "revised")


@query("""WITH w AS (SELECT o_orderkey AS key, o_orderdate + INTERVAL '16 hours' AS expiry_close FROM orders), t AS (SELECT l_orderkey AS key, max(l_shipdate::DATE) AS tried, arg_max(CASE WHEN l_linestatus = 'F' THEN 'valid' ELSE 'pending' END, (l_shipdate, l_linenumber, l_linestatus)) AS status FROM lineitem GROUP BY 1)
  SELECT key FROM w LEFT JOIN t USING (key) WHERE expiry_close + INTERVAL '30 minutes' <= TIMESTAMP '1998-06-01 16:30:00' AND (tried IS NULL OR tried < DATE '1998-06-01' OR status = 'pending')""")
def due_outcomes(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    w = _o(spark, d).select(K.alias("key"), (F.col("o_orderdate") + F.expr("INTERVAL '16' HOUR")).alias("expiry_close"))
    t = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("session"), F.when(F.col("l_linestatus") == "F", "valid").otherwise("pending").alias("status"), F.struct("l_shipdate", "l_linenumber", "l_linestatus").alias("at"))
    return C.due_outcomes(w, t, "1998-06-01 16:30:00", "1998-06-01").select("key")


@query("SELECT c_custkey AS ticker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01') ORDER BY sha256('1996-01-02:' || c_custkey) LIMIT 1")
def next_cohort_ticker(spark: SparkSession, d: str) -> DataFrame:
    done = _o(spark, d).filter(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("ticker"))
    return C.next_ticker(A.table(spark, d, "customer").select(F.col("c_custkey").alias("ticker")), done, "1996-01-02").select("ticker")


@query("SELECT o_orderkey AS key, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY sha256(o_orderdate::DATE || ':' || o_orderkey)) AS place FROM orders")
def day_permutation(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    return C.day_order(_o(spark, d).select(K.alias("key"), F.to_date("o_orderdate").alias("day")), "day").select("key", "place")


@query("""WITH r AS (SELECT *, count(*) OVER (PARTITION BY ticker, expiry) AS n, row_number() OVER (PARTITION BY ticker, expiry ORDER BY strike, seq) - 1 AS i FROM (SELECT p_brand AS ticker, date_trunc('month', l_shipdate)::DATE AS expiry, p_retailprice AS strike, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON p_partkey = l_partkey)),
  c AS (SELECT ticker, expiry, CASE WHEN n <= 40 THEN i ELSE floor(i * (n - 1) / 39)::BIGINT END AS i, i AS k FROM (SELECT DISTINCT ticker, expiry, n FROM r), range(40) t(i) WHERE i < n)
  SELECT r.ticker, r.expiry::VARCHAR AS expiry, seq, k, k % 4 = 3 AS held_out FROM r JOIN c ON r.ticker = c.ticker AND r.expiry = c.expiry AND r.i = c.i""")
def fit_quote_sample(spark: SparkSession, d: str) -> DataFrame:
    li, p = A.table(spark, d, "lineitem"), A.table(spark, d, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("ticker"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("expiry"), F.col("p_retailprice").alias("strike"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return C.fit_sample(rows).select("ticker", F.col("expiry").cast("string").alias("expiry"), "seq", "k", "held_out")


@query("SELECT l_orderkey AS key, CASE WHEN count(v) = count(*) THEN min(v) END AS v, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey END AS v FROM lineitem) GROUP BY 1")
def all_or_nothing_min(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_suppkey") % 6 > 0, F.col("l_suppkey")).alias("v"))
    return C.all_or_nothing(rows, ["key"], "v")


@query(f"""WITH t AS (SELECT o_orderpriority AS ticker, CASE o_orderkey % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'no_quote' END AS reason, CASE WHEN o_custkey % 4 = 0 THEN 'no_label' END AS unscored FROM orders),
  c AS (SELECT ticker, count(*) AS attempted, count(*) FILTER (reason IS NULL) AS issued, count(*) FILTER (reason IS NULL AND unscored IS NULL) AS scored FROM t GROUP BY 1), w AS (SELECT ticker, '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS reasons FROM (SELECT ticker, reason, count(*) AS n FROM t WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY 1)
  SELECT ticker, attempted, issued, scored, {up('(issued / attempted)', 10000)} AS issued_e4, {up('(scored / issued)', 10000)} AS scored_e4, reasons FROM c LEFT JOIN w USING (ticker)""")
def coverage_rates(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    rows = _o(spark, d).select(F.col("o_orderpriority").alias("ticker"), F.when(K % 5 == 0, "stale").when(K % 5 == 1, "no_quote").alias("reason"), F.when(F.col("o_custkey") % 4 == 0, "no_label").alias("unscored"))
    c = C.coverage_rates(rows, ["ticker"])
    return c.select("ticker", "attempted", "issued", "scored", M.half_up(F.col("issued_rate"), 10_000).alias("issued_e4"), M.half_up(F.col("scored_rate"), 10_000).alias("scored_e4"), "reasons")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderdate <= TIMESTAMP '1997-03-01 12:00:00' AND o_orderdate + to_hours(o_custkey % 72) <= TIMESTAMP '1997-03-01 12:00:00' AND o_orderdate::DATE + (o_orderkey % 60)::INT > DATE '1997-03-01' AND o_orderdate::DATE + (o_orderkey % 60)::INT <= DATE '1997-03-31'")
def known_schedules(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    s = _o(spark, d).select(K.alias("key"), F.col("o_orderdate").alias("accepted_at"), (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_custkey") % 72)).alias("retrieved_at"), F.date_add(F.to_date("o_orderdate"), (K % 60).cast("int")).alias("event"))
    return C.known_schedules(s, "1997-03-01 12:00:00", "1997-03-31").select("key")


HOURS = "hours_open AS (SELECT session, session::TIMESTAMP + INTERVAL '570 minutes' AS open_at, session::TIMESTAMP + CASE WHEN ordinal % 20 = 0 THEN INTERVAL '13 hours' ELSE INTERVAL '16 hours' END AS close_at FROM cal WHERE isodow(session) < 6)"


@query(sql("cal", f"""WITH {HOURS}, q AS (SELECT o_orderkey AS key, o_orderdate::DATE AS completed, o_orderdate::DATE + (o_orderkey % 40)::INT AS expiry, o_orderdate + to_hours(17 + o_custkey % 200) AS q_at FROM orders),
  s AS (SELECT key, any_value(c.close_at) AS start_at, max(h.session) AS last_session, max(h.close_at) AS end_at, any_value(q_at) AS q_at, any_value(completed) AS completed, sum(epoch(h.close_at) - epoch(h.open_at)) FILTER (h.session > completed) AS total, sum(greatest(0, epoch(h.close_at) - greatest(epoch(q_at), epoch(h.open_at)))) FILTER (h.session > completed) AS remaining FROM q LEFT JOIN hours_open c ON c.session = q.completed JOIN hours_open h ON h.session BETWEEN q.completed AND q.expiry GROUP BY key)
  SELECT q.key, CASE WHEN start_at IS NOT NULL AND last_session > s.completed AND s.q_at >= start_at AND s.q_at < end_at AND total > 0 THEN {up('(remaining / total)', 1000000)} END AS fraction_e6 FROM q LEFT JOIN s USING (key)"""))
def remaining_variance(spark: SparkSession, d: str) -> DataFrame:
    K = F.col("o_orderkey")  # noqa: N806
    at = F.col("session").cast("timestamp_ntz")
    hours = A.calendar(spark, d).filter(F.weekday("session") < 5).select("session", (at + F.expr("INTERVAL '9:30' HOUR TO MINUTE")).alias("open_at"), (at + F.make_dt_interval(hours=F.when(F.col("ordinal") % 20 == 0, 13).otherwise(16))).alias("close_at"))
    q = _o(spark, d).select(K.alias("key"), F.to_date("o_orderdate").alias("completed"), F.date_add(F.to_date("o_orderdate"), (K % 40).cast("int")).alias("expiry"), (F.col("o_orderdate") + F.make_dt_interval(hours=17 + F.col("o_custkey") % 200)).alias("at"))
    return H.remaining_fraction(q, hours).select("key", M.half_up(F.col("fraction"), 1_000_000).alias("fraction_e6"))


SAMPLES = "samples AS (SELECT o_orderpriority AS ticker, o_orderdate::DATE AS origin, o_orderdate::DATE + (5 + o_custkey % 20)::INT AS maturity, (o_orderkey * 37 % 401 - 200) / 100.0::DOUBLE AS z, o_orderkey AS key FROM orders), check_ AS (SELECT ticker, origin AS day, z, key FROM samples WHERE key % 7 = 0)"


def _samples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    K = F.col("o_orderkey")  # noqa: N806
    day = F.to_date("o_orderdate")
    s = _o(spark, d).select(F.col("o_orderpriority").alias("ticker"), day.alias("origin"), F.date_add(day, (5 + F.col("o_custkey") % 20).cast("int")).alias("maturity"), ((K * 37 % 401 - 200) / 100.0).alias("z"), K.alias("key"))
    return s, s.filter("key % 7 = 0").select("ticker", F.col("origin").alias("day"), "z", "key")


@query(f"WITH {SAMPLES}, o AS (SELECT DISTINCT ticker, day FROM check_) SELECT o.ticker, day::VARCHAR AS day, count(s.z) AS n, count(*) FILTER (s.z > 0.5::DOUBLE) AS above, count(*) FILTER (s.z < -1) AS below FROM o LEFT JOIN samples s ON s.ticker = o.ticker AND maturity < day AND origin >= day - 1096 GROUP BY ALL")
def prior_samples(spark: SparkSession, d: str) -> DataFrame:
    s, check = _samples(spark, d)
    return H.prior_counts(s, check, ["ticker"]).select("ticker", F.col("day").cast("string").alias("day"), "n", F.col("above4").alias("above"), F.col("below1").alias("below"))


@query(f"""WITH {SAMPLES}, n AS (SELECT c.key, c.ticker, day, c.z, count(*) AS n FROM check_ c JOIN samples s ON s.ticker = c.ticker AND maturity < day AND origin >= day - 1096 GROUP BY ALL HAVING count(*) >= 20),
  g AS (SELECT n.*, t, side, CASE WHEN side = 'call' THEN n.z > t ELSE n.z < t END AS hit, (SELECT count(*) FILTER (CASE WHEN side = 'call' THEN s.z > t ELSE s.z < t END) FROM samples s WHERE s.ticker = n.ticker AND s.maturity < n.day AND s.origin >= n.day - 1096) / n.n AS chance FROM n, (VALUES (-1.5::DOUBLE), (-1.0), (-0.5), (0.0), (0.5), (1.0), (1.5)) v(t), (VALUES ('call'), ('put')) x(side))
  SELECT ticker, t AS threshold, side, count(*) AS records, sum(hit::INT)::BIGINT AS hits, {up('sum(chance)', 10000)} AS chance_sum_e4 FROM g GROUP BY ALL""")
def validation_records(spark: SparkSession, d: str) -> DataFrame:
    s, check = _samples(spark, d)
    r = H.validation_records(s, check, ["ticker"])
    return r.groupBy("ticker", "threshold", "side").agg(F.count("*").alias("records"), F.count_if("hit").alias("hits"), M.half_up(F.sum("chance"), 10_000).alias("chance_sum_e4"))


@query(sql("stocks", f"""WITH b AS (SELECT ticker, ts, close, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY ticker) AS size, day(ts) % 29 = 1 AS split FROM stocks WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
  o AS (SELECT DISTINCT ticker, floor(k * ((size - 26 - 60) / 11.0::DOUBLE) + 60)::BIGINT AS place FROM (SELECT DISTINCT ticker, size FROM b WHERE size > 85), range(12) r(k))
  SELECT a.ticker, a.ts::VARCHAR AS ts, h::INT AS horizon, {up('ln(c.close / a.close)', 100000)} AS target_e5 FROM b a JOIN o USING (ticker, place), range(1, 26) r(h) JOIN b c ON c.ticker = a.ticker AND c.place = a.place + h WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.ticker = a.ticker AND x.split AND x.place > a.place AND x.place <= a.place + h)"""))
def pooled_training_rows(spark: SparkSession, d: str) -> DataFrame:
    s = A.stocks(spark, d).select("ticker", "ts", "close", (F.dayofmonth("ts") % 29 == 1).cast("double").alias("split"))
    return H.training_rows(s).select("ticker", F.col("ts").cast("string").alias("ts"), "horizon", M.half_up(F.col("target"), 100_000).alias("target_e5"))


@query("SELECT count(*) AS days, count(*) FILTER (m IS NULL) AS non_sessions, count(*) FILTER (m < 390) AS early, count(*) FILTER (m >= 390) AS regular FROM (SELECT DISTINCT o_orderdate, CASE WHEN isodow(o_orderdate) < 6 THEN CASE WHEN day(o_orderdate) % 10 = 0 THEN 210 ELSE 390 END END AS m FROM orders)")
def calendar_strata(spark: SparkSession, d: str) -> DataFrame:
    days = _o(spark, d).select("o_orderdate").distinct()
    minutes = F.when(F.weekday("o_orderdate") < 5, F.when(F.dayofmonth("o_orderdate") % 10 == 0, 210).otherwise(390))
    s = V.stratum(minutes)
    return days.agg(F.count("*").alias("days"), F.count_if(s == "non_session").alias("non_sessions"), F.count_if(s == "early_close").alias("early"), F.count_if(s == "regular").alias("regular"))


GATE_SQL = f"CASE t {' '.join(f'WHEN {t}::DOUBLE THEN {n!r}::DOUBLE' for t, n in zip(H.GRID, H.NORMAL, strict=True))} END"


@query(f"""WITH {SAMPLES}, n AS (SELECT c.key, c.ticker, day, c.z, count(*) AS n FROM check_ c JOIN samples s ON s.ticker = c.ticker AND maturity < day AND origin >= day - 1096 GROUP BY ALL HAVING count(*) >= 20),
  g AS (SELECT n.*, t, side, CASE WHEN side = 'call' THEN n.z > t ELSE n.z < t END AS hit, (SELECT count(*) FILTER (CASE WHEN side = 'call' THEN s.z > t ELSE s.z < t END) FROM samples s WHERE s.ticker = n.ticker AND s.maturity < n.day AND s.origin >= n.day - 1096) / n.n AS chance FROM n, (VALUES (-1.5::DOUBLE), (-1.0), (-0.5), (0.0), (0.5), (1.0), (1.5)) v(t), (VALUES ('call'), ('put')) x(side)),
  b AS (SELECT *, CASE WHEN side = 'call' THEN 1 - {GATE_SQL} ELSE {GATE_SQL} END AS base FROM g),
  d AS (SELECT ticker, count(DISTINCT day) AS validated, avg((chance - hit::INT) ** 2 - (base - hit::INT) ** 2) AS brier_delta, avg(-ln(CASE WHEN hit THEN least(greatest(chance, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) ELSE 1 - least(greatest(chance, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) END) + ln(CASE WHEN hit THEN base ELSE 1 - base END)) AS log_delta FROM b GROUP BY ticker),
  k AS (SELECT ticker, count(DISTINCT origin) // 10 AS blocks FROM samples GROUP BY ticker)
  SELECT ticker, blocks, coalesce(validated, 0) AS validated, {up('brier_delta', 100000)} AS brier_e5, {up('log_delta', 10000)} AS log_e4, CASE WHEN blocks < 12 THEN 'insufficient_independent_blocks' WHEN coalesce(validated, 0) < 10 THEN 'insufficient_validation_blocks' WHEN NOT (brier_delta < -1e-6 AND log_delta <= 1e-12) THEN 'empirical_score_gate_failed' END AS reason FROM k LEFT JOIN d USING (ticker)""")
def empirical_gate(spark: SparkSession, d: str) -> DataFrame:
    s, check = _samples(spark, d)
    blocks = s.groupBy("ticker").agg(F.floor(F.count_distinct("origin") / 10).cast("long").alias("blocks"))
    g = H.empirical_gate(s, check, blocks, ["ticker"], 12, 10)
    return g.select("ticker", "blocks", "validated", M.half_up(F.col("brier_delta"), 100_000).alias("brier_e5"), M.half_up(F.col("log_delta"), 10_000).alias("log_e4"), "reason")


@query(sql("cal", f"WITH {HOURS} SELECT o_orderkey AS key, {up('CASE WHEN epoch(close_at) > epoch(q_at) THEN (epoch(close_at) - epoch(q_at)) / 31536000.0::DOUBLE END', 10000000)} AS years_e7 FROM (SELECT o_orderkey, o_orderdate::DATE + (o_orderkey % 40)::INT AS expiry, o_orderdate + to_hours(o_custkey % 200) AS q_at FROM orders) LEFT JOIN hours_open ON session = expiry"))
def years_to_close(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("session").cast("timestamp_ntz")
    hours = A.calendar(spark, d).filter(F.weekday("session") < 5).select("session", (at + F.make_dt_interval(hours=F.when(F.col("ordinal") % 20 == 0, 13).otherwise(16))).alias("close_at"))
    key = F.col("o_orderkey")
    rows = _o(spark, d).select(key.alias("key"), F.date_add(F.to_date("o_orderdate"), (key % 40).cast("int")).alias("expiry"), (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_custkey") % 200)).alias("at"))
    return H.years_to_close(rows, hours).select("key", M.half_up(F.col("years"), 10_000_000).alias("years_e7"))


@query("SELECT l_orderkey AS key, l_linenumber AS line, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS place FROM lineitem) WHERE place <= 3")
def latest_fetch_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), "l_suppkey", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return C.latest_few(rows, ["l_suppkey"], "l_shipdate", "seq").select("key", "line", F.col("place").cast("long").alias("place"))
