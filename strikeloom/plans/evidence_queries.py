"""Queries over what the ledger takes and what an evaluation sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators import evidence as E
from strikeloom.plans.chain_queries import up
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query
from strikeloom.sources import adapters as A

#: Issuances made of orders, with rows that break each rule: expressions that both engines read.
ISSUE = {
    "ticker": "concat('T', cast(o_orderkey % 9 as string))", "root": "case when o_orderkey % 31 = 0 then 'X' else concat('T', cast(o_orderkey % 9 as string)) end", "side": "case when o_orderkey % 2 = 0 then 'call' else 'put' end",
    "expiration": "cast(o_orderdate as date) + cast(o_orderkey % 90 as int)", "expiry_session": "cast(o_orderdate as date) + cast(o_orderkey % 90 + case when o_orderkey % 41 = 0 then 1 else 0 end as int)",
    "strike_exact": "concat(cast(o_orderkey % 400 + 1 as string), '.500')", "terms_note": "case when o_orderkey % 29 = 0 then 'adjusted' when o_orderkey % 173 = 0 then '' else 'standard_100' end", "provenance": "case when o_orderkey % 3 = 0 then 'immutable_replay' when o_orderkey % 179 = 0 then 'guess' else 'as_issued' end",
    "contract_since": "cast(o_orderdate as date)", "input_session": "case when o_orderkey % 43 > 0 then cast(o_orderdate as date) end", "issued_at": "o_orderdate + interval '15' hour", "input_retrieved_at": "case when o_orderkey % 37 = 0 then o_orderdate + interval '16' hour else o_orderdate + interval '14' hour end",
    "model_version": "'v1'", "method": "case o_orderkey % 4 when 0 then 'gjr' when 1 then 'har' else 'baseline' end", "data_hash": "'d'", "distribution_hash": "case when o_orderkey % 7 > 0 then cast(o_custkey % 500 as string) end", "price_basis": "'close'", "spot_exact": "'1'",
    "status": "case when o_orderkey % 7 > 0 then 'available' when o_orderkey % 49 = 0 then 'odd' else 'unavailable' end", "itm_probability": "case when o_orderkey % 7 > 0 then (o_orderkey % 100) / 100.0 end", "otm_probability": "case when o_orderkey % 7 > 0 then case when o_orderkey % 47 = 0 then 0.5 else 1 - (o_orderkey % 100) / 100.0 end end",
    "atm_probability": "case when o_orderkey % 7 > 0 and o_orderkey % 53 > 0 then 0.0 end", "unavailable_reason": "case when o_orderkey % 7 = 0 and o_orderkey % 14 > 0 then 'no_history' when o_orderkey % 59 = 0 then 'odd' end", "volatility_regime": "'calm'", "known_event_status": "cast(null as string)",
    "quote_time": "case when o_orderkey % 61 = 0 then o_orderdate + interval '17' hour when o_orderkey % 5 > 0 then o_orderdate + interval '12' hour end", "quote_source": "case when o_orderkey % 5 > 0 and o_orderkey % 67 > 0 or o_orderkey % 61 = 0 then 'feed' end",
    "quote_fetched_at": "case when o_orderkey % 71 = 0 then o_orderdate + interval '11' hour when o_orderkey % 5 > 1 then o_orderdate + interval '13' hour end", "quote_digest": "case when o_orderkey % 73 = 0 then 'abc' when o_orderkey % 5 > 2 then repeat('a0', 32) end",
    "snapshot_window": "case when o_orderkey % 79 = 0 then '11:11' when o_orderkey % 6 = 0 then '10:00' end", "prepare_ms": "case when o_orderkey % 83 = 0 then -1.5 else 2.5 end", "lookup_ms": "cast(null as double)",
}
_DOUBLES = ("itm_probability", "otm_probability", "atm_probability", "prepare_ms", "lookup_ms")
KEY_SQL = "'w1:' || ticker || ':' || root || ':' || side || ':' || expiration::VARCHAR || ':' || strike_exact"
ISSUE_SQL = f"base AS (SELECT o_orderkey, o_custkey, {', '.join(f'({v})' + ('::DOUBLE' if k in _DOUBLES else '') + f' AS {k}' for k, v in ISSUE.items())} FROM orders), iss AS (SELECT *, CASE WHEN o_orderkey % 89 = 0 THEN 'w0' ELSE {KEY_SQL} END AS contract_key FROM base)"


def issuances(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders")
    base = rows.select("o_orderkey", "o_custkey", *[(F.expr(v).cast("double") if k in _DOUBLES else F.expr(v)).alias(k) for k, v in ISSUE.items()])
    key = M.watch_key(F.col("ticker"), F.col("root"), F.col("side"), F.col("expiration"), F.col("strike_exact"))
    return base.withColumn("contract_key", F.when(F.col("o_orderkey") % 89 == 0, "w0").otherwise(key))


def _key_sql(fields: tuple[str, ...], at: tuple[str, ...]) -> str:
    """The stable key in SQL; times as the other engine writes them."""
    text = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c in at else f"{c}::VARCHAR"
    return "sha256(" + " || ',' || ".join(f"'{c}=' || coalesce('''' || {text(c)} || '''', 'null')" for c in sorted(fields)) + ")"


REASON = f"""CASE WHEN contract_key = 'w0' THEN 'identity_inconsistent' WHEN expiry_session > expiration THEN 'session_after_expiry'
  WHEN terms_note = '' OR provenance NOT IN ('as_issued', 'immutable_replay') THEN 'terms_or_provenance_missing' WHEN input_retrieved_at > issued_at THEN 'input_after_issuance' WHEN quote_time > issued_at THEN 'quote_after_issuance'
  WHEN (quote_time IS NULL) <> (quote_source IS NULL) THEN 'quote_time_without_source' WHEN quote_fetched_at IS NOT NULL AND (quote_time IS NULL OR quote_fetched_at < quote_time OR quote_fetched_at > issued_at) THEN 'quote_fetch_out_of_order'
  WHEN quote_digest IS NOT NULL AND (quote_fetched_at IS NULL OR length(quote_digest) <> 64) THEN 'quote_digest_unverified' WHEN snapshot_window NOT IN ('10:00', '13:00', '15:30') THEN 'snapshot_window_invalid' WHEN prepare_ms < 0 THEN 'latency_invalid'
  WHEN status = 'available' AND (root <> ticker OR terms_note <> '{E.TERMS}') THEN 'nonstandard_terms' WHEN status = 'available' AND atm_probability IS NULL THEN 'probabilities_invalid' WHEN status = 'available' AND abs(itm_probability + otm_probability + atm_probability - 1) > 1e-8 THEN 'probabilities_not_a_partition'
  WHEN status = 'available' AND input_session IS NULL THEN 'evidence_missing' WHEN status = 'available' AND unavailable_reason IS NOT NULL THEN 'reason_on_available'
  WHEN status = 'unavailable' AND coalesce(unavailable_reason, '') = '' THEN 'unavailable_without_reason' WHEN status NOT IN ('available', 'unavailable') THEN 'status_invalid' END"""


@query(sql("", f"WITH {ISSUE_SQL}, r AS (SELECT *, {REASON} AS reason FROM iss) SELECT o_orderkey AS contract, reason, CASE WHEN reason IS NULL THEN {_key_sql(tuple(c for c in E.STABLE if c not in _DOUBLES), ('quote_time', 'quote_fetched_at'))} END AS key FROM r"))
def issuance_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Which issuances the ledger takes, the first rule that the others break, and the keys of the former (chances aside, which two engines write in two ways)."""
    rows = E.admitted(issuances(spark, d), E.issuance_reason(), tuple(c for c in E.STABLE if c not in _DOUBLES))
    return rows.select(F.col("o_orderkey").alias("contract"), F.col("reason_refused").alias("reason"), F.col("idempotency_key").alias("key"))


LABEL = {
    "terms_note": "case when l_suppkey % 61 = 0 then '' else 'standard_100' end", "expiry_session": "cast(l_shipdate as date)", "checked_at": "l_shipdate + interval '20' hour", "status": "case when l_partkey % 5 > 1 then 'valid' when l_partkey % 5 = 1 then 'pending' when l_partkey % 35 = 0 then 'odd' else 'excluded' end",
    "reason": "case when l_partkey % 5 > 1 then case when l_partkey % 23 = 0 then 'odd' end when l_partkey % 29 > 0 then 'source' end", "source": "case when l_partkey % 31 > 0 then 'Nasdaq historical Close (Yahoo cross-check)' end", "first_close": "concat(cast(l_partkey % 400 + 1 as string), '.50')",
    "second_close": "concat(cast(l_partkey % 400 + 1 as string), case when l_orderkey % 13 = 0 then '.51' else '.504' end)", "selected_close": "case when l_partkey % 5 > 1 then concat(cast(l_partkey % 400 + 1 as string), case when l_orderkey % 17 = 0 then '.6' else '.5' end) end",
}
LABEL_SQL = f"lab0 AS (SELECT *, {', '.join(f'({v}) AS {k}' for k, v in LABEL.items())} FROM lineitem), lab AS (SELECT *, 'w1:T:T:' || CASE WHEN l_orderkey % 2 = 0 THEN 'call' ELSE 'put' END || ':' || expiry_session::VARCHAR || ':' || (l_orderkey % 400 + 1) || '.500' AS contract_key, CASE WHEN status = 'valid' AND l_orderkey % 19 > 0 THEN CASE WHEN (CASE WHEN l_orderkey % 2 = 0 THEN l_partkey % 400 - l_orderkey % 400 ELSE l_orderkey % 400 - l_partkey % 400 END) > 0 THEN 'itm' WHEN l_partkey % 400 = l_orderkey % 400 THEN 'atm' ELSE 'otm' END WHEN status = 'valid' THEN 'itm' END AS classification FROM lab0)"
LABEL_WHY = """CASE WHEN terms_note = '' THEN 'identity_invalid' WHEN status = 'valid' AND (reason IS NOT NULL OR source IS NULL) THEN 'close_or_classification_missing'
  WHEN status = 'valid' AND (selected_close::DECIMAL(18,6) <> first_close::DECIMAL(18,6) OR abs(first_close::DECIMAL(18,6) - second_close::DECIMAL(18,6)) > 0.005) THEN 'closes_incoherent'
  WHEN status = 'valid' AND classification <> (CASE WHEN (CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (selected_close::DECIMAL(18,6) - (l_orderkey % 400 + 1.5)) > 0 THEN 'itm' WHEN selected_close::DECIMAL(18,6) = l_orderkey % 400 + 1.5 THEN 'atm' ELSE 'otm' END) THEN 'classification_contradicts_close'
  WHEN status <> 'valid' AND (status = 'odd' OR reason IS NULL) THEN 'status_or_reason_invalid' END"""


@query(sql("", f"WITH {LABEL_SQL} SELECT status, {LABEL_WHY} AS why, count(*) AS n, min(l_orderkey) AS first_contract FROM lab GROUP BY ALL"))
def label_invariants(spark: SparkSession, d: str) -> DataFrame:
    """How many labels of each status the ledger takes, and the first rule that the others break."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", *[F.expr(v).alias(n) for n, v in LABEL.items()])
    side = F.when(k % 2 == 0, "call").otherwise("put")
    up_ = F.when(k % 2 == 0, p % 400 - k % 400).otherwise(k % 400 - p % 400)
    kind = F.when(up_ > 0, "itm").when(up_ == 0, "atm").otherwise("otm")
    rows = rows.withColumns({"contract_key": M.watch_key(F.lit("T"), F.lit("T"), side, F.col("expiry_session"), k % 400 + F.lit(1.5)), "classification": F.when(F.col("status") == "valid", F.when(k % 19 > 0, kind).otherwise("itm"))})
    taken = E.admitted(rows, E.label_reason(), E.LABEL_STABLE)
    return taken.groupBy("status", F.col("reason_refused").alias("why")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_contract"))


#: Label revisions of orders' contracts: from line items, each checked when it was shipped.
REVISION = "SELECT l_orderkey AS contract, CASE WHEN o_orderkey % 29 = 0 THEN 'adjusted' WHEN o_orderkey % 173 = 0 THEN '' ELSE 'standard_100' END AS terms_note, ({session}) AS expiry_session, l_shipdate AS checked_at, CASE WHEN l_linestatus = 'F' THEN 'valid' ELSE 'pending' END AS status, CASE WHEN l_linestatus = 'F' THEN NULL ELSE 'source' END AS reason, 95.0::DOUBLE + l_partkey % 11 AS selected_close, CASE WHEN l_returnflag = 'R' THEN 'itm' ELSE 'otm' END AS classification, concat_ws('-', l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR) AS key FROM lineitem JOIN orders ON o_orderkey = l_orderkey".format(session=ISSUE["expiry_session"])


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "lineitem").join(A.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    good = F.col("l_linestatus") == "F"
    return rows.select(
        F.col("l_orderkey").alias("contract"), F.expr(ISSUE["terms_note"]).alias("terms_note"), F.expr(ISSUE["expiry_session"]).alias("expiry_session"), F.col("l_shipdate").alias("checked_at"), F.when(good, "valid").otherwise("pending").alias("status"), F.when(~good, "source").alias("reason"),
        (F.lit(95.0) + F.col("l_partkey") % 11).alias("selected_close"), F.when(F.col("l_returnflag") == "R", "itm").otherwise("otm").alias("classification"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]).alias("key"),
    )


def _seen(spark: SparkSession, d: str) -> DataFrame:
    issues = issuances(spark, d).withColumnRenamed("o_orderkey", "contract")
    return E.evaluation_rows(issues, _revisions(spark, d), since="1993-01-01", expiry_before="2001-01-01", issued_before="2000-06-30 15:00:00", methods=("gjr", "har"), horizon_range=(2, 60), sessions=A.calendar(spark, d), label_as_of="1999-01-01 00:00:00")


SEEN = f"""{ISSUE_SQL}, rev AS ({REVISION}), days AS (SELECT session AS day, ordinal FROM cal),
seen AS (SELECT i.* EXCLUDE (o_orderkey), i.o_orderkey AS contract, l.checked_at AS label_checked_at, l.status AS label_status, l.reason AS label_reason, l.selected_close, l.classification
  FROM iss i JOIN days a ON a.day = i.input_session ASOF JOIN days b ON i.expiration >= b.day
  LEFT JOIN (SELECT * FROM rev WHERE checked_at <= TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY contract, terms_note, expiry_session ORDER BY checked_at DESC, key DESC) = 1) l
    ON l.contract = i.o_orderkey AND l.terms_note = i.terms_note AND l.expiry_session = i.expiry_session
  WHERE provenance = 'as_issued' AND input_session >= DATE '1993-01-01' AND i.expiry_session < DATE '2001-01-01' AND issued_at <= TIMESTAMP '2000-06-30 15:00:00' AND method IN ('gjr', 'har') AND b.ordinal - a.ordinal BETWEEN 2 AND 60
    AND i.expiration <= (SELECT max(day) FROM days))"""


@query(sql("cal", f"WITH {SEEN} SELECT contract, method, status, label_status, label_reason, label_checked_at::DATE::VARCHAR AS label_day, CASE WHEN label_status = 'valid' THEN classification = 'itm' END AS observed_itm FROM seen"))
def evaluation_scan(spark: SparkSession, d: str) -> DataFrame:
    """Issuances known by one day with the labels known by another, by method, expiry and horizon."""
    return _seen(spark, d).select("contract", "method", "status", "label_status", "label_reason", F.to_date("label_checked_at").cast("string").alias("label_day"), "observed_itm")


@query(sql("cal dists", f"""WITH {SEEN}, due AS (SELECT contract, CASE WHEN label_status = 'valid' AND label_checked_at > issued_at AND issued_at < expiry_session::TIMESTAMP + INTERVAL '16 hours' THEN selected_close END AS c, distribution_hash FROM seen),
pairs AS (SELECT DISTINCT distribution_hash, c FROM due WHERE c IS NOT NULL AND distribution_hash IS NOT NULL), u AS (SELECT id::VARCHAR AS h, unnest(prices) AS x FROM dists WHERE id::VARCHAR IN (SELECT distribution_hash FROM pairs)),
half AS (SELECT a.h, avg(abs(a.x - b.x)) / 2 AS m FROM u a JOIN u b ON a.h = b.h GROUP BY 1), score AS (SELECT p.distribution_hash, p.c, avg(abs(u.x - p.c)) - any_value(half.m) AS crps FROM pairs p JOIN u ON u.h = p.distribution_hash JOIN half ON half.h = u.h GROUP BY 1, 2)
SELECT contract, {up('crps', 10000)} AS crps FROM due LEFT JOIN score USING (distribution_hash, c)"""))
def evaluation_crps(spark: SparkSession, d: str) -> DataFrame:
    """CRPS of each issuance seen whose label is valid and came after it; each distribution and close is scored once."""
    days = A.table(spark, d, "orders").select(F.explode(F.array(*[F.expr(ISSUE["expiry_session"])])).alias("session")).distinct()
    closes = days.withColumn("close_at", F.col("session").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(16)))
    dists = A.distributions(spark, d).select(F.col("id").cast("string").alias("distribution_hash"), "prices")
    return E.with_crps(_seen(spark, d), dists, closes).select("contract", F.when(F.col("crps").isNotNull(), M.e4(F.col("crps"))).alias("crps"))
