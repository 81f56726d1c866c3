"""Queries over the reports of a contest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.functions import money as M
from strikeloom.operators import contest as T
from strikeloom.operators import inference as I
from strikeloom.plans.chain_queries import up
from strikeloom.plans.inference_queries import BASELINE, CONTEST, SCORES, _scores
from strikeloom.plans.oracle import sql
from strikeloom.plans.registry import query

#: A contract's attributes follow from its number, a row's latencies and regime from its own.
MORE = "CASE WHEN contract < 2 THEN 'call' ELSE 'put' END AS side, CASE contract % 2 WHEN 0 THEN 'near' ELSE 'far' END AS moneyness, CASE WHEN seq % 3 > 0 THEN 'calm' END AS regime, (seq * 7 % 300 - 5)::DOUBLE AS prepare_ms, CASE WHEN seq % 8 > 0 THEN (seq * 11 % 90)::DOUBLE END AS lookup_ms"
PLUS = CONTEST.replace("contest AS (SELECT *,", f"contest AS (SELECT *, {MORE},", 1) + """,
  pairs AS (SELECT j.*, c.side, c.moneyness, c.regime, b.crps AS crps_base, c.crps AS crps_candidate FROM judged j LEFT JOIN b USING (ticker, origin, horizon, contract) LEFT JOIN c USING (ticker, origin, horizon, contract) WHERE outcome = 'scored')"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    s, c = F.col("seq"), F.col("contract")
    return _scores(spark, d).select(
        "ticker", "origin", "horizon", "contract", F.col("model").alias("method"), "issued", "seq", "vintage", "crps", F.when(s % 17 > 0, F.col("p") + (s % 101 == 0).cast("int")).alias("probability"), F.when(s % 34 == 0, "stale_input").alias("reason"),
        F.when(s % 23 > 0, F.col("itm") != ((s % 29 == 0) & (F.col("model") == "har"))).alias("itm"), F.when(c < 2, "call").otherwise("put").alias("side"), F.when(c % 2 == 0, "near").otherwise("far").alias("moneyness"), F.when(s % 3 > 0, "calm").alias("regime"),
        (s * 7 % 300 - 5).cast("double").alias("prepare_ms"), F.when(s % 8 > 0, (s * 11 % 90).cast("double")).alias("lookup_ms"),
    )


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return I.evaluated(_rows(spark, d), BASELINE, "har", ("side", "moneyness", "regime"), ("crps",))


@query(sql("", f"""WITH {SCORES}, {PLUS}, kinds AS (SELECT *, CASE WHEN NOT has THEN 'orphan' WHEN vintage IS NOT DISTINCT FROM chosen AND (method = '{BASELINE}' OR vintage IS NOT NULL) THEN 'kept' ELSE 'later' END AS kind FROM own),
cells AS (SELECT ticker, origin, horizon, contract, max((kind = 'orphan')::INT) AS orphan, count(*) FILTER (kind = 'kept' AND method = '{BASELINE}') AS nb, count(*) FILTER (kind = 'kept' AND method = 'har') AS nc FROM kinds WHERE kind <> 'later' GROUP BY ALL)
SELECT (SELECT count(*) FROM kinds WHERE kind = 'later') AS later_vintages_excluded, count(*) AS cells_attempted, count(*) FILTER (orphan = 1) AS orphan_cells, sum(greatest(nb - 1, 0) + greatest(nc - 1, 0))::BIGINT AS duplicates_excluded, count(*) FILTER (nb > 0) AS baseline_attempted,
  (SELECT count(*) FROM b WHERE probability IS NOT NULL) AS baseline_available, (SELECT count(*) FROM b JOIN c USING (ticker, origin, horizon, contract) WHERE b.probability IS NOT NULL AND c.probability IS NOT NULL) AS candidate_available FROM cells"""))
def contest_attempts(spark: SparkSession, d: str) -> DataFrame:
    """How many attempts of a contest count, and why the others don't."""
    return T.attempt_counts(_rows(spark, d), BASELINE, "har")


@query(sql("", f"WITH {SCORES}, {PLUS}, u AS (SELECT side, least(floor(pc * 10), 9)::INT AS bin, ticker, origin, horizon, avg(pc) AS p, avg(seen::INT) AS y FROM pairs GROUP BY ALL) SELECT side, bin, count(*) AS units, {up('avg(p)', 100000)} AS forecast_e5, {up('(avg(y) + 1e-9::DOUBLE)', 100000)} AS observed_e5 FROM u GROUP BY ALL"))
def contest_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Calibration of the candidate by side, in tenths, over units."""
    c = T.calibration_by_side(_pairs(spark, d))
    return c.select("side", "bin", "units", M.half_up(F.col("forecast"), 100_000).alias("forecast_e5"), M.half_up(F.col("observed") + 1e-9, 100_000).alias("observed_e5"))


@query(sql("", f"""WITH {SCORES}, {PLUS}, x AS (SELECT ticker, origin, horizon, (pc - seen::INT) ** 2 - (pb - seen::INT) ** 2 AS delta, category, value FROM (SELECT *, unnest(['horizon', 'moneyness', 'regime']) AS category, unnest([horizon::VARCHAR, moneyness, regime]) AS value FROM pairs)),
u AS (SELECT category, value, ticker, origin, horizon, avg(delta) AS delta FROM x GROUP BY ALL) SELECT category, value, count(*) AS units, count(DISTINCT origin) AS dates, {up('avg(delta)', 100000)} AS delta_e5, count(*) >= 100 AND count(DISTINCT origin) >= 10 AS supported FROM u GROUP BY ALL"""))
def contest_subgroups(spark: SparkSession, d: str) -> DataFrame:
    """Brier advantage of the candidate by horizon, moneyness and regime, and whether there's enough support."""
    s = T.subgroups(_pairs(spark, d), ["horizon", "moneyness", "regime"])
    return s.select("category", "value", "units", "dates", M.half_up(F.col("brier_delta"), 100_000).alias("delta_e5"), "supported")


@query(sql("", f"WITH {SCORES}, {PLUS} SELECT ticker, origin::VARCHAR AS origin, horizon, count(*) AS contracts, {up('avg((pb - seen::INT) ** 2)', 100000)} AS brier_base_e5, {up('avg(crps_base) FILTER (crps_base IS NOT NULL AND crps_candidate IS NOT NULL)', 100000)} AS crps_base_e5, {up('avg(crps_candidate) FILTER (crps_base IS NOT NULL AND crps_candidate IS NOT NULL)', 100000)} AS crps_candidate_e5 FROM pairs GROUP BY ALL"))
def contest_crps(spark: SparkSession, d: str) -> DataFrame:
    """Brier score and CRPS of both sides in each unit, the latter where both have it."""
    u = T.unit_scores(_pairs(spark, d))
    e5 = lambda c: F.when(F.col(c).isNotNull(), M.half_up(F.col(c), 100_000))
    return u.select("ticker", F.col("origin").cast("string").alias("origin"), "horizon", "contracts", e5("brier_baseline").alias("brier_base_e5"), e5("crps_baseline").alias("crps_base_e5"), e5("crps_candidate").alias("crps_candidate_e5"))


@query(sql("", f"""WITH {SCORES}, {PLUS}, k AS (SELECT * FROM own WHERE has AND vintage IS NOT DISTINCT FROM chosen AND vintage IS NOT NULL AND method = 'har'),
t AS (SELECT 'prepare' AS label, arg_min(coalesce(prepare_ms, -1), (issued, seq)) AS ms FROM k GROUP BY ticker, origin UNION ALL SELECT 'lookup', arg_min(coalesce(lookup_ms, -1), (issued, seq)) FROM k GROUP BY ticker, origin, horizon)
SELECT label, count(*) AS n, {up('quantile_cont(ms, 0.5)', 1000)} AS p50_us, {up('quantile_cont(ms, 0.95)', 1000)} AS p95_us FROM t WHERE ms >= 0 GROUP BY label"""))
def contest_latency(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile of the candidate's preparation and lookup times."""
    r = T.latencies(_rows(spark, d), BASELINE, "har")
    return r.select("label", "n", M.half_up(F.col("p50"), 1000).alias("p50_us"), M.half_up(F.col("p95"), 1000).alias("p95_us"))
