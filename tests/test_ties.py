"""Large ranks, and results halfway between two steps of their rounding."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from strikeloom.functions import dist, money
from strikeloom.operators import chain, evidence, inference


def test_ranks_whose_squared_distance_is_no_int(spark):
    n = 50_000
    first = spark.range(n).select(F.lit("a").alias("g"), "id", (F.col("id") + 1).cast("int").alias("rank"))
    second = first.withColumn("rank", (n + 1 - F.col("rank")).cast("int"))
    assert [tuple(r) for r in chain.rank_stability(first, second, ["g"], ["id"]).collect()] == [("a", n, -10_000, 0)]


def test_scores_halfway_are_those_of_all_pairs(spark):
    prices = [93.3086, 97.0445, 103.3729, 119.8426]
    pairs = 0.0
    for a in reversed(prices):
        for b in prices:
            pairs += abs(a - b)
    want = sum(abs(a - 101.5) for a in prices) / 4 - pairs / 16 / 2
    df = spark.createDataFrame([(prices,)], "p array<double>")
    assert df.select(money.e4(dist.crps(F.col("p"), F.lit(101.5)))).first()[0] == 28450 == int(want * 10_000 + 0.5)


def test_unit_means_do_not_depend_on_the_order_of_cells(spark):
    scores = [0.1, 0.7, 0.3, 0.6]
    want = (((scores[0] + scores[1]) + scores[2]) + scores[3]) / 4
    cells = [("p", "m", "t", "2000-01-01", 3, "2000-01-04", i, x, x) for i, x in enumerate(scores)]
    columns = "panel string, model string, ticker string, origin string, horizon int, expiry string, contract int, brier double, base_brier double"
    for order in itertools.permutations(cells):
        (unit,) = inference.units(spark.createDataFrame(list(order), columns).coalesce(1), ["brier"]).collect()
        assert (unit.candidate, unit.baseline, unit.cells) == (want, want, 4)


def test_distributions_joined_to_closes_have_the_scores_of_all_pairs(spark):
    prices, day = [93.3086, 97.0445, 103.3729, 119.8426], "cast('2000-01-03' as date)"
    rows = spark.sql(f"select {day} as expiry_session, 'valid' as label_status, timestamp_ntz'2000-01-04 10:00:00' as label_checked_at, timestamp_ntz'2000-01-01 10:00:00' as issued_at, 'd' as distribution_hash, 101.5D as selected_close")
    closes = spark.sql(f"select {day} as session, timestamp_ntz'2000-01-03 16:00:00' as close_at")
    got = evidence.with_crps(rows, spark.createDataFrame([("d", prices)], "distribution_hash string, prices array<double>"), closes)
    assert got.select(money.e4(F.col("crps"))).first()[0] == 28450
