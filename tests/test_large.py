"""What keeps queries in proportion to their input on large tables: rows that are read once, states without Python, lookups that aren't shuffled."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from strikeloom.operators import chain, context, inference, quantiles, studies, wheel
from strikeloom.streaming import capture


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_capture_states_without_python(spark):
    events = spark.createDataFrame([(1, "a", "missed"), (1, "a", "captured"), (1, "a", "pending"), (1, "b", "pending"), (2, "a", "missed"), (2, "a", "pending")], "contract long, session string, state string")
    got = capture.capture_states(events)
    assert "Pandas" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "a", "captured", 3), (1, "b", "pending", 1), (2, "a", "missed", 2)]


def test_rule_metrics_make_the_joins_behind_them_once(spark):
    day = F.lit(datetime.date(2000, 1, 3))
    rows = spark.range(40).select((F.col("id") % 2).alias("rule"), day.alias("origin"), day.alias("expiry"), (F.col("id") % 3 > 0).alias("traded"), (F.col("id") / 100.0).alias("ret"), F.lit(0.0).alias("baseline_ret"), F.lit(2).alias("days"), (F.col("id") / 50.0).alias("cushion"))
    got = inference.rule_metrics(rows, ["rule"])
    assert "Range" not in plan(got)
    assert sorted((r.rule, r.dates, r.traded, round(r.median, 9)) for r in got.collect()) == [(0, 20, 13, 0.19), (1, 20, 13, 0.2)]


def test_descriptives_make_their_cells_once(spark):
    day = datetime.date(2000, 1, 3)
    keys = [F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("ticker"), *[F.lit("x").alias(c) for c in wheel.CELL[1:]]]
    rows = spark.range(12).select(*keys, F.date_add(F.lit(day), (F.col("id") % 3).cast("int")).alias("origin"), F.when(F.col("id") > 1, F.lit(day)).alias("expiry"), F.lit(True).alias("scored"), F.lit(0.5).alias("ret"), F.lit(0.25).alias("time_yield"))
    got = wheel.capture_descriptives(rows)
    assert "Range" not in plan(got)
    found = [(r.level, r.ticker, r.cells, r.origins, r.expiries, r.contracts, r.mean_return) for r in got.collect()]
    assert {x for x in found if x[0] in (0, 4)} == {(0, "a", 4, 3, 1, 6, 0.5), (0, "b", 4, 3, 1, 6, 0.5), (4, None, 8, 3, 1, 12, 0.5)}


def test_lookups_of_candidates_are_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        days = spark.sql("select 1L as contract, 'a' as ticker, 'call' as side, date'2000-01-03' as session, date'2000-01-05' as expiry, 90D as strike, 1D as mark, 5L as volume, true as valid, false as reconciliation_failed, 1D as opening")
        stocks = spark.sql("select 'a' as ticker, explode(sequence(date'2000-01-03', date'2000-01-05')) as session, 100D as open, 101D as close, 0D as action")
        got = wheel.candidates(days.union(days.withColumn("session", F.date_add("session", 1))), stocks, stocks.select("session"))
        # of the six lookups only that of the contract's next day is dealt by key
        assert sum("Join" in line for line in plan(got).split("Physical Plan")[1].splitlines()) - sum("BroadcastHashJoin" in line for line in plan(got).split("Physical Plan")[1].splitlines()) == 1
        assert sorted((str(r.session), r.status, r.reason) for r in got.collect()) == [("2000-01-03", "scored", None), ("2000-01-04", "no_entry", "missing_opening_bucket")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_panel_takes_known_distances_before_unknown_ones(spark):
    rows = [("a", "call", 100.0, 0.0, 50, 1), ("a", "call", 105.0, 100.0, 60, 2), ("a", "call", 95.0, 100.0, 60, 3), ("a", "put", 100.0, None, 50, 4), ("b", "put", 90.0, 100.0, 0, 5)]
    got = {(r.ticker, r.band, r.side, r.target): (r.gap, r.id) for r in chain.panel_cells(spark.createDataFrame(rows, "ticker string, side string, strike double, spot double, dte int, id int"), ["id"]).collect()}
    assert len(got) == 60
    assert got["a", 0, "call", 0] == (5_000_000, 2) and got["a", 0, "call", -10] == (5_000_000, 3) and got["a", 0, "put", 0] == (None, 4)
    assert got["a", 1, "call", 0] == (None, None) and got["b", 0, "put", 0] == (None, None)


def test_grid_is_made_without_a_function_per_entry_and_cell(spark):
    sides = ["call", "put", None]
    entries = spark.createDataFrame([(x, 100.0, 95.0, 1.0, 101.0) for x in sides], "side string, strike double, entry double, premium double, close double")
    grid = studies.cost_grid(entries)
    assert "lambda" not in plan(grid)
    assert {r["side"]: r["count"] for r in grid.groupBy("side").count().collect()} == {"call": 24, "put": 8, None: 8}
    assert {r["side"]: r["count"] for r in studies.cost_grid(entries, slippage=(10,)).groupBy("side").count().collect()} == {"call": 8}


def test_summary_counts_in_steps_of_any_size(spark):
    values = [x * s for s in (1e-9, 1e-3, 1.0, 1e12) for x in (-2.0, -1.0, 0.0, 0.5, 3.0)] * 7 + [None, float("inf")]
    rows = spark.createDataFrame([(g, x, x, None if x is None else x > 0) for g in ("a", None) for x in values], "g string, ret double, excess double, assigned boolean")
    placed = [r.b for r in rows.filter("ret is not null").select("ret", quantiles.stepped(F.col("ret")).alias("b")).orderBy("ret").collect()]
    assert placed == sorted(placed)
    known = sorted(x for x in values if x is not None)
    got = {r.g: r for r in studies.strategy_summary(rows, ["g"]).collect()}
    assert set(got) == {"a", None}
    for r in got.values():
        assert (r.n, r.q05, r.assigned) == (142, known[-(-len(known) * 5 // 100) - 1], sum(x > 0 for x in known) / 141)
        assert r.losses == sum(x < 0 for x in known) / 141


def test_fit_sample_orders_only_the_steps_that_hold_a_place(spark):
    groups = {("a", 1): [float(i % 97) for i in range(500)], ("a", 2): [5.0] * 300, (None, 1): [float(i) for i in range(40)], ("b", 1): [None, *[100 + i / 7 for i in range(41)]], ("b", 2): [1.0]}
    rows = [(t, e, x, seq) for (t, e), xs in groups.items() for seq, x in enumerate(xs)]
    got = context.fit_sample(spark.createDataFrame(rows, "ticker string, expiry int, strike double, seq int").repartition(5))
    assert all("bucket_" in line for line in plan(got).split("Physical Plan")[1].splitlines() if "row_number" in line)
    want = set()
    for (t, e), xs in groups.items():
        n, ordered = len(xs), sorted(enumerate(xs), key=lambda p: (p[1] is None, p[1] or 0.0, p[0]))
        places = range(n) if n <= 40 else [k * (n - 1) // 39 for k in range(40)]
        want |= {(t, e, ordered[i][1], ordered[i][0], k, k % 4 == 3) for k, i in enumerate(places)}
    assert got.columns == ["ticker", "expiry", "strike", "seq", "k", "held_out"]
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
