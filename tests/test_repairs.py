"""Cells, groups and texts that were once lost: null volumes, null groups, zero closes, deep markup, quantiles in no one buffer."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeloom.functions.text import page_text
from strikeloom.operators import archive, quantiles, studies
from strikeloom.operators.pricing import captured


def test_cells_without_a_known_volume_stay(spark):
    schema = "ticker string, side string, dte_band string, strike_band string, hour int, regular boolean, valid boolean, reason string, contract long, session date, volume long, transactions long"
    rows = spark.createDataFrame([("A", "call", "x", "near", 9, True, True, None, 1, None, None, None), ("B", None, None, "near", None, None, True, None, 1, None, 4, 1)], schema)
    got = {r.ticker: r for r in archive.hour_activity(rows).collect()}
    assert got["A"].bars == 1 and got["A"].median_volume is None and got["B"].median_volume == 4


def test_null_groups_have_frontiers_and_quantiles(spark):
    rows = [(None, 1.0, 5.0), (None, 2.0, 4.0), (None, 1.0, 6.0), ("a", 3.0, 3.0), ("a", 2.0, 3.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, high double, low double")
    assert sorted(map(tuple, studies.pareto(df, ["ticker"], "high", "low").collect()), key=str) == [("a", 3.0, 3.0), (None, 2.0, 4.0)]
    got = {r.ticker: r.m for r in quantiles.continuous_quantiles(df, ["ticker"], "high", {"m": 0.5}).collect()}
    assert got == {None: 1.0, "a": 2.5}


@pytest.mark.parametrize("buckets", [1, 1000])
def test_quantiles_are_those_of_numpy(spark, monkeypatch, buckets):
    real = quantiles.ordered_values
    monkeypatch.setattr(quantiles, "ordered_values", lambda *a: real(*a, buckets))
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], 40), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs] + [("d", None)], "k string, x double")
    shares = {"p05": 0.05, "p33": 1 / 3, "p50": 0.5, "p100": 1.0}
    got = {r.k: r for r in quantiles.continuous_quantiles(df, ["k"], "x", shares).collect()}
    assert set(got) == set(values)
    for k, xs in values.items():
        assert [got[k][n] for n in shares] == pytest.approx(list(np.quantile(xs, list(shares.values()))))
    whole = quantiles.continuous_quantiles(df, [], "x", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median(np.concatenate(list(values.values()))))


def test_many_groups_are_shuffled_with_the_same_result(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 1000).cast("double").alias("x"))
    want = sorted(map(tuple, quantiles.continuous_quantiles(df, ["k"], "x", {"m": 0.3}).collect()))
    monkeypatch.setattr(quantiles.counted, "__defaults__", (5,))
    assert sorted(map(tuple, quantiles.continuous_quantiles(df, ["k"], "x", {"m": 0.3}).collect())) == want


def test_no_division_by_zero(spark):
    entries = spark.createDataFrame([("call", 0.0, 0.0, 1.0, 2.0), ("put", 0.0, 5.0, 1.0, 2.0)], "side string, strike double, entry double, premium double, close double")
    grid = studies.cost_grid(entries).withColumn("days", F.lit(0))
    assert grid.filter("ret is null").count() == 32
    assert {r.n: r.reward for r in studies.reward_per_day(grid, ["side"]).collect()} == {24: None, 8: None}
    assert studies.strategy_summary(grid, ["side"]).count() == 2


PAGES = {
    "<p>AT&amp;T &lt;b&gt; &#233;&nbsp;x</p>": "AT&T <b> é x",
    "<script>if (a </s> b) { x = '</p>'; }</script>left": "left",
    "a<style>p{}</style >b": "a b",
    "<!-- <p> > -->x<!-- open": "x",
    '<a title="a > b" href=\'>\'>link</a>': "link",
    '<a title="open>link</a> tail': "link tail",
    "1 < 2 and 3<4": "1 < 2 and 3<4",
    "<p": "", "x <": "x <", "": "", "<scripty>kept</scripty>": "kept", "<SCRIPT>no</Script>yes": "yes",
}


@pytest.mark.parametrize("page", PAGES)
def test_page_text(page):
    assert page_text(page) == PAGES[page]


def test_pages_of_many_megabytes_take_linear_time():
    for page in ("<script>" + "<" * 5_000_000, "<" * 5_000_000, "<p>word &amp; </p>" * 600_000, "<!--" * 2_000_000, "<a '" * 2_000_000 + ">", '<b "> ' * 1_000_000 + "<i '>", "<script>x</script" * 500_000):
        began = time.process_time()
        page_text(page)
        assert time.process_time() - began < 15


def test_captures_meet_only_their_own_time(spark):
    """A contract with very many issuances: what is compared follows the matches."""
    at = lambda s: F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=s)
    targets = spark.range(300).select(F.lit(1).cast("long").alias("contract"), at((F.col("id") * 3600).cast("double")).alias("target"))
    issued = spark.range(20_000).select(F.lit(1).cast("long").alias("contract"), at((F.col("id") * 61).cast("double")).alias("issued_at")).filter("minute(issued_at) >= 2 or hour(issued_at) < 12")
    got = {r.target: r.state for r in captured(targets, issued).collect()}
    times = sorted(r.issued_at for r in issued.collect())
    import bisect
    import datetime

    assert len(got) == 300
    for target, state in got.items():
        k = bisect.bisect_left(times, target)
        assert (state == "captured") == (k < len(times) and times[k] < target + datetime.timedelta(minutes=5))
