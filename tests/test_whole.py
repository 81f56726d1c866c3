"""Queries over whole tables: no row is left out by its key or rank."""

from __future__ import annotations

from strikeloom.plans.catalogue import QUERIES


#: Has order keys above 1,500; those of the smallest tables end there.
LARGER = "/root/testdata/sf0.01"


def test_cost_grid_has_every_order_key(spark):
    from strikeloom.plans.study_queries import _entries

    sizes = {r["side"]: r["count"] for r in _entries(spark, LARGER).groupBy("side").count().collect()}
    got = QUERIES["strategy_cost_grid_all"](spark, LARGER)
    assert got.count() == 24 * sizes["call"] + 8 * sizes["put"]
    assert got.filter("l_orderkey > 1500").select("l_orderkey").distinct().count() == _entries(spark, LARGER).filter("l_orderkey > 1500").select("l_orderkey").distinct().count() > 0
