"""Mixing with a source that is tiny beside the others."""

from __future__ import annotations

import pytest

from strikeloom.llm import mixing


@pytest.mark.parametrize("small", [1, 3, 40])
def test_tiny_sources_keep_their_weight(spark, small):
    totals = {"tiny": small, "hot": 75_000_000_000, "other": 10_000_000_000}
    sources = spark.createDataFrame(list(totals.items()), "source string, n_tokens long")
    rows = {r.source: r for r in mixing.plan(mixing.weigh(sources), None).collect()}
    powers = {s: n ** rows["hot"].exponent for s, n in totals.items()}
    weights = {s: p / sum(powers.values()) for s, p in powers.items()}
    budget = max(n / weights[s] for s, n in totals.items())
    for s, n in totals.items():
        assert rows[s].weight == pytest.approx(weights[s], rel=1e-6)
        assert rows[s].quota >= n and rows[s].passes >= 1
        assert rows[s].quota == pytest.approx(max(n, weights[s] * budget), rel=1e-5, abs=1)
