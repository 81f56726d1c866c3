"""Every registered query against its SQL on the smallest tables, in any row order."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from strikeloom.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"pooled_model", "gjr_candidate", "markov_candidate", "egarch_candidate", "skew_candidate", "forecast_candidates"}


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return int(value)
    return value.item() if hasattr(value, "item") else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_repeats(spark, sf, name):
    first, second = (QUERIES[name](spark, sf).toPandas() for _ in range(2))
    assert len(first)
    assert rows(first) == rows(second)
