"""Announced and actual release dates; expected values follow the reference's rules and the cases of its tests."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strikeloom.functions import text as X

UTC = dt.datetime(2026, 9, 25, 20, 5)
LATER = "Acme will report third quarter 2026 financial results on October 29, 2026"
FORWARD = [
    (LATER + ".", ("2026-10-29", None, "2026Q3")),
    (LATER + " at 4:30 p.m. ET.", ("2026-10-29", "2026-10-29 20:30:00", "2026Q3")),
    (LATER + ". Filed at 4:30 p.m. ET.", ("2026-10-29", None, "2026Q3")),
    ("Acme plans to release earnings on Sept. 26, 2026 at 9 am Eastern Time", ("2026-09-26", "2026-09-26 13:00:00", None)),
    ("Acme expects to announce quarterly results for the 1st quarter 2027\n on Dec 1 2026 at 12 am EST", ("2026-12-01", "2026-12-01 05:00:00", "2027Q1")),
    ("Acme will report earnings on 2026-10-29.", None),
    ("Acme will report earnings on September 25, 2026.", None),
    ("Acme will report earnings on February 30, 2027.", None),
    (LATER + ". Beta will report earnings on November 2, 2026.", None),
    ("", None),
]
ACTUAL = [
    ("On Sept. 25, 2026, Acme Inc. announced its financial results.", "2026-09-25"),
    ("Acme released its financial results on Sept. 22, 2026. Thanks.", "2026-09-22"),
    ("Acme released its financial results on Sept. 21, 2026.", None),
    ("Acme released its financial results on September 26, 2026.", None),
    ("On September 25, 2026, Acme reported financial results; it will host a conference call.", "2026-09-25"),
    ("On September 25, 2026, Acme announced it will release financial results next week.", None),
    ("On September 25, 2026, Acme announced its earnings release date.", None),
    ("On September 25, 2026, Acme announced a new product. Financial results follow next week.", None),
    ("Acme reported earnings on September 25, 2026. Beta reported earnings on September 24, 2026.", None),
    ("word " * 30000 + "Co. reported earnings on September 25, 2026! " + "more " * 30000, "2026-09-25"),
]


def test_forward_schedules(spark):
    df = spark.createDataFrame([(i, t, UTC) for i, (t, _) in enumerate(FORWARD)], "i int, t string, at timestamp_ntz")
    x = X.forward_schedule(F.col("t"), F.col("at"), F.col("at"))
    rows = {r.i: r.x for r in df.select("i", x.alias("x")).collect()}
    for i, (text, want) in enumerate(FORWARD):
        got = rows[i] and (str(rows[i].event_date), rows[i].event_at and str(rows[i].event_at), rows[i].series_key)
        assert got == want, text
    early = df.select(X.forward_schedule(F.col("t"), F.col("at"), F.col("at") - F.expr("interval 1 second")).alias("x"))
    assert early.filter("x is not null").isEmpty()


def test_actual_results(spark):
    df = spark.createDataFrame([(i, t, UTC) for i, (t, _) in enumerate(ACTUAL)], "i int, t string, at timestamp_ntz")
    rows = {r.i: r.x for r in df.select("i", X.actual_results(F.col("t"), F.col("at"), F.col("at")).alias("x")).collect()}
    for i, (text, want) in enumerate(ACTUAL):
        assert (rows[i] and str(rows[i].event_date)) == want, text[:200]


@pytest.mark.parametrize(("text", "want"), [("March 3, 2025", "2025-03-03"), ("sept. 03 2025", "2025-09-03"), ("Feb. 29, 2024", "2024-02-29"), ("Feb. 29, 2025", "None"), ("May 0, 2025", "None"), ("2025-03-03", "None"), ("Marsh 3, 2025", "None")])
def test_event_date(spark, text, want):
    assert str(spark.createDataFrame([(text,)], "t string").select(X.event_date(F.col("t"))).first()[0]) == want
