"""Ledger invariants one by one, the two clocks of the evaluation scan, scores computed once."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strikeloom.operators import evidence as E

T0 = dt.datetime(2025, 3, 3, 15)
GOOD = {
    "contract_key": "w1:A:A:call:2025-04-17:10.500", "ticker": "A", "root": "A", "side": "call", "expiration": dt.date(2025, 4, 17), "expiry_session": dt.date(2025, 4, 17), "strike_exact": "10.5", "terms_note": E.TERMS, "contract_since": None,
    "input_session": dt.date(2025, 2, 28), "model_version": "v", "method": "m", "data_hash": "d", "distribution_hash": "h", "price_basis": "p", "spot_exact": "1", "status": "available", "itm_probability": 0.25, "otm_probability": 0.75, "atm_probability": 0.0,
    "unavailable_reason": None, "provenance": "as_issued", "volatility_regime": None, "known_event_status": None, "quote_time": T0 - dt.timedelta(minutes=5), "quote_source": "s", "quote_fetched_at": T0 - dt.timedelta(minutes=1), "quote_digest": "0f" * 32,
    "snapshot_window": "10:00", "input_retrieved_at": T0 - dt.timedelta(hours=1), "issued_at": T0, "prepare_ms": 1.0, "lookup_ms": None,
}
KINDS = {"contract_since": "date", "expiration": "date", "expiry_session": "date", "input_session": "date", "quote_time": "timestamp_ntz", "quote_fetched_at": "timestamp_ntz", "input_retrieved_at": "timestamp_ntz", "issued_at": "timestamp_ntz"} | dict.fromkeys(("itm_probability", "otm_probability", "atm_probability", "prepare_ms", "lookup_ms"), "double")
SCHEMA = ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in GOOD)
NONE = {"itm_probability": None, "otm_probability": None, "atm_probability": None, "distribution_hash": None, "status": "unavailable"}
later = T0 + dt.timedelta(seconds=1)
BROKEN = [
    ({}, None), (NONE | {"unavailable_reason": "why"}, None), ({"quote_time": None, "quote_source": None, "quote_fetched_at": None, "quote_digest": None, "snapshot_window": None}, None),
    ({"contract_key": "w1:A:A:put:2025-04-17:10.500"}, "identity_inconsistent"), ({"contract_key": None}, "identity_inconsistent"), ({"expiry_session": dt.date(2025, 4, 18)}, "session_after_expiry"),
    ({"terms_note": None}, "terms_or_provenance_missing"), ({"provenance": None}, "terms_or_provenance_missing"), ({"input_retrieved_at": later}, "input_after_issuance"), ({"quote_time": later}, "quote_after_issuance"),
    ({"quote_source": None}, "quote_time_without_source"), ({"quote_fetched_at": T0 - dt.timedelta(minutes=6)}, "quote_fetch_out_of_order"), ({"quote_fetched_at": later}, "quote_fetch_out_of_order"), ({"quote_fetched_at": None}, "quote_digest_unverified"),
    ({"quote_digest": "0F" * 32}, "quote_digest_unverified"), ({"snapshot_window": "9:00"}, "snapshot_window_invalid"), ({"prepare_ms": -1.0}, "latency_invalid"), ({"lookup_ms": float("nan")}, "latency_invalid"),
    ({"terms_note": "odd"}, "nonstandard_terms"), ({"itm_probability": float("nan")}, "probabilities_invalid"), ({"atm_probability": None}, "probabilities_invalid"), ({"itm_probability": 1.2}, "probabilities_invalid"),
    ({"itm_probability": 0.3}, "probabilities_not_a_partition"), ({"spot_exact": None}, "evidence_missing"), ({"unavailable_reason": "x"}, "reason_on_available"), (NONE, "unavailable_without_reason"),
    (NONE | {"unavailable_reason": "x", "distribution_hash": "h"}, "unavailable_without_reason"), ({"status": "maybe"}, "status_invalid"), ({"status": None}, "status_invalid"),
]


def test_issuances(spark):
    rows = [tuple((GOOD | change)[c] for c in GOOD) for change, _ in BROKEN]
    got = E.admitted(spark.createDataFrame(rows, SCHEMA).coalesce(1), E.issuance_reason(), E.STABLE).collect()
    assert [r.reason_refused for r in got] == [why for _, why in BROKEN]
    assert all((r.idempotency_key is None) == (r.reason_refused is not None) for r in got)
    assert len({r.idempotency_key for r in got[:3]}) == 3


def test_keys_leave_out_what_changes_from_run_to_run(spark):
    rows = [GOOD, GOOD | {"issued_at": later, "prepare_ms": 9.0}, GOOD | {"method": None}, GOOD | {"method": "null"}]
    df = spark.createDataFrame([tuple(r[c] for c in GOOD) for r in rows], SCHEMA).coalesce(1)
    keys = [r.idempotency_key for r in E.admitted(df, F.lit(None).cast("string"), E.STABLE).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
    wrong = E.admitted(df.withColumn("idempotency_key", F.lit(keys[0])), F.lit(None).cast("string"), E.STABLE).collect()
    assert [r.reason_refused for r in wrong] == [None, None, "key_mismatch", "key_mismatch"]


LABEL = {"contract_key": "w1:A:A:call:2025-04-17:10.500", "terms_note": "t", "expiry_session": "2025-04-17", "checked_at": "x", "status": "valid", "reason": None, "source": E.SOURCE, "first_close": "10.51", "second_close": "10.505", "selected_close": "10.510", "classification": "itm"}
LABELS = [
    ({}, None), ({"status": "pending", "reason": "r", "source": None, "selected_close": None, "classification": None}, None), ({"contract_key": "A"}, "identity_invalid"), ({"source": None}, "close_or_classification_missing"), ({"first_close": "x"}, "close_or_classification_missing"),
    ({"second_close": "10.5"}, "closes_incoherent"), ({"selected_close": "10.52"}, "closes_incoherent"), ({"classification": "otm"}, "classification_contradicts_close"), ({"status": "pending", "reason": "r"}, "status_or_reason_invalid"), ({"status": None}, "status_or_reason_invalid"),
]


def test_labels(spark):
    df = spark.createDataFrame([tuple((LABEL | change)[c] for c in LABEL) for change, _ in LABELS], ", ".join(f"{c} string" for c in LABEL)).coalesce(1)
    assert [r.reason_refused for r in E.admitted(df, E.label_reason(), E.LABEL_STABLE).collect()] == [why for _, why in LABELS]


@pytest.fixture(scope="module")
def ledger(spark):
    day = lambda n: dt.date(2025, 1, 1) + dt.timedelta(days=n)
    at = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    issues = [(c, "t", day(20), day(c % 4), day(20), at(c), "ab"[c % 2], "as_issued", f"h{c % 2}") for c in range(8)] + [(0, "t", day(20), None, day(20), at(0), "a", "immutable_replay", None), (None, "t", day(20), day(0), day(20), at(0), "a", "as_issued", "h0")]
    labels = [(c, "t", day(20), at(20 + k), "pending" if k < 2 else "valid", "r", 100.0 + k, "itm", f"{c}{k}") for c in range(6) for k in range(4)] + [(1, "u", day(20), at(30), "valid", None, 1.0, "otm", "z")]
    return (
        spark.createDataFrame(issues, "contract long, terms_note string, expiry_session date, input_session date, expiration date, issued_at timestamp_ntz, method string, provenance string, distribution_hash string"),
        spark.createDataFrame(labels, "contract long, terms_note string, expiry_session date, checked_at timestamp_ntz, status string, reason string, selected_close double, classification string, key string"),
    )


def test_two_clocks(spark, ledger):
    issues, labels = ledger
    every = E.evaluation_rows(issues, labels).collect()
    assert len(every) == 9 and sum(r.observed_itm is True for r in every) == 6 and all(r.selected_close == 103.0 for r in every if r.label_status)
    early = {r.contract: r for r in E.evaluation_rows(issues, labels, issued_before="2025-01-04", label_as_of="2025-01-22").collect()}
    assert set(early) == {0, 1, 2, 3, None} and early[0].label_status == "pending" and early[0].observed_itm is None and early[None].label_status is None
    assert {r.contract for r in E.evaluation_rows(issues, labels, methods=("b",), since="2025-01-02").collect()} == {1, 3, 5, 7}
    assert E.evaluation_rows(issues, labels, methods=()).count() == 0 and E.evaluation_rows(issues, labels, expiry_before="2025-01-21").count() == 0
    sessions = spark.createDataFrame([(dt.date(2025, 1, 1) + dt.timedelta(days=n),) for n in range(0, 40, 2)], "session date")
    # sessions are days 0, 2, 4, ...: from day 0 to day 20 ten, from day 2 nine; days 1 and 3 are none
    assert sorted(r.contract or -1 for r in E.evaluation_rows(issues, labels, horizon_range=(10, 10), sessions=sessions).collect()) == [-1, -1, 4]
    with pytest.raises(ValueError):
        E.evaluation_rows(issues, labels, horizon_range=(3, 2), sessions=sessions)


def test_each_distribution_is_scored_once(spark, ledger):
    issues, labels = ledger
    dists = spark.createDataFrame([("h0", [90.0, 110.0]), ("h1", [100.0])], "distribution_hash string, prices array<double>")
    closes = spark.createDataFrame([(dt.date(2025, 1, 21), dt.datetime(2025, 1, 21, 16))], "session date, close_at timestamp_ntz")
    rows = E.with_crps(E.evaluation_rows(issues, labels), dists, closes)
    got = {r.contract: r.crps for r in rows.collect()}
    assert len(got) == 9 and got[0] == pytest.approx(10 - 5) and got[1] == pytest.approx(3.0) and got[7] is None and got[None] is None
