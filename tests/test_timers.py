"""Streams with timers against a replay in one go, over several files and a restart; every attempt of a capture accounted for."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from strikeloom.streaming import timers as S
from strikeloom.streaming.capture import work_dir

T0 = 1_735_689_600_000  # a midnight, milliseconds
EVENT = "contract long, at timestamp, row long, source int, close double, expiry long"


def events():
    rng = random.Random(8)
    rows, n = [], 0
    for c in range(25):
        expiry = T0 + rng.randrange(0, 30) * S.HOUR
        rows.append((c, T0 + rng.randrange(0, 5 * S.HOUR), n, 0, None, expiry))
        rows.append((c, T0 + rng.randrange(6 * S.HOUR, 9 * S.HOUR), n + 1, 0, None, expiry + S.DAY))  # comes too late to count
        n += 2
        for _ in range(rng.randrange(6)):
            rows.append((c, T0 + rng.randrange(0, 130 * S.HOUR), n, rng.choice([1, 2]), rng.choice([10.0, 10.004, 11.0]), None))
            n += 1
    rows.append((99, T0 + 140 * S.HOUR, n, 1, 1.0, None))  # moves the clock
    return sorted(rows, key=lambda r: r[1])


def put(spark, rows, path, parts):
    size = -(-len(rows) // parts)
    for k in range(parts):
        part = [(c, dt.datetime.fromtimestamp(at / 1000, dt.UTC), *rest) for c, at, *rest in rows[k * size : (k + 1) * size]]
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted((r.contract, r.checked_at, r.revision, r.status, r.reason, r.close) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_labels_are_those_of_a_replay(spark, tmp_path, parts):
    rows = events()
    path = f"file://{tmp_path}/in"
    put(spark, rows, path, parts)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    got = rows_of(S.drained(S.label_checks(stream), f"labels-{parts}"))
    want = sorted(S.replayed(rows, rows[-1][1] - 60_000))
    assert got == want and len(want) > 300
    assert {r[3] for r in got} == {"valid", "pending", "excluded"}
    revised = defaultdict(list)
    for r in got:
        revised[r[0]].append(r[3])
    assert any("pending" in s and "valid" in s for s in revised.values())
    assert spark.conf.get(S.PROVIDER, None) != S.ROCKS


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    rows = events()
    path, home = f"file://{tmp_path}/in", work_dir(spark, "restart")
    spark.conf.set(S.PROVIDER, S.ROCKS)
    try:
        cut = 2 * len(rows) // 3
        for part in (rows[:cut], rows[cut:]):
            put(spark, part, path, 1)
            stream = S.label_checks(spark.readStream.schema(EVENT).parquet(path))
            query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).format("parquet").option("path", f"{home}/out").start()
            query.awaitTermination()
    finally:
        spark.conf.unset(S.PROVIDER)
    assert rows_of(spark.read.schema(S.LABELS).parquet(f"{home}/out")) == sorted(S.replayed(rows, rows[-1][1] - 60_000))


METHODS = ["lognormal", "gjr", "iv_physical", "student_t"]
ATTEMPT = "contract long, ticker string, at timestamp, row long, data_hash string, horizon int"


def test_every_attempt_is_accounted_for(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted(((rng.randrange(30), f"T{rng.randrange(2)}", T0 + rng.randrange(0, 6 * S.HOUR), n, rng.choice(["a", "b", None]), rng.choice([5, 40])) for n in range(300)), key=lambda r: r[2])
    path = f"file://{tmp_path}/in"
    for k in range(3):
        part = [(c, t, dt.datetime.fromtimestamp(at / 1000, dt.UTC), *rest) for c, t, at, *rest in rows[k * 100 : (k + 1) * 100]]
        spark.createDataFrame(part, ATTEMPT).coalesce(1).write.mode("append").parquet(path)
    fitted = spark.createDataFrame([("T0", "lognormal", "a", None), ("T0", "gjr", None, "gjr_history_short"), ("T1", "lognormal", "b", None)], "ticker string, method string, data_hash string, fit_reason string")
    stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", 1).parquet(path)
    got = S.drained(S.fanned_out(stream, fitted, METHODS, most=8), "fan-out").collect()
    seen, n, want = set(), Counter(), {}
    for contract, ticker, at, row, data, horizon in rows:
        window = (ticker, at // S.HOUR)
        mark = (*window, contract, data)
        base = "already_captured" if mark in seen else "shadow_capacity_exceeded" if n[window] >= 8 else None
        seen.add(mark)
        n[window] += base is None
        for m in METHODS:
            reason = base or ("completed_close_forecast_unavailable" if data is None else "candidate_horizon_unsupported" if horizon > 25 and m != "lognormal" else S.NEVER.get(m))
            if reason is None:
                fit = {("T0", "lognormal"): ("a", None), ("T0", "gjr"): (None, "gjr_history_short"), ("T1", "lognormal"): ("b", None)}.get((ticker, m))
                reason = "candidate_not_prepared" if fit is None else fit[1] or ("input_vintage_changed" if fit[0] != data else None)
            want[row, m] = reason
    assert {(r.row, r.method): r.reason for r in got} == want and len(got) == len(want)
    per_batch = defaultdict(Counter)
    for r in got:
        per_batch[r.batch][r.outcome] += 1
    assert sum(sum(c.values()) for c in per_batch.values()) == 1200 and {o for c in per_batch.values() for o in c} == {"issued", "capacity", "rejected"}
    assert all(sum(c.values()) % len(METHODS) == 0 for c in per_batch.values())


def test_admission_reads_its_fingerprints_once_a_batch():
    import pandas as pd

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Marks:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.rows)

        def appendList(self, rows):  # noqa: N802
            self.calls += 1
            self.rows += rows

    class Handle:
        def registerTimer(self, at):  # noqa: N802
            pass

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    a = S.Admission(2, S.DAY)
    a.handle, a.seen, a.taken = Handle(), Marks(), Value()
    batch = lambda contracts: iter([pd.DataFrame([("t", 0, c, i, i, "x", 3) for i, c in enumerate(contracts)], columns=["ticker", "window", "contract", "row", "at", "data_hash", "horizon"])])
    said = lambda contracts: [o for f in a.handleInputRows(("t", 0), batch(contracts), Now()) for o in f["outcome"]]
    assert said([1, 1, 2, 3]) == ["taken", "duplicate", "taken", "capacity"]
    assert said([3, 4, 1] * 50)[:3] == ["duplicate", "capacity", "duplicate"]
    assert a.seen.calls <= 4
