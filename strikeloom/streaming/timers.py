"""Streams with timers: label rechecks that come due by themselves, and captures fanned out to methods under a bound.

State lives in RocksDB and moves with the watermark, so what comes out doesn't
depend on how the input was cut into batches, and a restart goes on from the
checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strikeloom.streaming.capture import drain

HOUR, DAY = 3_600_000, 86_400_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LABELS = "contract long, checked_at long, revision long, status string, reason string, close double"


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """``drain`` with the state store that timers need; the session's own setting comes back."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return drain(stream, mode, name)
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def checked(first: float | None, second: float | None, slack: float = 0.005) -> tuple[str, str | None, float | None]:
    """Status, reason and close of a label from what two sources say at the time."""
    if first is None:
        return "pending", "no_first_source", None
    if second is None:
        return "pending", "no_second_source", None
    if abs(first - second) > slack:
        return "excluded", "sources_disagree", None
    return "valid", None, first


def framed(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame of the schema's types, texts as plain objects."""
    kinds = {"long": "int64", "int": "int32", "double": "float64", "string": object}
    columns = [part.split() for part in schema.split(", ")]
    return pd.DataFrame({name: pd.Series([None if isinstance(r[k], float) and r[k] != r[k] else r[k] for r in rows], dtype=kinds[kind]) for k, (name, kind) in enumerate(columns)})


class LabelTimers(StatefulProcessor):
    """A contract's label is checked when it expires, an hour after a check without success and a day after one with it, until ``keep`` after the expiry.

    Every check is a revision; it sees the latest close of each source that was
    there at its own time, however far the watermark has gone since. Then the state
    goes. Only the first expiry of a contract counts.
    """

    def __init__(self, keep: int = 3 * DAY):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.terms = handle.getValueState("terms", "expiry long, due long, revision long")
        self.closes = handle.getListState("closes", "at long, source int, close double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        # most contracts have a few rows: plain tuples cost less than a frame for each
        events = sorted((e for f in rows for e in zip(*(f[c].tolist() for c in ("at", "row", "source", "close", "expiry")), strict=True)), key=lambda e: e[:2])
        told = [(at, source, close) for at, _, source, close, _ in events if source in (1, 2)]
        if told:
            self.closes.appendList(told)
        terms = [expiry for *_, source, _, expiry in events if source == 0]
        if terms and not self.terms.exists():
            expiry = int(terms[0])
            self.terms.update((expiry, expiry, 0))
            self.handle.registerTimer(max(expiry, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        expiry, due, revision = self.terms.get()
        said = sorted(self.closes.get(), key=lambda c: c[0])
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while due <= now and due <= expiry + self.keep:
            last = {s: c for a, s, c in said if a <= due}
            revision += 1
            status, reason, close = checked(last.get(1), last.get(2))
            out.append((int(key[0]), due, revision, status, reason, close))
            due += DAY if status == "valid" else HOUR
        if due > expiry + self.keep:
            # the contract is done: nothing more is asked of it, and its closes go
            self.closes.clear()
            self.terms.update((expiry, due, revision))
        else:
            self.terms.update((expiry, due, revision))
            self.handle.registerTimer(due)
        return iter([framed(out, LABELS)] if out else [])

    def close(self) -> None:
        pass


def label_checks(events: DataFrame, keep: int = 3 * DAY, late: str = "1 minute") -> DataFrame:
    """LABELS rows of a stream of events (contract, at, row, source, close, expiry): source 0 brings a contract's expiry (milliseconds), 1 and 2 closes, others only the time."""
    rows = events.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    rows = rows.select("contract", F.col("at_ms").alias("at"), F.col("row").cast("long").alias("row"), F.col("source").cast("int").alias("source"), F.col("close").cast("double").alias("close"), F.col("expiry").cast("long").alias("expiry"), F.col("at").alias("event_time"))
    return rows.groupBy("contract").transformWithStateInPandas(LabelTimers(keep), outputStructType=LABELS, outputMode="Append", timeMode="EventTime")


ADMITTED = "ticker string, window long, contract long, row long, at long, data_hash string, horizon int, outcome string"


class Admission(StatefulProcessor):
    """Of a ticker's attempts within a window, each fingerprint is taken once, and ``most`` of them at most; the others leave as rows that say so.

    Attempts of a batch are taken in the order of their times. The fingerprints of a
    window are read and added once a batch, not one by one. The state of a window
    goes when the watermark has passed its end.
    """

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "fingerprint string")
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        frame = pd.concat(list(rows)).sort_values(["at", "contract", "row"])
        new = not self.taken.exists()
        n, seen = (0, set()) if new else (self.taken.get()[0], {mark for (mark,) in self.seen.get()})
        if new:
            self.handle.registerTimer(max(int(key[1]) + self.window, timerValues.getCurrentWatermarkInMs() + 1))
        outcomes, fresh = [], []
        for contract, data in zip(frame["contract"].tolist(), frame["data_hash"].tolist(), strict=True):
            mark = f"{contract}:{data}"
            if mark in seen:
                outcomes.append("duplicate")
                continue
            seen.add(mark)
            fresh.append((mark,))
            outcomes.append("taken" if n < self.most else "capacity")
            n += n < self.most
        if fresh:
            self.seen.appendList(fresh)
        self.taken.update((n,))
        frame["outcome"] = outcomes
        names = [c.split()[0] for c in ADMITTED.split(", ")]
        return iter([framed(list(frame[names].itertuples(index=False, name=None)), ADMITTED)])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.seen.clear()
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Methods that never have a candidate, with their reasons (fixed values).
NEVER = {"iv_physical": "rights_cleared_option_history_unavailable", "earnings_jump": "verified_release_time_history_unavailable"}


def fanned_out(attempts: DataFrame, candidates: DataFrame, methods: list[str], most: int = 8, window: int = HOUR, late: str = "1 minute", longest: int = 25, baseline: str = "lognormal") -> DataFrame:
    """Every attempt of a stream (contract, ticker, at, row, data_hash, horizon) as one row for each method, with ``outcome`` (issued, capacity, rejected) and ``reason``.

    Attempts have a contract; an unknown horizon is no obstacle. ``candidates`` (ticker, method, data_hash, fit_reason) is a static table of what was
    fitted, joined by ticker and method as it is at each batch. Attempts in a ticker's
    window beyond ``most`` leave as capacity rows, repeated fingerprints are rejected;
    so in each batch attempted = issued + capacity + rejected, method by method.
    """
    step = F.floor(F.unix_millis("at") / window) * window
    rows = attempts.withWatermark("at", late).select("ticker", step.cast("long").alias("window"), F.col("contract").cast("long").alias("contract"), F.col("row").cast("long").alias("row"), F.unix_millis("at").alias("at"), "data_hash", F.coalesce(F.col("horizon").cast("int"), F.lit(0)).alias("horizon"), F.col("at").alias("event_time"))
    taken = rows.groupBy("ticker", "window").transformWithStateInPandas(Admission(most, window), outputStructType=ADMITTED, outputMode="Append", timeMode="EventTime")
    each = taken.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    known = candidates.select("ticker", "method", F.col("data_hash").alias("fitted_hash"), "fit_reason")
    each = each.join(known, ["ticker", "method"], "left")
    never = F.create_map(*[F.lit(x) for pair in NEVER.items() for x in pair])
    reason = (
        F.when(F.col("outcome") == "capacity", "shadow_capacity_exceeded").when(F.col("outcome") == "duplicate", "already_captured").when(F.col("data_hash").isNull(), "completed_close_forecast_unavailable")
        .when((F.col("horizon") > longest) & (F.col("method") != baseline), "candidate_horizon_unsupported").when(never[F.col("method")].isNotNull(), never[F.col("method")])
        .when(F.col("fitted_hash").isNull() & F.col("fit_reason").isNull(), "candidate_not_prepared").when(F.col("fit_reason").isNotNull(), F.col("fit_reason")).when(F.col("fitted_hash") != F.col("data_hash"), "input_vintage_changed")
    )
    outcome = F.when(F.col("outcome") == "capacity", "capacity").when(reason.isNull(), "issued").otherwise("rejected")
    return each.select("ticker", "contract", "row", "at", "method", outcome.alias("outcome"), reason.alias("reason"))


def replayed(rows: list[tuple], until: int, keep: int = 3 * DAY, check: Callable = checked) -> list[tuple]:
    """LABELS rows of (contract, at, row, source, close, expiry) events, checked in one go up to ``until``: what the stream must come to."""
    out = []
    for contract in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == contract), key=lambda r: (r[1], r[2]))
        terms = [r for r in own if r[3] == 0]
        if not terms:
            continue
        expiry = due = terms[0][5]
        n = 0
        while due <= min(until, expiry + keep):
            last = {r[3]: r[4] for r in own if r[3] and r[1] <= due}
            n += 1
            status, reason, close = check(last.get(1), last.get(2))
            out.append((contract, due, n, status, reason, close))
            due += DAY if status == "valid" else HOUR
    return out
