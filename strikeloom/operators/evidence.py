"""What a ledger takes, and what an evaluation sees of it: row invariants, stable keys, and the scan by two clocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeloom.functions.dist import crps
from strikeloom.functions.money import classify, parse_watch_key
from strikeloom.operators.ledger import latest
from strikeloom.operators.pricing import first_reason
from strikeloom.operators.quantiles import matched

# fixed values: windows, terms and the source that a valid label names
WINDOWS = ("10:00", "13:00", "15:30")
TERMS = "standard_100"
SOURCE = "Nasdaq historical Close (Yahoo cross-check)"
#: What makes an issuance itself; times of issue and fetching and latencies don't.
STABLE = (
    "contract_key", "ticker", "root", "side", "expiration", "expiry_session", "strike_exact", "terms_note", "contract_since", "input_session", "model_version", "method", "data_hash", "distribution_hash",
    "price_basis", "spot_exact", "status", "itm_probability", "otm_probability", "atm_probability", "unavailable_reason", "provenance", "volatility_regime", "known_event_status", "quote_time", "quote_source", "quote_fetched_at",
    "quote_digest", "snapshot_window",
)
LABEL_STABLE = ("contract_key", "terms_note", "expiry_session", "checked_at", "status", "reason", "source", "first_close", "second_close", "selected_close", "classification")
_HEX = "^[0-9a-f]{64}$"


def row_key(fields: tuple[str, ...]) -> Column:
    """SHA-256 of the fields by name, nulls told apart from texts."""
    each = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("null"))) for c in sorted(fields)]
    return F.sha2(F.concat_ws(",", *each), 256)


def _number(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < 1e300)


def issuance_reason(terms: str = TERMS) -> Column:
    """The first rule that an issuance breaks, null if the ledger may take it.

    Columns are STABLE with input_retrieved_at, issued_at, prepare_ms and lookup_ms;
    times are without zone, in UTC.
    """
    c = F.col
    parsed = parse_watch_key(c("contract_key"))
    same = parsed["ticker"].eqNullSafe(c("ticker")) & parsed["root"].eqNullSafe(c("root")) & parsed["side"].eqNullSafe(c("side")) & parsed["expiry"].eqNullSafe(c("expiration")) & parsed["strike"].eqNullSafe(c("strike_exact").try_cast("decimal(18,3)"))
    chances = ("itm_probability", "otm_probability", "atm_probability")
    good = reduce(lambda a, b: a & b, [_number(p) & c(p).between(0, 1) for p in chances])
    total = sum((c(p) for p in chances), F.lit(0.0))
    none = reduce(lambda a, b: a & b, [c(p).isNull() for p in chances])
    full = reduce(lambda a, b: a & b, [c(x).isNotNull() & (c(x).cast("string") != "") for x in ("input_session", "input_retrieved_at", "model_version", "method", "data_hash", "distribution_hash", "price_basis", "spot_exact")])
    fetched = c("quote_fetched_at")
    available = c("status") == "available"
    return first_reason(
        (~same | parsed["ticker"].isNull(), "identity_inconsistent"), (c("expiry_session") > c("expiration"), "session_after_expiry"),
        (F.coalesce("terms_note", F.lit("")).eqNullSafe("") | ~F.coalesce(c("provenance").isin("as_issued", "immutable_replay"), F.lit(False)), "terms_or_provenance_missing"),
        (c("input_retrieved_at") > c("issued_at"), "input_after_issuance"), (c("quote_time") > c("issued_at"), "quote_after_issuance"), (c("quote_time").isNull() != c("quote_source").isNull(), "quote_time_without_source"),
        (fetched.isNotNull() & (c("quote_time").isNull() | (fetched < c("quote_time")) | (fetched > c("issued_at"))), "quote_fetch_out_of_order"),
        (c("quote_digest").isNotNull() & (fetched.isNull() | ~c("quote_digest").rlike(_HEX)), "quote_digest_unverified"), (~c("snapshot_window").isin(*WINDOWS), "snapshot_window_invalid"),
        (F.coalesce(c("prepare_ms") < 0, F.lit(False)) | F.coalesce(c("lookup_ms") < 0, F.lit(False)) | F.coalesce(F.isnan("prepare_ms"), F.lit(False)) | F.coalesce(F.isnan("lookup_ms"), F.lit(False)), "latency_invalid"),
        (available & ((c("root") != c("ticker")) | (c("terms_note") != terms)), "nonstandard_terms"), (available & ~good, "probabilities_invalid"), (available & (F.abs(total - 1) > 1e-8), "probabilities_not_a_partition"),
        (available & ~full, "evidence_missing"), (available & c("unavailable_reason").isNotNull(), "reason_on_available"),
        ((c("status") == "unavailable") & (~none | c("distribution_hash").isNotNull() | F.coalesce("unavailable_reason", F.lit("")).eqNullSafe("")), "unavailable_without_reason"),
        (~F.coalesce(c("status").isin("available", "unavailable"), F.lit(False)), "status_invalid"),
    )


def label_reason(source: str = SOURCE) -> Column:
    """The first rule that a label breaks, null if the ledger may take it; columns are LABEL_STABLE, closes as exact texts."""
    c = F.col
    parsed = parse_watch_key(c("contract_key"))
    price = lambda x: c(x).try_cast("decimal(18,6)")
    valid = c("status") == "valid"
    whole = price("selected_close").isNotNull() & price("first_close").isNotNull() & price("second_close").isNotNull() & c("classification").isNotNull() & (F.coalesce("reason", F.lit("")) == "") & c("source").eqNullSafe(source)
    other = F.coalesce(c("status").isin("pending", "excluded"), F.lit(False)) & (F.coalesce("reason", F.lit("")) != "") & (F.coalesce("classification", F.lit("")) == "") & c("selected_close").isNull()
    return first_reason(
        (parsed["ticker"].isNull() | (F.coalesce("terms_note", F.lit("")) == ""), "identity_invalid"), (valid & ~whole, "close_or_classification_missing"),
        (valid & ((price("selected_close") != price("first_close")) | (F.abs(price("first_close") - price("second_close")) > 0.005)), "closes_incoherent"),
        (valid & (c("classification") != classify(parsed["side"], price("selected_close"), parsed["strike"])), "classification_contradicts_close"), (~F.coalesce(valid, F.lit(False)) & ~other, "status_or_reason_invalid"),
    )


def admitted(rows: DataFrame, reason: Column, fields: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``reason`` and the ``idempotency_key`` of those without one; a key that came with the row must be its own."""
    given = F.col("idempotency_key") if "idempotency_key" in rows.columns else F.lit(None).cast("string")
    kept = [c for c in rows.columns if c != "idempotency_key"]
    out = rows.select(*kept, given.alias("given_"), row_key(fields).alias("key_"), reason.alias("broken_"))
    why = F.coalesce("broken_", F.when(F.col("given_") != F.col("key_"), "key_mismatch"))
    return out.select(*kept, why.alias("reason_refused"), F.when(why.isNull(), F.col("key_")).alias("idempotency_key"))


CONTRACT = ["contract", "terms_note", "expiry_session"]


def horizons(rows: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` with ``horizon``: sessions after ``start``, itself a session, up to ``end``; null where ``start`` is none.

    Each day between the first and the last session knows how many sessions there were up to it: a dimension of days, broadcast.
    """
    from pyspark.sql import Window as W

    span = sessions.agg(F.min("session").alias("a"), F.max("session").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    days = span.join(sessions.select(F.col("session").alias("day"), F.lit(1).alias("open")), "day", "left")
    days = days.withColumn("upto", F.count("open").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))
    first = F.broadcast(days.filter("open = 1").select(F.col("day").alias(start), F.col("upto").alias("from_")))
    last = F.broadcast(days.select(F.col("day").alias(end), F.col("upto").alias("to_")))
    return rows.join(first, start, "left").join(last, end, "left").withColumn("horizon", F.col("to_") - F.col("from_")).drop("from_", "to_")


def evaluation_rows(
    issues: DataFrame, labels: DataFrame, provenance: str = "as_issued", since: object | None = None, expiry_before: object | None = None, issued_before: object | None = None,
    methods: tuple[str, ...] | None = None, horizon_range: tuple[int, int] | None = None, sessions: DataFrame | None = None, label_as_of: object | None = None,
) -> DataFrame:
    """Issuances of a provenance, unavailable and unlabelled ones too, each with the label revision known last.

    Two clocks: issuances by ``issued_before`` (inclusive), labels by ``label_as_of``
    (inclusive). ``since`` bounds the input session, ``expiry_before`` the expiry's
    session (exclusive), ``horizon_range`` the sessions from one to the other.
    ``issues`` has CONTRACT, input_session, expiration, issued_at, method and
    provenance; ``labels`` CONTRACT, checked_at, status, reason, selected_close,
    classification and key. The latest revision of a contract is an aggregate,
    combined before it's shuffled; null contracts have no label.
    """
    if horizon_range is not None and not 1 <= horizon_range[0] <= horizon_range[1]:
        raise ValueError("evaluation horizon range must be positive and ordered")
    if horizon_range is not None and sessions is None:
        raise ValueError("a horizon range needs sessions")
    rows = issues.filter(F.col("provenance") == provenance)
    for limit, name, holds in ((since, "input_session", lambda a, b: a >= b), (expiry_before, "expiry_session", lambda a, b: a < b), (issued_before, "issued_at", lambda a, b: a <= b)):
        if limit is not None:
            rows = rows.filter(holds(F.col(name), F.lit(limit).cast(issues.schema[name].dataType)))
    if methods is not None:
        rows = rows.filter(F.col("method").isin(*methods) if methods else F.lit(False))
    if horizon_range is not None:
        rows = horizons(rows, sessions, "input_session", "expiration").filter(F.col("horizon").between(*horizon_range)).drop("horizon")
    if label_as_of is not None:
        labels = labels.filter(F.col("checked_at") <= F.lit(label_as_of).cast(labels.schema["checked_at"].dataType))
    last = latest(labels, CONTRACT, [F.col("checked_at"), F.col("key")]).select(
        *CONTRACT, F.col("checked_at").alias("label_checked_at"), F.col("status").alias("label_status"), F.col("reason").alias("label_reason"), "selected_close", "classification"
    )
    return rows.join(last, CONTRACT, "left").withColumn("observed_itm", F.when(F.col("label_status") == "valid", F.col("classification") == "itm"))


def with_crps(rows: DataFrame, distributions: DataFrame, closes: DataFrame) -> DataFrame:
    """``rows`` of ``evaluation_rows`` with ``crps`` of their distribution (``distribution_hash``) at the selected close.

    Scored are rows with a valid label that came after the issuance, issued before
    the close of the expiry's session (``closes``: session, close_at; days, broadcast).
    Each distribution and close is scored once, however many rows share them, and
    joined back; ``distributions``: distribution_hash, prices (sorted, of equal weight).
    """
    close_at = F.broadcast(closes.select(F.col("session").alias("expiry_session"), F.col("close_at").alias("close_at_")))
    rows = rows.join(close_at, "expiry_session", "left")
    due = (F.col("label_status") == "valid") & (F.col("label_checked_at") > F.col("issued_at")) & (F.col("issued_at") < F.col("close_at_"))
    rows = rows.withColumn("close_", F.when(due & F.col("distribution_hash").isNotNull(), F.col("selected_close"))).drop("close_at_")
    pairs = rows.filter("close_ is not null").select("distribution_hash", "close_").distinct()
    scores = pairs.join(distributions.select("distribution_hash", "prices"), "distribution_hash").select("distribution_hash", "close_", crps(F.col("prices"), F.col("close_").cast("double")).alias("crps"))
    return matched(rows, scores, ["distribution_hash", "close_"]).drop("close_")
