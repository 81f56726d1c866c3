"""Pages and pricing: what a page says of its chain, which expiries and contracts can be priced, watches and their last good odds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.functions import display as V
from strikeloom.operators.quantiles import matched, stepped
from strikeloom.sources.scratch import written

#: Steps of all expiries that may be broadcast; they are counted first.
MOST_STEPS = 200_000


def page_fields(chains: DataFrame, stock: DataFrame, lows: DataFrame, rate: float = 0.04) -> DataFrame:
    """One row for each ticker's page: reference price and its source, stock quote, lows, freshness, rate."""
    rows = chains.join(stock, "ticker", "left").join(lows, "ticker", "left").withColumn("ref", V.reference_price(F.col("bid"), F.col("last")))
    return rows.select("ticker", "ref.price", "ref.source", "bid", "ask", "truncated", *[c for c in lows.columns if c != "ticker"], F.lit(int(rate * 1000 + 0.5)).alias("rate_tenths"))


def block_reason(chains: DataFrame) -> DataFrame:
    """Why a chain can't support an entry quote, before any rate: chain_session, session, truncated, open, spot_reason, completed_close."""
    reason = (
        F.when(F.col("chain_session") != F.col("session"), "Option chain belongs to another quote session")
        .when(F.col("truncated"), "Option-chain coverage is incomplete")
        .when(F.col("open"), F.col("spot_reason"))
        .when(F.col("completed_close").isNull(), "Official completed-session close is unavailable")
    )
    return chains.withColumn("blocked", reason)


def expiry_reasons(expiries: DataFrame) -> DataFrame:
    """Why an expiry can't be priced: expiry, today, rate, dividend, next_ex. The first of same day, rate, dividend."""
    rate = F.coalesce(F.col("rate").between(0, 0.25) & ~F.isnan("rate"), F.lit(False))
    reason = F.when(F.col("expiry") <= F.col("today"), "Same-day option quote timing cannot be verified").when(~rate, "Dated Treasury rate is unavailable").otherwise(V.dividend_reason(F.col("dividend"), F.col("next_ex"), F.col("expiry")))
    return expiries.withColumn("reason", reason)


def contract_issues(rows: DataFrame) -> DataFrame:
    """Contracts (ticker, expiry, strike) of chain rows: how often each is listed and the issue of its identity, null if it's standard."""
    standard = F.count_if(F.col("identity_reason").isNull() & (F.col("root") == F.col("ticker")))
    out = rows.groupBy("ticker", "expiry", "strike").agg(F.count("*").alias("rows"), standard.alias("standard"))
    return out.withColumn("issue", F.when(F.col("rows") > 1, "Contract appears more than once in the chain").when(F.col("standard") == 0, "Contract terms cannot be verified")).drop("standard")


def selections(quotes: DataFrame, contracts: DataFrame, expiries: DataFrame) -> DataFrame:
    """Each quote (ticker, side, expiry, strike, issue) with the first thing that stands against it: identity, then expiry, then the quote itself."""
    own = contracts.select("ticker", "expiry", "strike", F.col("issue").alias("identity"))
    dates = expiries.select("ticker", "expiry", "reason")
    return quotes.join(own, ["ticker", "expiry", "strike"], "left").join(dates, ["ticker", "expiry"], "left").withColumn("blocked", F.coalesce("identity", "reason", "issue"))


def purged(saved: DataFrame, watches: DataFrame, version: str, completed: object) -> DataFrame:
    """Saved rows that stay: of this model version, not before the completed session, and of a watch (key and time) that there still is."""
    return saved.filter((F.col("model") == version) & (F.col("session") >= F.lit(completed).cast("date"))).join(watches.select("key", "created"), ["key", "created"], "left_semi")


def watch_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Keys whose watch came, went or was made anew."""
    both = before.select("key", F.col("created").alias("a")).join(now.select("key", F.col("created").alias("b")), "key", "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("renewed")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("key", kind.alias("change"))


def outcome_revisions(rows: DataFrame) -> DataFrame:
    """Attempts (key, at, status, close) with the result that stands after each: the last one with a close, and whether it differs from the one before it."""
    from pyspark.sql import Window as W

    w = W.partitionBy("key").orderBy("at", "seq")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    good = F.when(F.col("close").isNotNull(), F.struct("status", "close"))
    rows = rows.withColumns({"kept": F.last(good, True).over(upto), "prior": F.last(good, True).over(before)})
    revised = F.coalesce((F.col("close").isNotNull()) & (F.col("prior.close") != F.col("close")), F.lit(False))
    return rows.withColumns({"stands": F.coalesce("kept.status", "status"), "stands_close": F.col("kept.close"), "revised": revised}).drop("kept", "prior")


def due_outcomes(watches: DataFrame, attempts: DataFrame, now: object, session: object) -> DataFrame:
    """Watches whose expiry closed half an hour ago or earlier and that weren't tried this session, or are pending."""
    last = attempts.groupBy("key").agg(F.max("session").alias("tried"), F.max_by("status", "at").alias("status"))
    ready = F.col("expiry_close") + F.expr("INTERVAL '30' MINUTE") <= F.lit(now).cast("timestamp_ntz")
    rows = watches.join(last, "key", "left")
    return rows.filter(ready & (F.col("tried").isNull() | (F.col("tried") < F.lit(session).cast("date")) | (F.col("status") == "pending"))).select(*watches.columns)


def next_ticker(cohort: DataFrame, done: DataFrame, day: str) -> DataFrame:
    """The cohort's next ticker of a day: those done are left out, the first by the hash of day and ticker stays."""
    order = F.sha2(F.concat(F.lit(f"{day}:"), F.col("ticker")).cast("binary"), 256)
    return cohort.join(done.select("ticker"), "ticker", "left_anti").withColumn("order", order).orderBy("order").limit(1)


def day_order(rows: DataFrame, day: str) -> DataFrame:
    """``rows`` (day, key) with each row's place in a permutation of its day that only day and key decide."""
    from pyspark.sql import Window as W

    digest = F.sha2(F.concat_ws(":", F.col(day).cast("string"), F.col("key").cast("string")).cast("binary"), 256)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(day).orderBy(digest)))


def fit_sample(quotes: DataFrame, most: int = 40) -> DataFrame:
    """Of each expiry's quotes by strike, ``most`` evenly spaced ones (all, if there are no more), every fourth of them held out.

    Quotes are counted in steps of the strike; only those in a step that a place falls
    in are put in order, so that no expiry is sorted as a whole.
    """
    from pyspark.sql import Window as W

    by = ["ticker", "expiry"]
    rows = quotes.withColumn("bucket_", F.coalesce(stepped(F.col("strike"), 2048), F.lit(2**31 - 1)))
    w = W.partitionBy(*by)
    runs = rows.groupBy(*by, "bucket_").agg(F.count("*").alias("n_")).withColumns({"n": F.sum("n_").over(w), "start_": F.sum("n_").over(w.orderBy("bucket_")) - F.col("n_")})
    # the k-th place is floor(k (n - 1) / (most - 1)); the first one at i or beyond is there if it's before the end
    few = F.col("n") <= most
    nth = lambda i: F.ceil(i * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    place = lambda i: F.floor(nth(i) * (F.col("n") - 1) / (most - 1))
    hit = written(runs.filter(few | (place(F.col("start_")) < F.col("start_") + F.col("n_"))).select(*by, "bucket_", "n", "start_"), "places")
    rows = matched(rows, F.broadcast(hit) if hit.count() <= MOST_STEPS else hit, [*by, "bucket_"], "inner")
    i = F.col("start_") + F.row_number().over(W.partitionBy(*by, "bucket_").orderBy("strike", "seq")) - 1
    rows = rows.withColumn("i", i).filter(few | (place(F.col("i")) == F.col("i")))
    k = F.when(few, F.col("i")).otherwise(nth(F.col("i"))).cast("long")
    return rows.withColumn("k", k).withColumn("held_out", F.col("k") % 4 == 3).select(*quotes.columns, "k", "held_out")


def latest_few(rows: DataFrame, by: list[str], at: str, key: str, n: int = 3) -> DataFrame:
    """The ``n`` latest rows of each group, for reports."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(at), F.desc(key)))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def all_or_nothing(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The least ``value`` of each group where all its rows have one, else null."""
    return rows.groupBy(*by).agg(F.when(F.count(value) == F.count("*"), F.min(value)).alias(value), F.count("*").alias("n"))


def coverage_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Attempted, issued and scored rows, their rates, and how often each reason was given (null for none)."""
    issued, scored = F.col("reason").isNull(), F.col("reason").isNull() & F.col("unscored").isNull()
    counts = rows.groupBy(*by).agg(F.count("*").alias("attempted"), F.count_if(issued).alias("issued"), F.count_if(scored).alias("scored"))
    why = rows.filter("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n")).groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("reasons"))
    return counts.join(why, by, "left").withColumns({"issued_rate": F.col("issued") / F.col("attempted"), "scored_rate": F.try_divide("scored", "issued")})


def known_schedules(schedules: DataFrame, as_of: object, through: object | None = None) -> DataFrame:
    """Schedules that were accepted and retrieved by ``as_of``; with ``through`` only events after that day and up to it."""
    at = F.lit(as_of).cast("timestamp_ntz")
    rows = schedules.filter((F.col("accepted_at") <= at) & (F.col("retrieved_at") <= at))
    if through is not None:
        rows = rows.filter((F.col("event") > F.to_date(at)) & (F.col("event") <= F.lit(through).cast("date")))
    return rows
