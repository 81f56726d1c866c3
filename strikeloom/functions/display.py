"""Small column expressions: texts for display, thresholds, scaled money, times and dates of New York, probabilities in tenths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
SAFE = (1 << 53) - 1  # the largest integer that a double and a client hold exactly
NEW_YORK = "America/New_York"
#: Fixed words: names of listings that are no common stock.
NOT_EQUITY = r"(?i)\b(warrants?|rights?|units?|preferred|notes?|bonds?)\b"


def grouped(n: Column) -> Column:
    """An integer with commas."""
    return F.format_number(n, 0)


def money_text(cents: Column) -> Column:
    """``-$1,234.05``; a dash for null."""
    whole = F.floor(F.abs(cents) / 100)
    text = F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), grouped(whole), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    return F.coalesce(text, F.lit(DASH))


def percent_text(tenths: Column, signed: bool = True) -> Column:
    """``+1.5%`` (or without the plus); a dash for null."""
    sign = F.when(tenths < 0, "-").when((tenths > 0) & F.lit(signed), "+").otherwise("")
    return F.coalesce(F.concat(sign, F.floor(F.abs(tenths) / 10).cast("string"), F.lit("."), (F.abs(tenths) % 10).cast("string"), F.lit("%")), F.lit(DASH))


def integer_text(n: Column) -> Column:
    return F.coalesce(grouped(n), F.lit(DASH))


def row_text(ticker: Column, expiration: Column, dte: Column, source: Column, cents: Column, lots: Column, headers: list[str], values: list[Column]) -> Column:
    """A row for the clipboard: what it is about, and a table of one line."""
    count = F.when(lots == 1, "1 contract").otherwise(F.concat(grouped(lots), F.lit(" contracts")))
    size = F.when(lots.isNotNull(), F.concat(count, F.lit(" · "), grouped(lots * 100), F.lit(" sh")))
    about = F.concat_ws(" · ", ticker, expiration, F.concat(integer_text(dte), F.lit(" DTE")), F.concat(source, F.lit(": "), money_text(cents)), size)
    head = "| " + " | ".join(headers) + " |\n| " + " | ".join("---" for _ in headers) + " |"
    return F.concat(about, F.lit(f"\n\n{head}\n| "), F.concat_ws(" | ", *values), F.lit(" |"))


def threshold(raw: Column) -> Column:
    """A typed threshold as an exact decimal: a sign, ``$``, ``%`` and commas in threes are allowed; null for anything else."""
    token = r"^\s*(?:[+-]?\s*\$?|\$\s*[+-]?)\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*%?\s*$"
    return F.when(raw.rlike(token), F.regexp_replace(raw, r"[$%,\s]", "").try_cast("decimal(30,10)"))


def scaled(value: Column, lots: Column) -> Column:
    """value * lots where both and the product are safe integers and lots positive, else null."""
    product = value.cast("decimal(38,0)") * lots.cast("decimal(38,0)")
    fits = (F.abs(value) <= SAFE) & (lots > 0) & (lots <= SAFE) & (F.abs(product) <= SAFE)
    return F.when(fits, product.cast("long"))


def lots_are_safe(lots: Column, fields: list[Column]) -> Column:
    """True if shares, and every known field times lots, are safe integers."""
    ok = scaled(F.lit(100), lots).isNotNull()
    for f in fields:
        ok = ok & (f.isNull() | scaled(f, lots).isNotNull())
    return ok


def pinball(observed: Column, quantile: Column, level: float = 0.05) -> Column:
    """Quantile loss of a forecast quantile."""
    r = observed - quantile
    return F.greatest(r * level, r * (level - 1))


def tenths_of(p: Column) -> Column:
    """A probability in tenths of a percent, half up; null if it isn't one."""
    return F.when(p.between(0, 1) & ~F.isnan(p), F.floor(p * 1000 + 0.5).cast("long"))


def quote_support(lower: Column, upper: Column, put: Column) -> Column:
    """struct<low, high, score>: bounds in tenths (mirrored for puts) and how tight they are, of 100; null if they aren't bounds."""
    ok = (lower >= 0) & (lower <= upper) & (upper <= 1)
    low, high = F.when(put, 1 - upper).otherwise(lower), F.when(put, 1 - lower).otherwise(upper)
    return F.when(ok, F.struct(tenths_of(low).alias("low"), tenths_of(high).alias("high"), F.floor((1 - (upper - lower)) * 100 + 0.5).cast("long").alias("score")))


def moneyness_bucket(threshold_: Column) -> Column:
    """near_atm, moderate or tail of a standardised threshold."""
    return F.when(F.abs(threshold_) <= 0.5, "near_atm").when(F.abs(threshold_) <= 1, "moderate").otherwise("tail")


def long_horizon_band(horizon: Column) -> Column:
    return F.when(horizon == 1, "1").when(horizon.between(2, 5), "2-5").when(horizon.between(6, 25), "6-25").when(horizon.between(26, 252), "26-252")


def last_trade_time(text: Column) -> Column:
    """What stands in ``(AS OF ...)`` at the end."""
    return F.nullif(F.regexp_extract(text, r"\(AS OF (.+)\)$", 1), F.lit(""))


def local_day(ms: Column) -> Column:
    """Epoch milliseconds as a New York date."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), utc_of(ms)))


def utc_of(ms: Column) -> Column:
    """Epoch milliseconds as a UTC timestamp without zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))


def local_midnight(ms: Column) -> Column:
    """Epoch milliseconds of the New York midnight that begins the day of ``ms``."""
    midnight = F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), local_day(ms).cast("timestamp_ntz"))
    days = F.datediff(F.to_date(midnight), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000 + (F.hour(midnight) * 3600 + F.minute(midnight) * 60).cast("long") * 1000


def window_start(today: Column) -> Column:
    """Two years before, the end of February where that day is missing."""
    return F.add_months(today, -24)


def ex_date(value: Column) -> Column:
    """A dividend date from epoch seconds or ISO text, as a New York date."""
    seconds = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), local_day((value.try_cast("double") * 1000).cast("long")))
    return F.coalesce(seconds, F.substring(value, 1, 10).try_cast("date"))


def dividend_kind(quote_type: Column, rate: Column, trailing: Column, ex: Column) -> Column:
    """payer, nonpayer or unknown: negative rates and anything but equity are unknown, and so are no rates, or zero ones with a date."""
    return (
        F.when(~F.coalesce(quote_type == "EQUITY", F.lit(False)) | F.coalesce(rate < 0, F.lit(False)) | F.coalesce(trailing < 0, F.lit(False)), "unknown")
        .when((rate > 0) | (trailing > 0), "payer")
        .when(((rate == 0) | (trailing == 0)) & ex.isNull(), "nonpayer")
        .otherwise("unknown")
    )


def dividend_reason(kind: Column, next_ex: Column, expiry: Column) -> Column:
    """Null if an option of this expiry has no dividend before it, else the reason against it."""
    free = (kind == "nonpayer") | ((kind == "payer") & (expiry < next_ex))
    return F.when(F.coalesce(free, F.lit(False)), None).when(kind == "payer", "Dividend exposure is unsupported for this expiration").otherwise("Dividend status could not be verified")


def identity(url: Column, ticker: Column, expiration: Column, strike: Column) -> Column:
    """struct<root, reason> of a contract's link: its symbol must name the row's ticker, expiry and strike; reason null if it does."""
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    symbol = F.regexp_extract(path, r"([^/]*)$", 1)
    pattern = r"(?i)^([a-z0-9.]+?)-*(\d{6})([cp])(\d{8})$"
    root = F.upper(F.nullif(F.regexp_extract(symbol, pattern, 1), F.lit("")))
    day = F.try_to_timestamp(F.concat(F.lit("20"), F.regexp_extract(symbol, pattern, 2)), F.lit("yyyyMMdd")).cast("date")
    price = F.nullif(F.regexp_extract(symbol, pattern, 4), F.lit("")).try_cast("decimal(18,3)") / 1000
    other = F.upper(F.nullif(F.regexp_extract(path, r"(?i)/stocks/([^/]+)/option-chain/", 1), F.lit("")))
    reason = (
        F.when(url.isNull() | (url == ""), "Nasdaq did not provide a contract symbol")
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://|^//|[?#]."), "Nasdaq contract symbol is ambiguous")
        .when(root.isNull(), "Nasdaq contract symbol is unrecognized")
        .when(day.isNull(), "Nasdaq contract expiry is invalid")
        .when(root != ticker, "Adjusted or nonstandard option root")
        .when(day.cast("string") != expiration, "Nasdaq contract expiry differs from chain row")
        .when(price != strike, "Nasdaq contract strike differs from chain row")
        .when(other.isNotNull() & (other != ticker), "Nasdaq contract ticker differs from chain row")
    )
    unknown = reason.isin("Nasdaq did not provide a contract symbol", "Nasdaq contract symbol is ambiguous", "Nasdaq contract symbol is unrecognized")
    return F.struct(F.when(~F.coalesce(unknown, F.lit(False)), root).alias("root"), reason.alias("reason"))


def common_stock(name: Column, sector: Column) -> Column:
    """A listing with a sector whose name is of no warrant, right, unit, preferred share, note or bond."""
    return F.coalesce((F.trim(sector) != "") & ~name.rlike(NOT_EQUITY), F.lit(False))


def stratum(minutes: Column) -> Column:
    """regular, early close (under 390 minutes) or non-session (null) of a day's trading minutes."""
    return F.when(minutes.isNull(), "non_session").when(minutes < 390, "early_close").otherwise("regular")


def reference_price(bid: Column, last: Column) -> Column:
    """struct<price, source>: the stock's bid if it's positive, else the last trade, else nulls."""
    source = F.when(bid > 0, "stock_bid").when(last > 0, "chain_last_trade")
    return F.struct(F.when(bid > 0, bid).when(last > 0, last).alias("price"), source.alias("source"))


def side_listed(*fields: Column) -> Column:
    """True if any field of a side is there."""
    return F.coalesce(*fields).isNotNull()
