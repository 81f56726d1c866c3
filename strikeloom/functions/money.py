"""Exact scaled integers, ratios, bands and identity strings as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARES, YEAR = 100, 365


def half_up(x: Column, scale: int) -> Column:
    """``x`` times ``scale``, rounded half away from zero, as a long; null stays null."""
    return (F.signum(x) * F.floor(F.abs(x) * scale + 0.5)).cast("long")


def cents(x: Column) -> Column:
    return half_up(x, 100)


def tenths(x: Column) -> Column:
    return half_up(x, 10)


def e4(x: Column) -> Column:
    return half_up(x, 10_000)


def positive(x: Column) -> Column:
    """``x`` where it's finite and above zero, else null."""
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def ratio_pct(part: Column, whole: Column) -> Column:
    """Percentage, null where the whole isn't positive."""
    return F.when(whole > 0, part / whole * 100)


def bands(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the half-open band of ``x``: names[0] below edges[0], and so on; null for null."""
    out = F.when(x < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:-1], strict=True):
        out = out.when(x < edge, name)
    return F.when(x.isNotNull(), out.otherwise(names[-1]))


def horizon_band(h: Column) -> Column:
    """1, 2-5, 6-10, 11-25 sessions; null outside."""
    return F.when(h == 1, "1").when(h.between(2, 5), "2-5").when(h.between(6, 10), "6-10").when(h.between(11, 25), "11-25")


def depth_band(spot: Column, strike: Column) -> Column:
    """Band of 1 - strike / spot, null where it isn't above zero."""
    depth = 1 - strike / spot
    return F.when(depth > 0, bands(depth, [0.025, 0.05, 0.1, 0.2], ["0-2.5%", "2.5-5%", "5-10%", "10-20%", "20%+"]))


def moneyness_band(spot: Column, strike: Column, side: Column) -> Column:
    """near (5 %), moderate (15 %) or far, in or out of the money."""
    distance = F.abs(strike / spot - 1)
    inside = F.when(side == "call", strike < spot).otherwise(strike > spot)
    where = F.when(inside, "itm").otherwise("otm")
    return F.when(distance <= 0.05, "near_atm").when(distance <= 0.15, F.concat(F.lit("moderate_"), where)).otherwise(F.concat(F.lit("far_"), where))


def classify(side: Column, close: Column, strike: Column) -> Column:
    """itm, atm or otm; in the money is strict."""
    up = F.when(side == "call", close - strike).otherwise(strike - close)
    return F.when(up > 0, "itm").when(up == 0, "atm").otherwise("otm")


def strike_exact(x: Column) -> Column:
    return x.cast("decimal(18,3)").cast("string")


def watch_key(ticker: Column, root: Column, side: Column, expiry: Column, strike: Column) -> Column:
    """``w1:TICKER:ROOT:side:yyyy-mm-dd:ddd.ddd``."""
    return F.concat_ws(":", F.lit("w1"), ticker, root, side, expiry.cast("string"), strike_exact(strike))


def parse_watch_key(key: Column) -> dict[str, Column]:
    """Parts of a watch key; all null if it isn't one."""
    pattern = r"^w1:([A-Z.#0-9]{1,12}):([A-Z.#0-9]{1,12}):(call|put):(\d{4}-\d{2}-\d{2}):(\d{1,12}\.\d{3})$"
    part = [F.when(key.rlike(pattern), F.regexp_extract(key, pattern, i)) for i in range(1, 6)]
    return {"ticker": part[0], "root": part[1], "side": part[2], "expiry": F.to_date(part[3]), "strike": part[4].cast("decimal(18,3)")}


def option_symbol(root: Column, expiry: Column, side: Column, strike: Column) -> Column:
    """``O:ROOTyymmdd[C|P]`` and the strike in thousandths, eight digits."""
    return F.concat(F.lit("O:"), root, F.date_format(expiry, "yyMMdd"), F.when(side == "call", "C").otherwise("P"), F.lpad(half_up(strike, 1000).cast("string"), 8, "0"))


def parse_option_symbol(symbol: Column) -> dict[str, Column]:
    """root, expiry, side, strike of an option symbol; all null if it isn't one."""
    pattern = r"^O:([A-Z.#0-9]{1,6}?)(\d{6})([CP])(\d{8})$"
    part = [F.when(symbol.rlike(pattern), F.regexp_extract(symbol, pattern, i)) for i in range(1, 5)]
    expiry = F.try_to_date(F.concat(F.lit("20"), part[1]), "yyyyMMdd") if hasattr(F, "try_to_date") else F.expr("null")
    return {"root": part[0], "expiry": expiry, "side": F.when(part[2] == "C", "call").when(part[2] == "P", "put"), "strike": (part[3].cast("long") / 1000).cast("decimal(18,3)")}


def parse_price(text: Column) -> Column:
    """A price in text: ``$`` and ``,`` dropped, ``--``, blank and words null."""
    plain = F.trim(F.regexp_replace(text, r"[$,]", ""))
    return F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain).cast("decimal(28,8)")
