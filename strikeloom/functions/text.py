"""Text of filings and pages: markup, dates and sentences."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: A comment, a script or style with its content, or a tag whose quoted attributes may hold anything; or else up to the next ``>``.
_TAG = re.compile(r"""<(?:!--|(?P<raw>script|style)(?=[\s/>])|[a-zA-Z/!?])""", re.I)
_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_RAW_END = {name: re.compile(rf"</{name}[^>]*>", re.I) for name in ("script", "style")}


def page_text(html: str) -> str:
    """Text of a page: no comments, scripts, styles and tags, references decoded, blanks run together.

    A tag ends at the first ``>`` outside quotes, or at the first one if a quote isn't
    closed; what isn't closed goes to the end of the page. Every character is looked at
    a few times, whatever the page holds.
    """
    parts, at = [], 0
    last = html.rfind(">")
    while found := _TAG.search(html, at):
        parts.append(html[at : found.start()])
        if found[0] == "<!--":
            end = html.find("-->", found.end())
            at = end + 3 if end >= 0 else len(html)
            continue
        if last < found.end():
            at = len(html)
            break
        close = _END.match(html, found.end())
        at = close.end() if close else html.find(">", found.end()) + 1
        if found["raw"]:
            end = _RAW_END[found["raw"].lower()].search(html, at)
            at = end.end() if end else len(html)
    parts.append(html[at:])
    return " ".join(" ".join(unescape(x) for x in parts).split())


def html_text(html: Column) -> Column:
    """``page_text`` of each page, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def each(pages: pd.Series) -> pd.Series:
        return pages.map(page_text, na_action="ignore")

    return each(html)


def dates_in(text: Column) -> Column:
    """All ISO dates of a text."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0))


def sentences(text: Column) -> Column:
    """Runs of characters up to a full stop."""
    return F.regexp_extract_all(text, F.lit(r"[^.]+\."), F.lit(0))


def only_match(text: Column, pattern: str) -> Column:
    """The match of a pattern that a text has exactly once, else null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) == 1, found[0])


# fixed values: the words and patterns down to PERIOD define which announcements count, so that results can be compared with other readers of the same filings
MONTHS = "January February March April May June July August September October November December".split()
DATE = r"((?:" + "|".join(MONTHS) + r"|Jan\.?|Feb\.?|Mar\.?|Apr\.?|Jun\.?|Jul\.?|Aug\.?|Sep\.?|Sept\.?|Oct\.?|Nov\.?|Dec\.?)\s+\d{1,2},?\s+20\d{2})"
SCHEDULE = r"(?iuU)(?:will|plans to|expects to|to)\s+(?:report|release|announce)\b.{0,150}?(?:earnings|financial results|quarterly results)\b.{0,180}?\bon\s+" + DATE
_RESULTS = r"(?:earnings|financial results|quarterly results)\b(?!\s+(?:release\s+)?(?:date|schedule|conference call|webcast)\b)"
_ACTUAL = r"\b(?:reported|announced|released)\b(?:(?!\b(?:date|schedule|conference call|webcast|upcoming|forthcoming)\b).){0,150}?\b" + _RESULTS
ACTUAL_PREFIX = r"(?iuU)\bOn\s+" + DATE + r"\b.{0,120}?" + _ACTUAL
ACTUAL_SUFFIX = r"(?iuU)" + _ACTUAL + r".{0,100}?\bon\s+" + DATE
#: The full stop of a month or company abbreviation doesn't end a sentence; possessive, so that long sentences take no stack.
SENTENCE = r"(?iuU)(?:[^.!?]++|(?<=\b(?:Inc|Corp|Co|Ltd|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec))\.)++"
FUTURE_CALL = r"(?iuU)(?:;|\band|\bbut)\s+(?:it\s+)?(?:will|would|shall|plans? to|expects? to|intends? to)\s+(?:host|hold|conduct)\s+(?:(?:a|an|the|its)\s+)?(?:earnings\s+)?(?:conference call|webcast)\b"
FUTURE_RELEASE = r"(?iuU)\b(?:will|would|shall|plans? to|expects? to|expected to|intends? to|scheduled (?:to|for)|planned (?:to|for)|going to)\b|\bto\s+(?:be\s+)?(?:report(?:ed)?|release(?:d)?|announce(?:d)?)\b"
CLOCK = r"(?iuU)\bat\s+(\d{1,2})(?::(\d{2}))?\s*(a\.?m\.?|p\.?m\.?)\s*(?:ET|EST|EDT|Eastern Time)\b"
PERIOD = r"(?iuU)\b(first|second|third|fourth|1st|2nd|3rd|4th)\s+quarter\s+(20\d{2})\b"
_NY = "America/New_York"


def event_date(text: Column) -> Column:
    """The date of a month's name (or its first three letters, or Sept), day and year; null if there's no such day."""
    plain = F.regexp_replace(F.regexp_replace(text, "[.,]", ""), r"(?i)^sept(?=\s)", "Sep")
    names = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])
    part = lambda i: F.regexp_extract(plain, rf"(?i)^({names})\s+(\d{{1,2}})\s+(\d{{4}})$", i)
    month = F.map_from_arrays(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), F.array(*[F.lit(i + 1) for i in range(12)]))[F.lower(F.substring(part(1), 1, 3))]
    day = part(2).try_cast("int")
    first = F.make_date(part(3).try_cast("int"), month, F.lit(1))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _ny_day(at: Column) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(_NY), at))


def forward_schedule(text: Column, accepted_at: Column, retrieved_at: Column) -> Column:
    """struct(event_date, event_at, series_key, evidence) of the only announcement of a future date, else null.

    Times are UTC without a zone. None or several announcements, an impossible
    date, one not after the day of acceptance in New York, and retrieval before
    acceptance give null. ``event_at`` is the New York time within 100 characters
    after the date, in the same sentence; ``series_key`` the fiscal quarter within
    100 characters around.
    """
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    found = _all(text, SCHEDULE, 0)
    whole = F.get(found, F.lit(0))
    date = event_date(F.get(_all(text, SCHEDULE, 1), F.lit(0)))
    start = F.position(whole, text)
    end = start + F.length(whole)
    after = F.substring(text, end, F.lit(100))
    from_ = F.greatest(start - 100, F.lit(1))
    around = F.substring(text, from_, end + 100 - from_)
    clock = F.get(_all(after, CLOCK, 0), F.lit(0))
    piece = lambda i: F.get(_all(after, CLOCK, i), F.lit(0))
    hour = piece(1).try_cast("int") % 12 + F.when(F.lower(piece(3)).startswith("p"), 12).otherwise(0)
    minute = F.coalesce(piece(2).try_cast("int"), F.lit(0))
    same = ~F.substring(after, F.lit(1), F.position(clock, after) - 1).contains(".")
    local = date.cast("timestamp_ntz") + F.make_dt_interval(hours=hour, mins=minute)
    event_at = F.when(same & (minute < 60), F.convert_timezone(F.lit(_NY), F.lit("UTC"), local))
    number = F.get(_all(around, PERIOD, 1), F.lit(0))
    quarter = F.when(number.rlike("(?i)^(first|1st)$"), "1").when(number.rlike("(?i)^(second|2nd)$"), "2").when(number.rlike("(?i)^(third|3rd)$"), "3").when(number.rlike("(?i)^(fourth|4th)$"), "4")
    series = F.concat(F.get(_all(around, PERIOD, 2), F.lit(0)), F.lit("Q"), quarter)
    good = (F.size(found) == 1) & (date > _ny_day(accepted_at)) & (retrieved_at >= accepted_at)
    return F.when(good, F.struct(date.alias("event_date"), event_at.alias("event_at"), series.alias("series_key"), F.substring(whole, 1, 300).alias("evidence")))


def actual_results(text: Column, accepted_at: Column, retrieved_at: Column) -> Column:
    """struct(event_date, evidence) of the only dated statement that results were announced, else null.

    Sentences that speak of a release to come don't count, once a clause that only
    announces a call is set aside; nor does what follows such a clause. The date is
    the day of acceptance in New York or up to three days before.
    """
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    past = F.filter(_all(text, SENTENCE, 0), lambda s: ~F.regexp_replace(s, FUTURE_CALL, "").rlike(FUTURE_RELEASE))
    past = F.transform(past, lambda s: F.regexp_replace(s, FUTURE_CALL + "(?s:.*)", ""))
    each = lambda group: F.flatten(F.transform(past, lambda s: F.concat(_all(s, ACTUAL_PREFIX, group), _all(s, ACTUAL_SUFFIX, group))))
    found = each(0)
    date = event_date(F.get(each(1), F.lit(0)))
    lag = F.datediff(_ny_day(accepted_at), date)
    good = (F.size(found) == 1) & lag.between(0, 3) & (retrieved_at >= accepted_at)
    return F.when(good, F.struct(date.alias("event_date"), F.substring(F.get(found, F.lit(0)), 1, 300).alias("evidence")))
