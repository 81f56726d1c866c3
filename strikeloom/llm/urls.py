"""URL filters: allow and block rules, and for all other URLs the ratio of two character language models.

URLs that a rule accepts train one variable-order Markov model, those that a rule
rejects the other; a fifth of both is held back to calibrate the threshold on
the difference of log-likelihoods for each character. A context is as long as
the longest that was seen; its probabilities are smoothed with those of the
next shorter one (Witten-Bell).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm.base import join_keys, written

ALLOW, BLOCK = "allow", "block"
_UPPER = {c: c + 32 for c in range(65, 91)}
_SPLIT = re.compile(r"([^/?#]*)([^?#]*)", re.S)


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) after the first ``://`` and path up to ``?`` or ``#``; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, path = _SPLIT.match(url, at + 3).groups()
    return host.translate(_UPPER), path


class Rules:
    """Rules ``host/path`` with verdicts; the longest that fits decides.

    A rule fits its host and all subdomains if the URL's path starts with its own.
    Looked up by host suffix, so the number of rules hardly matters. A rule that
    is given twice has the verdict given last.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, dict[str, str]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), {})[slash + path] = verdict

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict), both None if no rule fits."""
        best: tuple[int, str, str] | None = None
        at = 0
        while host and at >= 0:
            suffix = host[at:]
            for start, verdict in self.by_host.get(suffix, {}).items():
                if path.startswith(start) and (best is None or len(suffix) + len(start) > best[0]):
                    best = len(suffix) + len(start), suffix + start, verdict
            at = host.find(".", at) + 1 or -1
        return (best[1], best[2]) if best else (None, None)


END = "\x03"


def grams(url: str, order: int) -> Iterator[str]:
    """Each character of the URL, and its end, with up to ``order`` characters before it."""
    text = url + END
    for i in range(len(text)):
        for k in range(min(order, i) + 1):
            yield text[i - k : i + 1]


@dataclass
class Markov:
    """Counts of character runs (context and character) of one class: all, or all that some URLs contain.

    Totals and kinds of the contexts are taken over all runs of the class; where
    they aren't given, ``counts`` has all runs.
    """

    counts: dict[str, int]
    order: int
    alphabet: int = 0x110000  # all code points
    totals: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.totals:
            totals, kinds = Counter(), Counter()
            for gram, n in self.counts.items():
                totals[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            self.totals, self.kinds = dict(totals), dict(kinds)
        self.memory: dict[str, float] = {}

    def chance(self, gram: str) -> float:
        """Probability of the last character after the others."""
        if (known := self.memory.get(gram)) is not None:
            return known
        shorter = self.chance(gram[1:]) if len(gram) > 1 else 1 / self.alphabet
        context = gram[:-1]
        total = self.totals.get(context)
        value = shorter if total is None else (self.counts.get(gram, 0) + self.kinds[context] * shorter) / (total + self.kinds[context])
        if len(self.memory) > 200_000:
            self.memory.clear()
        self.memory[gram] = value
        return value

    def log_likelihood(self, url: str) -> float:
        text, order, log = url + END, self.order, math.log
        return sum(log(self.chance(text[max(0, i - order) : i + 1])) for i in range(len(text)))


@dataclass
class Ratio:
    accepted: Markov
    rejected: Markov

    def margin(self, url: str) -> float:
        """Difference of log-likelihoods for each character; above the threshold is accepted."""
        return (self.accepted.log_likelihood(url) - self.rejected.log_likelihood(url)) / (len(url) + 1)


def ratio(runs: pa.Table, order: int) -> Ratio:
    """The models of URLs of which ``runs`` holds all character runs that the table of a model has."""
    grams_ = runs.column("gram").to_pylist()

    def positive(name: str) -> dict[str, int]:
        return {g: n for g, n in zip(grams_, runs.column(name).to_pylist(), strict=True) if n}

    return Ratio(*[Markov(positive(f"{v}_n"), order, totals=positive(f"{v}_total"), kinds=positive(f"{v}_kinds")) for v in (ALLOW, BLOCK)])


@dataclass
class UrlModel:
    """``table``: every character run of either class with, for each class, its count and its total and kinds as a context."""

    table: DataFrame
    order: int
    threshold: float = 0.0

    def margin(self, url: str) -> float:
        return ratio(self.table.filter(F.col("gram").isin(["", *set(grams(url, self.order))])).toArrow(), self.order).margin(url)


def held_back(url: str) -> bool:
    return crc32(url.encode()) % 5 == 0


GRAM = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])


#: A block has 2^BLOCK_BITS rows at most; its runs are looked up together.
BLOCK_BITS = 9
#: Characters of a URL from which on it isn't looked up with others.
LONG = 4096
LOOKED_UP = T.StructType([T.StructField("block_", T.LongType()), T.StructField("gram", T.StringType())])


def in_blocks(urls: DataFrame, name: str) -> DataFrame:
    """``urls``, written, with ``block_``: stretches of rows as they were written; a long URL is a block of its own."""
    row = F.monotonically_increasing_id()
    return written(urls.withColumn("block_", F.when(F.length("url_") > LONG, -1 - row).otherwise(F.shiftright(row, BLOCK_BITS))), name)


def scored(blocked: DataFrame, model: UrlModel) -> DataFrame:
    """``blocked`` (with ``url_``, never null) without ``block_`` and with the ``margin`` of each row.

    A block asks once for each run that its URLs contain, so that no task holds more
    of the model than a block needs. Runs that many blocks ask for are broadcast, so
    that no task gets all who ask for one (``join_keys``).
    """
    order = model.order
    names = [c for c in blocked.columns if c != "block_"]
    schema = T.StructType([*[f for f in blocked.schema if f.name in names], T.StructField("margin", T.DoubleType())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: set[str] = {""}
        last = None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([last] * len(wanted), pa.int64()), pa.array(list(wanted), pa.string())], names=LOOKED_UP.names)
            wanted.clear()
            wanted.add("")
            return batch

        for batch in batches:
            for block, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is not None and (block != last or len(wanted) > 300_000):
                    yield out()
                last = block
                wanted.update(grams(url, order))
        if last is not None:
            yield out()

    def score(rows: pa.Table, runs: pa.Table) -> pa.Table:
        own = ratio(runs, order)
        return rows.select(names).append_column("margin", pa.array([own.margin(u) for u in rows.column("url_").to_pylist()], pa.float64()))

    asked = written(blocked.select("block_", "url_").mapInArrow(ask, LOOKED_UP), "url-asked")
    known = written(asked.groupBy("gram").agg(F.count("*").alias("asked_")).join(model.table, "gram"), "url-known")
    runs = join_keys(asked, known, "gram", "asked_", asked.count())
    return blocked.groupBy("block_").cogroup(runs.groupBy("block_")).applyInArrow(score, schema)


def fit(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", order: int = 5, steps_a_unit: int = 50) -> UrlModel:
    """Models and threshold from all URLs that a rule decides.

    Character runs are counted over the whole column, summed within tasks before
    they're shuffled. All of them stay, in a written table that grows with the
    input and that no process holds as a whole; contexts have their totals and
    kinds over all runs. The threshold is that multiple of 1 / ``steps_a_unit`` with
    the best balanced accuracy over the URLs held back, of several the one nearest
    to 0; with none of a class it's 0. Only how many margins fall between two
    multiples reaches the driver, a number bounded by the range of margins.
    """
    chosen = Rules(rules)
    urls = pages.select(F.col(url_col).cast("string").alias("url")).filter("url is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([g for _, g in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=GRAM.names)
            found.clear()
            return batch

        for batch in batches:
            for url in batch.column(0).to_pylist():
                _, verdict = chosen.find(*host_path(url))
                if verdict is not None and not held_back(url):
                    found.update((verdict, g) for g in grams(url, order))
                    if len(found) > 300_000:
                        yield out()
        if found:
            yield out()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(chosen.find(*host_path(url))[1], url) for url in batch.column(0).to_pylist() if held_back(url)]
            pairs = [x for x in pairs if x[0] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], names=kept.names)

    summed = urls.mapInArrow(count, GRAM).groupBy("verdict", "gram").agg(F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    run = F.struct("gram", "n", none.alias("total"), none.alias("kinds"))
    context = F.struct(F.expr("substring(gram, 1, length(gram) - 1)").alias("gram"), none.alias("n"), F.col("n").alias("total"), F.lit(1).cast("long").alias("kinds"))
    both = summed.select("verdict", F.explode(F.array(run, context)).alias("x")).select("verdict", "x.*")
    sums = [F.sum(F.when(F.col("verdict") == v, F.col(c)).otherwise(0)).alias(f"{v}_{c}") for v in (ALLOW, BLOCK) for c in ("n", "total", "kinds")]
    model = UrlModel(written(both.groupBy("gram").agg(*sums), "url-runs"), order)
    kept = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("url_", T.StringType())])
    margins = scored(in_blocks(urls.mapInArrow(held, kept), "url-held"), model)
    step = F.floor(F.col("margin") * steps_a_unit).cast("long")
    found: dict[str, Counter[int]] = {ALLOW: Counter(), BLOCK: Counter()}
    for r in margins.groupBy("verdict", step.alias("step")).agg(F.count("*").alias("n")).collect():
        found[r["verdict"]][r["step"]] += r["n"]
    model.threshold = best_cut(found[ALLOW], found[BLOCK]) / steps_a_unit
    return model


def best_cut(good: Counter[int], bad: Counter[int]) -> int:
    """The step from which on to accept, for the best sum of both classes' shares judged right; 0 if a class is empty."""
    if not good or not bad:
        return 0
    right_good, right_bad, n_good, n_bad = 1.0, 0.0, good.total(), bad.total()
    best = (-1.0, 0, 0)
    for cut in range(min(*good, *bad, 0), max(*good, *bad, 0) + 2):
        best = max(best, (round(right_good + right_bad, 12), -abs(cut), cut))
        right_good -= good[cut] / n_good
        right_bad += bad[cut] / n_bad
    return best[2]


JUDGED = [("url_", T.StringType()), ("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("verdict", T.StringType())]


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, margin (six places; null where a rule decides) of each row.

    Rules decide row by row; the other rows are scored in blocks (``scored``). A null
    URL, and one without ``://``, has an empty host and path and no rule; it's judged
    by the models as it is, a null one as empty. Repeated rows are judged alike,
    other columns left out, an empty table gives an empty table.
    """
    source = pages.select(F.col(id_col), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url_"))
    schema = T.StructType([pages.schema[id_col], *[T.StructField(n, t) for n, t in JUDGED]])
    chosen = Rules(rules)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_path(url)
                rows.append((url, host, path, *chosen.find(host, path)))
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(JUDGED))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    decided = in_blocks(source.mapInArrow(decide, schema), "url-rules")
    verdict = F.when(F.col("margin") >= model.threshold, ALLOW).otherwise(BLOCK)
    rest = scored(decided.filter("verdict is null"), model).withColumns({"verdict": verdict, "margin": F.round("margin", 6)})
    ruled = decided.filter("verdict is not null").withColumn("margin", F.lit(None).cast("double"))
    return ruled.select(*rest.columns).unionByName(rest).drop("url_")
