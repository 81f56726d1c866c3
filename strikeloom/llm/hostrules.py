"""Quality rules with host verdicts, in DataFrame functions alone.

Each document's rules are counted in one pass without a shuffle. Failures are
summed by host, every host's rate is shrunk towards the corpus with a beta prior
fitted to the hosts themselves, and the verdict on a host holds for its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeloom.llm.base import column, join_keys, set_apart, text_of, written

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, use) -> Column:
    """use(value) with ``value`` computed once, however often and wherever ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), "")


def repeated_words(words: Column) -> Column:
    """How many words stand in three-word windows that the array has twice or more.

    Windows are hashed to 64 bits and sorted with their places; those whose hash
    is a neighbour's are compared by their words in the same way, and the places
    that repeat are merged from left to right.
    """
    size = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def repeats(placed: Column, name: str) -> Column:
        """Those of ``placed``, sorted, whose field ``name`` is a neighbour's too."""
        return F.filter(placed, lambda x, j: (F.get(placed, j - 1)[name].eqNullSafe(x[name])) | (F.get(placed, j + 1)[name].eqNullSafe(x[name])))

    def covered(placed: Column) -> Column:
        places = F.sort_array(F.transform(repeats(placed, "t"), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")))["n"]

    def exact(placed: Column) -> Column:
        """Of windows with a hash that occurs again, those whose words do."""
        window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.sort_array(F.transform(repeats(placed, "h"), lambda x: F.struct(window(x["i"]).alias("t"), x["i"].alias("i"))))

    def count(hashed: Column) -> Column:
        placed = F.sort_array(F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashed)) == F.size(hashed), F.lit(0)).otherwise(bound(placed, lambda p: bound(exact(p), covered)))

    return F.when(size < 3, F.lit(0)).otherwise(bound(windows, count))


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the rule counts of each text and which rules it fails (replacing columns of those names).

    A null or empty text has no words: all counts are 0 and it fails. Texts are
    counted whole, however long. Adds COUNTS (long), ``base_failed``, and
    ``n_failed`` (how many of the rules fail: few words, repetition, symbols,
    repeated lines, word length).
    """
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, BLANKS, "") != "")
    counts = F.struct(
        bound(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, BLANKS, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    )
    docs, back = set_apart(docs.drop(*COUNTS, "base_failed", "n_failed"), text_col)
    out = docs.withColumn("counts_", counts)
    c = F.col("counts_")
    out = out.select(*back, c["w"]["n_words"].cast("long").alias("n_words"), c["word_chars"].cast("long").alias("word_chars"), c["n_symbols"].cast("long").alias("n_symbols"), c["n_dup_lines"].cast("long").alias("n_dup_lines"), c["w"]["n_repeat_words"].cast("long").alias("n_repeat_words"))
    few, again = F.col("n_words") < 50, F.col("n_repeat_words") * 100 > F.col("n_words") * 50
    others = [F.col("n_symbols") * 5 > F.col("n_words"), F.col("n_dup_lines") * 20 > F.col("n_words"), F.col("word_chars") > F.col("n_words") * 12]
    return out.withColumns({"base_failed": few | again, "n_failed": sum((x.cast("int") for x in [few, again, *others]), F.lit(0))})


def host_rates(counts: DataFrame, host_col: str = "source", strongest: float = 1e6) -> DataFrame:
    """host, n_docs, n_bad, rate: each host's share of documents that fail a rule, shrunk.

    The prior's mean is the corpus rate, its strength comes from the variance of
    the hosts' rates (weighted by documents), between 1 and ``strongest``. Only
    three sums over hosts reach the driver.
    """
    hosts = counts.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum((F.col("n_failed") > 0).cast("long")).alias("n_bad"))
    hosts = written(hosts, "hosts")
    sums = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_bad").alias("bad"), F.sum(F.col("n_bad").cast("double") * F.col("n_bad") / F.col("n_docs")).alias("square")).first()
    n = sums["n"] or 0
    mean = (sums["bad"] or 0) / n if n else 0.0
    spread = (sums["square"] or 0.0) / n - mean * mean if n else 0.0
    strength = strongest if spread <= mean * (1 - mean) / (strongest + 1) else max(1.0, mean * (1 - mean) / spread - 1)
    return hosts.withColumn("rate", (F.col("n_bad") + mean * strength) / (F.col("n_docs") + strength))


def verdicts(counts: DataFrame, host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """``counts`` (of ``counted``; written, so that texts are counted once) with ``kept``, see ``judge``."""
    counts, back = set_apart(counts, host_col, "base_failed", "n_failed")
    hosts = host_rates(counts, host_col)
    bad = written(hosts.filter(F.col("rate") > limit).select(host_key(F.col("host")).alias("host of row"), F.lit(True).alias("bad host"), "n_docs"), "bad-hosts")
    joined = join_keys(counts.withColumn("host of row", host_key(column(host_col))), bad, "host of row", "n_docs", hosts.agg(F.sum("n_docs").alias("n")).first()["n"] or 0, "left")
    return joined.select(*back, (~F.col("base_failed") & F.col("bad host").isNull()).alias("kept"))


def host_key(host: Column) -> Column:
    """A host as a key that is never null."""
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("n"))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", limit: float = 0.5, with_text: bool = True) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``n_failed`` and ``kept`` (replacing columns of those names).

    ``kept`` is false if ``base_failed``, or if the host's shrunk rate is above
    ``limit``. A null host is a host of its own; null and empty texts fail; repeated
    rows are counted and judged each; other columns may have any name; an empty
    table gives an empty table. The counts are written with the columns of ``docs``,
    without the text unless ``with_text``. Verdicts on large hosts are broadcast,
    others joined by host (``join_keys``), so that no host lands in one task.
    """
    counts = counted(docs.drop("kept"), text_col)
    return verdicts(written(counts if with_text else counts.drop(text_col), "rule-counts"), host_col, limit)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
t AS (SELECT rid, pos, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS tri
      FROM w WINDOW p AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, tri) AS c FROM t WHERE tri IS NOT NULL) WHERE c >= 2),
again AS (SELECT rid, count(DISTINCT pos) AS n FROM
          (SELECT rid, pos FROM r UNION ALL SELECT rid, pos + 1 FROM r UNION ALL SELECT rid, pos + 2 FROM r) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM w GROUP BY rid),
c AS (SELECT d.doc_id, d.source, coalesce(n.n, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
             coalesce(again.n, 0) AS n_repeat_words
      FROM d LEFT JOIN n USING (rid) LEFT JOIN l USING (rid) LEFT JOIN again USING (rid)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
             (n_words < 50)::INT + (n_repeat_words * 100 > n_words * 50)::INT + (n_symbols * 5 > n_words)::INT
             + (n_dup_lines * 20 > n_words)::INT + (word_chars > n_words * 12)::INT AS n_failed FROM c),
h AS (SELECT source, count(*) AS n_docs, count(*) FILTER (n_failed > 0) AS n_bad FROM f GROUP BY source),
p AS (SELECT sum(n_bad) / sum(n_docs) AS mean, sum(n_bad::DOUBLE * n_bad / n_docs) / sum(n_docs) AS square FROM h),
s AS (SELECT mean, CASE WHEN square - mean * mean <= mean * (1 - mean) / (1e6 + 1) THEN 1e6
                        ELSE greatest(1.0, mean * (1 - mean) / (square - mean * mean) - 1) END AS strength FROM p),
v AS (SELECT source, (n_bad + mean * strength) / (n_docs + strength) > 0.5 AS bad FROM h, s)
SELECT f.doc_id, f.n_words::BIGINT AS n_words, f.word_chars::BIGINT AS word_chars, f.n_symbols::BIGINT AS n_symbols,
       f.n_dup_lines::BIGINT AS n_dup_lines, f.n_repeat_words::BIGINT AS n_repeat_words, f.base_failed,
       NOT f.base_failed AND NOT v.bad AS kept, f.n_failed::INT AS n_failed
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
