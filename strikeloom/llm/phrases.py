"""Phrases whose words occur together more often than their parts suggest.

A first pass counts runs of one to five words in count-min sketches, one a task,
which are merged by adding; as a sketch never counts too low, a run that a sketch
has under the least count is rare for certain. A second pass counts the others
exactly. What passes is scored against its cuts and dropped if a longer phrase
always holds it.

Cells stop counting at 255, which is enough to tell rare from frequent, and the
merged sketch is kept as one bit a cell. Its width follows the bytes of text up to
``most_cells``; beyond that more rare runs reach the exact count, which is a shuffle
of sums and loses nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm import grams
from strikeloom.llm.base import Work, column, fresh_dir, join_keys, slices, text_of

LONGEST = 5
LEAST = 100
#: Rows of a sketch, and cells that travel together.
ROWS, SLICE = 2, 1 << 16
#: Cells of a row for each byte of text, and the least and most of them.
PER_BYTE, FEWEST, MOST_CELLS = 1 / 12, 1 << 16, 1 << 26
#: Bytes that are looked at together.
PART = 1 << 20
SPLIT = b".,;:!?\x0a\x0b\x0c\r"
COLUMNS = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"

_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[list(SPLIT)] = 10
_MAP[9] = 32


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in lower case, pieces apart by line feeds and words by single spaces, and where each text begins."""
    raw, starts = grams.utf8(column)
    raw = _MAP[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def parts(raw: np.ndarray, starts: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(begin, counted, end) of parts of about ``size`` bytes: runs that end before ``counted`` were counted in the part before.

    Parts end at pieces' ends, and where there is none, after a word; then the next part begins four words earlier.
    """
    size = size or PART
    begin = counted = 0
    while counted < len(raw):
        stop = min(counted + size, len(raw))
        while stop < len(raw):
            lines, blanks = np.flatnonzero(raw[counted:stop] == 10), np.flatnonzero(raw[counted:stop] == 32)
            cut = max(counted + int(lines[-1]) + 1 if len(lines) else 0, int(starts[np.searchsorted(starts, stop, "right") - 1]))
            if cut > counted:
                stop = after = cut
                break
            if len(blanks):
                stop = counted + int(blanks[-1]) + 1
                inside = np.concatenate([[False], raw[begin:stop] > 32])
                words = np.flatnonzero(inside[1:] & ~inside[:-1])
                after = begin + int(words[-min(len(words), LONGEST - 1)]) if len(words) else stop
                break
            stop = min(stop + size, len(raw))
        else:
            after = stop
        yield begin, counted, stop
        begin, counted = after, stop


class Part:
    """Words of a part: hashes with the language, places, and which words are of one piece."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, seeds: np.ndarray, begin: int, counted: int, end: int):
        self.raw = raw[begin:end]
        first = np.searchsorted(starts, begin, "right") - 1
        begins = np.unique(np.maximum(starts[first : np.searchsorted(starts, end)], begin)) - begin
        self.words, self.at = grams._hashed(self.raw, begins)
        # the last of the texts that begin at a place is the one that has its words
        self.text = np.searchsorted(starts, self.at + begin, "right") - 1
        line = self.raw == 10
        bounds = np.union1d(np.flatnonzero(line | (self.raw == 32)), np.append(begins, len(self.raw)))
        self.end = bounds[np.searchsorted(bounds, self.at, "right")] if len(self.at) else self.at
        self.piece = np.cumsum(line)[self.at] + self.text
        self.seeded = grams.mixed(self.words + seeds[self.text])
        self.new = self.at + begin >= counted

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size, the runs' hashes by first word, and which of them lie in one piece."""
        value = self.seeded
        for size in range(1, min(LONGEST, len(self.at)) + 1):
            m = len(self.at) - size + 1
            if size > 1:
                value = grams.mixed(value[:m] * grams.BASE + self.words[size - 1 :])
            yield size, value, self.piece[:m] == self.piece[size - 1 :]


def cells(values: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((values >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.uint32)


def seeds_of(langs: pa.Array) -> np.ndarray:
    """A number for each text's language."""
    own = langs.dictionary_encode()
    names = np.array([zlib.crc32(lang.encode()) for lang in own.dictionary.to_pylist()], np.uint64)
    return grams.mixed(names[own.indices.to_numpy(zero_copy_only=False)])


def each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Part, pa.RecordBatch]]:
    """Parts of batches (lang, text), one after the other."""
    for batch in batches:
        for some in slices(batch, 10_000, PART):
            raw, starts = plain(some.column(1))
            seeds = seeds_of(some.column(0))
            for begin, counted, end in parts(raw, starts):
                yield Part(raw, starts, seeds, begin, counted, end), some
    pa.default_memory_pool().release_unused()


def sketched(docs: DataFrame, width: int, least: int) -> DataFrame:
    """slice, bits: which cells of the merged sketch reach ``least``, one bit a cell; slices without such a cell are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ROWS, width), np.uint8)
        for part, _ in each_part(batches):
            values = [value[whole & part.new[size - 1 :]] for size, value, whole in part.runs()]
            if values:
                values = np.concatenate(values)
                for row in range(ROWS):
                    at, n = np.unique(cells(values, row, width), return_counts=True)
                    table[row, at] = np.minimum(table[row, at] + n, 255)
        table = table.reshape(-1, SLICE)
        for k in np.flatnonzero(table.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table[k].tobytes()], pa.binary())], ["slice", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

        now, total = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                k, more = batch.column(0)[row].as_py(), np.frombuffer(batch.column(1)[row].as_buffer(), np.uint8)
                if k != now:
                    if now is not None and (total >= least).any():
                        yield out(now, total)
                    now, total = k, np.zeros(SLICE, np.uint16)
                total = np.minimum(total + more, 255)
        if now is not None and (total >= least).any():
            yield out(now, total)

    one = docs.mapInArrow(count, "slice int, cells binary")
    return one.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, bits binary")


def counted(docs: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """lang, phrase, size, n: exact counts, still to be added up, of the runs whose every part is frequent in the sketch; size 0 counts words."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part, some in each_part(batches):
            langs = some.column(0).dictionary_encode()
            lang_of, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
            if not len(part.at):
                continue
            lang = lang_of[part.text]
            n = np.bincount(lang[part.new], minlength=len(names))
            there = np.flatnonzero(n)
            yield batch_of(names.take(pa.array(there)), pa.array([""] * len(there)), 0, n[there])
            text, known = part.raw.tobytes(), np.ones(len(part.at) + 1, bool)
            ids = words = word_ids(part, lang)
            most = np.int64(words.max()) + 1
            for size, value, whole in part.runs():
                known = known[:-1] & known[1:] & whole & reached(value, table, width)
                at = np.flatnonzero(known)
                if not len(at):
                    break
                key = ids[at] * most + words[at + size - 1] if size > 1 else words[at]
                found, first, own = np.unique(key, return_index=True, return_inverse=True)
                ids = np.zeros(len(part.at), np.int64)
                ids[at] = own
                n = np.bincount(own[part.new[at + size - 1]], minlength=len(found))
                seen = np.flatnonzero(n)
                where = at[first[seen]]
                strings = [text[a:b] for a, b in zip(part.at[where].tolist(), part.end[where + size - 1].tolist(), strict=True)]
                yield batch_of(names.take(pa.array(lang[where])), pa.array(strings, pa.binary()).cast(pa.string()), size, n[seen])

    return docs.mapInArrow(run, "lang string, phrase string, size int, n long")


def batch_of(langs: pa.Array, phrases: pa.Array, size: int, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, phrases, pa.array(np.full(len(n), size, np.int32)), pa.array(n.astype(np.int64))], ["lang", "phrase", "size", "n"])


def reached(values: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Which runs the sketch has as frequent."""
    found = np.ones(len(values), bool)
    for row in range(ROWS):
        at = cells(values, row, width)
        found &= (bits[row * (width // 8) + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def word_ids(part: Part, lang: np.ndarray) -> np.ndarray:
    """A number for each different (language, word); words of one hash are compared byte by byte."""
    _, first, own = np.unique(part.seeded, return_index=True, return_inverse=True)
    like = first[own]
    size = part.end - part.at
    same = (size == size[like]) & (lang == lang[like])
    if same.all():
        at = np.repeat(part.at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        other = np.repeat(part.at[like] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        if (part.raw[at] == part.raw[other]).all():
            return own.astype(np.int64)
    text, seen = part.raw.tobytes(), {}
    return np.array([seen.setdefault((k, text[a:b]), len(seen)) for k, a, b in zip(lang.tolist(), part.at.tolist(), part.end.tolist(), strict=True)], np.int64)


def frequent(work: Work, docs: DataFrame, least: int = LEAST, most_cells: int = MOST_CELLS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of every run of up to LONGEST words found ``least`` times or more, and (lang, n), all words.

    ``docs`` has lang and text, without nulls. ``least`` is 255 at most, where cells
    end. Reads ``docs`` three times, once for its bytes alone.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be between 1 and 255")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = FEWEST
    while width < min(total * PER_BYTE, most_cells):
        width *= 2
    # a task's sketch must be worth its size: as many tasks as run at once, fewer for little text
    tasks = max(1, min(total // width, max(spark.sparkContext.defaultParallelism, total // (32 * width))))
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for row in work.written(sketched(docs.coalesce(tasks), width, least), "sketch").collect():  # ROWS * width bits at most
        bits[row["slice"] * (SLICE // 8) : (row["slice"] + 1) * (SLICE // 8)] = np.frombuffer(row["bits"], np.uint8)
    exact = counted(docs, bits, width).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"))
    exact = work.written(exact.filter((F.col("size") == 0) | (F.col("a") >= least)), "counts")
    return exact.filter("size > 0"), exact.filter("size = 0").select("lang", F.col("a").alias("n"))


def looked_up(work: Work, rows: DataFrame, counts: DataFrame, phrase: str, name: str, total: int) -> DataFrame:
    """``rows`` with ``name``, the count of its column ``phrase``; phrases that many rows ask for are broadcast."""
    asked = rows.groupBy("lang", phrase).agg(F.count("*").alias("asked"))
    per_key = work.written(asked.join(counts.select("lang", F.col("phrase").alias(phrase), F.col("a").alias(name)), ["lang", phrase]), name)
    return join_keys(rows, per_key, ["lang", phrase], "asked", total)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact for counts under 10^15 and words under 10^17."""
    above = (a * 1000).cast("decimal(20,0)") * n.cast("decimal(17,0)")
    below = left.cast("decimal(18,0)") * right.cast("decimal(18,0)")
    return F.call_function("div", above, below)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, share: int = 100, most: int = 2000, most_cells: int = MOST_CELLS) -> DataFrame:
    """Each language's ``most`` best phrases of two to LONGEST words (COLUMNS).

    A phrase is scored by its worst cut: 1000 * a * n / (l * r), of all words n and
    the counts of phrase, first part and rest. It is dropped if a longer phrase
    that holds its words has ``share`` per cent of its count or more. Null texts are
    empty, a null language is ``und``; repeated rows count each; ties go by count and
    then by the phrase's bytes; other columns may have any name; an empty table
    gives an empty table. No language or phrase lands in one task: counts are
    combined before they are shuffled, ranks are taken in 64 buckets first.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    with Work(spark, "phrases") as work:
        counts, totals = frequent(work, own, least, most_cells)
        words = F.split("phrase", " ")
        found = counts.filter("size > 1")
        cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        cuts = cuts.withColumns({"first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
        cuts = work.written(cuts, "cuts")
        total = cuts.count()
        cuts = work.written(looked_up(work, cuts, counts, "first", "l", total), "cuts")
        cuts = looked_up(work, cuts, counts, "rest", "r", total).join(F.broadcast(totals), "lang")  # a row a language
        worst = F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("worst")
        scored = cuts.groupBy("lang", "phrase", "a", "n").agg(worst)
        inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
        longer = found.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        left = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
        left = left.select("lang", "phrase", "a", "n", "worst.score", "worst.l", "worst.r")
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
        in_bucket = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))
        best = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", in_bucket).filter(F.col("rank") <= most)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
        path = fresh_dir(spark, "collocations")
        best.select(*[part.split()[0] for part in COLUMNS.split(", ")]).write.parquet(path)
    return spark.read.schema(T._parse_datatype_string(COLUMNS)).parquet(path)


SQL = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase
      FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, range(1, 6) s(size) WHERE len(ws) >= size)),
f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k, x.a AS l, y.a AS r, n.n, (1000 * k.a::HUGEINT * n.n) // (x.a::HUGEINT * y.a) AS score
      FROM k JOIN n ON n.lang = k.lang
      JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1 : k], ' ')
      JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k + 1 : k.size], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) t(lang, phrase0, size, a, ws, m, i)),
o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase)::BIGINT AS rank, b.phrase, b.a::BIGINT AS a,
       b.l::BIGINT AS l, b.r::BIGINT AS r, b.n::BIGINT AS n, b.score::BIGINT AS score
FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100 * o.longer < 100 * b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) <= 2000
"""
