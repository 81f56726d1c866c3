"""Collocations against plain Python counts; sketches never too low; parts of long texts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strikeloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, share=100, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= least}
        longer = Counter()
        for p, a in kept.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        best = []
        for p, a in kept.items():
            if len(p) > 1 and not (longer[p] and 100 * longer[p] >= share * a):
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = sorted(map(tuple, phrases.collocations(docs, least=20).collect()))
    assert got == by_hand(rows, 20) and len(got) > 100
    assert sorted(map(tuple, phrases.collocations(docs, least=5, share=80, most=50).collect())) == by_hand(rows, 5, 80, 50)


def odd_rows():
    rng = random.Random(1)
    words = ["a", "B", "é", "the", "x" * 300, "c\x1f", "日本", "\x85", "d"]
    blanks = [" ", "  ", "\t", " \t ", ".", ",\n", "\r", "\x0b", "! ", "\x0c", "; "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(blanks) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, ""]), text(rng.randrange(60))) for _ in range(120)]
    return [*rows, (None, None), ("en", ""), ("en", " . "), ("de", "a b " * 3000), ("de", "a b " * 3000), ("en", text(5000)), ("und", "a b c d e a b c d e")]


@pytest.mark.parametrize("part", [64, 1000, 1 << 21])
def test_odd_texts_in_parts(spark, monkeypatch, part):
    """Pieces longer than a part, words longer than a part, null and empty languages and texts."""
    monkeypatch.setattr(phrases, "PART", part)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, phrase long, size long").withColumnRenamed("size", "a.b").repartition(3)
    got = sorted(map(tuple, counted_in_process(rows, part))) if part < 1 << 21 else None
    want = by_hand(rows, 3)
    assert sorted(map(tuple, phrases.collocations(df, least=3).collect())) == want
    if got is not None:
        assert got == sorted((("und" if k is None else k), *v) for k, v in exact_counts(rows))
    assert phrases.collocations(df.limit(0)).count() == 0


def exact_counts(rows):
    total = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 6):
                total["und" if lang is None else lang].update((" ".join(words[i : i + size]), size) for i in range(len(words) - size + 1))
    return [(lang, (p, size, n)) for lang, c in total.items() for (p, size), n in c.items()]


def counted_in_process(rows, size):
    """Runs of all parts, found by their places, without a sketch."""
    total = Counter()
    batch = pa.RecordBatch.from_arrays([pa.array(["und" if k is None else k for k, _ in rows]), pa.array([t or "" for _, t in rows])], ["lang", "text"])
    raw, starts = phrases.plain(batch.column(1))
    seeds = phrases.seeds_of(batch.column(0))
    for where in phrases.parts(raw, starts, size):
        part = phrases.Part(raw, starts, seeds, *where)
        text = part.raw.tobytes()
        for k, value, whole in part.runs():
            assert len(value) == len(whole)
            for i in np.flatnonzero(whole & part.new[k - 1 :]):
                total[batch.column(0)[int(part.text[i])].as_py(), text[part.at[i] : part.end[i + k - 1]].decode(), k] += 1
    return [(*key, n) for key, n in total.items()]


def test_narrow_sketches_lose_nothing(spark, sf, monkeypatch):
    """With few cells nearly all runs reach the exact count; the result stays the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = sorted(map(tuple, phrases.collocations(docs, least=20).collect()))
    assert sorted(map(tuple, phrases.collocations(docs.repartition(7), least=20, most_cells=1 << 10).collect())) == wide
    with pytest.raises(ValueError):
        phrases.collocations(docs, least=256)


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**14, 10**16, 10**14, 10**14), (3 * 10**14, 9 * 10**16, 10**15 - 1, 7 * 10**14), (100, 101, 100, 100)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_same_as_sql(spark, sf):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet"))
    want = duck.sql(phrases.SQL)
    assert sorted(map(tuple, got.collect())) == sorted(want.project(", ".join(got.columns)).fetchall())
