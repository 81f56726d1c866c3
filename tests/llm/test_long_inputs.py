"""Inputs of many megabytes: alignment, words without blanks, turns of many parts, archives of many frames, long URLs."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeloom.llm import chat, ordermin, urls, warc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("kinds", [3, 12, 5000])
def test_both_alignments_are_exact(monkeypatch, kinds):
    rng = random.Random(kinds)
    for _ in range(250):
        a = [rng.randrange(kinds) for _ in range(rng.randrange(1, 90))]
        b = [x if rng.random() < 0.9 else rng.randrange(kinds) for x in a if rng.random() < 0.95] + [rng.randrange(kinds) for _ in range(rng.randrange(4))]
        least = ordermin.least_paired(len(a), len(b), 0.8)
        want = lcs(a, b)
        for other in (ordermin.chained, ordermin.banded):
            monkeypatch.setattr(ordermin, "chained", other)
            monkeypatch.setattr(ordermin, "banded", other)
            assert ordermin.paired(a, b, least) == (want if want >= least else 0)
            monkeypatch.undo()


def test_a_pair_of_a_million_shingles():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 1_000_000, dtype=np.uint64)
    b = a.copy()
    b[rng.integers(0, len(b), 3)] = 7
    far = a.copy()
    far[rng.integers(0, len(b), 90_000)] = rng.integers(0, 1 << 60, 90_000, dtype=np.uint64)
    for other in (b, far):
        began = time.process_time()
        assert ordermin.near(a, other, 0.8)
        assert time.process_time() - began < 4
    assert not ordermin.near(a, a[::-1].copy(), 0.8)


def test_a_turn_of_many_parts_takes_linear_time():
    parts = [{"type": "text", "text": "x"}, {"type": "image", "ref": "r", "width": 28, "height": 28}] * 100_000
    began = time.process_time()
    flat = chat.PartVisitor().visit(parts)
    assert time.process_time() - began < 5 and len(flat.attachments) == 100_000
    whole = "".join(flat.text)
    assert all(whole[x["at"] :].startswith("<|image:") for x in flat.attachments[::997])


def test_a_long_conversation_and_a_long_turn(spark):
    rows = [(1, t, "assistant", f"t{t}") for t in range(3000)] + [(2, 0, "user", "é</s>" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 3000 and got[1].loss_chars == sum(len(r[3]) for r in rows[:-1]) and got[2].n_turns == 1 and got[2].loss_chars == 0


def test_archives_of_many_frames_and_a_large_page(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("html"))
    large = spark.createDataFrame([(9000, "http://b/", "<p>" + "".join(random.Random(1).choices("abcdef ", k=5_000_000)))], "page_id long, url string, html string")
    got = warc.round_trip(pages.unionByName(large)).select("page_id", "payload_bytes").collect()
    assert len(got) == 3001 and {r.page_id: r.payload_bytes for r in got}[9000] == 5_000_003


def test_long_urls_are_judged_like_short_ones(spark, monkeypatch):
    rules = [("block", "com/en/"), ("allow", "net/")]
    rows = [(i, f"http://x{i % 7}.com/en/{i}") for i in range(300)] + [(300 + i, f"http://y{i % 7}.net/{i}") for i in range(300)]
    rows += [(900, "http://z.org/" + "x1" * 200_000), (901, "http://z.org/en/7"), (902, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    model = urls.fit(df, rules)
    got = {r.page_id: r for r in urls.judge(df, rules, model).collect()}
    assert len(got) == len(rows) and got[900].margin == pytest.approx(model.margin(rows[600][1]), abs=1e-6)
    from strikeloom.llm import base

    real = base.join_keys
    monkeypatch.setattr(urls, "join_keys", lambda r, p, key, count, total, how="inner": real(r, p.withColumn(count, F.col(count) * 1000), key, count, total, how))
    assert {r.page_id: r.margin for r in urls.judge(df, rules, model).collect()} == {i: r.margin for i, r in got.items()}


def test_a_word_of_a_million_letters_without_blanks():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from strikeloom.llm.pieces import MergeEncoder

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoder, library = MergeEncoder(open(path, "rb").read()), SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    for text in ("".join(rng.choices("aeinrst", k=400_000)), "".join(rng.choices("的一是不了人我在有他", k=200_000)), "".join(rng.choices("ABCDEFabcdef0123456789+/", k=200_000))):
        began = time.process_time()
        assert encoder.encode(text) == library.encode(text)
        assert time.process_time() - began < 30
    assert Counter(encoder.encode("")) == Counter()
