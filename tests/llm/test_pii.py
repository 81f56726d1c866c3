"""Base spans against the patterns as given, disclosure against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from strikeloom.llm import pii

# fixed values: the patterns as they are given
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def given(text):
    out = []
    for k, (kind, pattern) in enumerate(GIVEN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                if not 12 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "x.y+z", "1", "23", "456", "+", " ", "-", "(", ")", "é", "4111 1111 1111 1111", "10.0.0.255", "+44 (20) 7946-0958", "256", "\n", "%", "a@b", ",", "0", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert [(a, k, b) for a, k, b, _ in pii.mentions(text)] == [(a, k, b) for a, k, b, _ in given(text)], text


def test_very_long_runs_take_linear_time():
    import time

    for text in ("a" * 3_000_000, "1" * 3_000_000, "1." * 1_500_000, "a@" * 1_500_000, "+1" * 1_000_000, "+1 " + "-" * 2_000_000, "a.b@c " * 200_000):
        began = time.process_time()
        found = pii.mentions(text)
        assert time.process_time() - began < 8
        assert not found or text.startswith(("a.b@c", "1."))


def by_hand(rows, least=3, generalise=0.6, remove=0.9):
    docs, near, ents, has = [], defaultdict(set), defaultdict(set), defaultdict(set)
    for i, (_, text) in enumerate(rows):
        text = text or ""
        spans = given(text)
        words = [m for m in re.finditer(r"[^\W_]+", text)]
        free = [m for m in words if not any(a < m.end() and m.start() < b for a, _, b, _ in spans)]
        here = []
        for a, _, b, kind in spans:
            value = text[a:b].lower() if kind == "email" else ".".join(str(int(x)) for x in text[a:b].split(".")) if kind == "ip" else re.sub("[^0-9]", "", text[a:b])
            before, after = [m for m in free if m.start() < a][-10:], [m for m in free if m.start() >= b][:10]
            here += [((kind, value), m) for m in before + after]
            ents[kind, value].add(i)
        for e, m in here:
            near[e, m[0].lower()].add(i)
        for m in words:
            has[m[0].lower()].add(i)
        docs.append((spans, here))
    n, kinds = len(rows), {}
    for (e, t), both in near.items():
        if len({rows[i][1] for i in both}) >= least and len(ents[e]) < n:
            rate = math.log2(n * len(both) / (len(ents[e]) * len(has[t]))) / math.log2(n / len(ents[e]))
            if rate >= generalise:
                kinds[e, t] = 5 if rate >= remove else 4
    out = []
    for (i, _), (spans, here) in zip(rows, docs, strict=True):
        more = {}
        for e, m in here:
            if (e, m[0].lower()) in kinds:
                more[m.span()] = max(more.get(m.span(), 0), kinds[e, m[0].lower()])
        every = sorted(spans + [(a, k, b, pii.KINDS[k]) for (a, b), k in more.items()])
        out.append((i, *[sum(x[3] == k for x in spans) for k in GIVEN], hashlib.sha256(joined(spans).encode()).hexdigest(), joined(every)))
    return out


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, pii.personal_data(docs).collect())) == sorted(by_hand(rows))


def planted():
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(400)]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"{some(30)} {rng.choice(['Zaphod', 'zaphod'])} wrote from zap@example.org about {some(20)}") for i in range(12)]
    rows += [(100 + i, f"{some(25)} {i} {some(20)} ring +44 20 7946 0958 at Megadodo {some(12)}") for i in range(6)]
    rows += [(150 + i, f"{some(25)} Megadodo {i} {some(20)}") for i in range(6)]
    rows += [(200 + i, some(60)) for i in range(80)]
    rows += [(300, "copied Slartibartfast slart@example.net here")] * 9  # one text, however often, reveals nothing
    return [*rows, (None, None), (None, ""), (405, "a@b.c"), (405, "a@b.c"), (406, "host 10.0.0.1, port 10.0.0.1. " * 3000), (407, "x" * 300 + " q@r.st " + "Y" * 300)]


def test_terms_that_reveal(spark):
    rows = planted()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key long, spans long, term long").withColumnRenamed("term", "a.b").repartition(3)
    got = sorted(map(tuple, pii.personal_data(df).collect()), key=str)
    assert got == sorted(by_hand(rows), key=str)
    spans = {r[0]: r[6] for r in got if r[0] is not None}
    assert all("removed" in spans[i] for i in range(12)) and all("generalised" in spans[100 + i] for i in range(6))
    assert "removed" not in spans[300] and not any(spans[200 + i] for i in range(80)) and not spans[150]
    texts = {r.doc_id: r.sanitised for r in pii.personal_data(df.filter("doc_id < 300"), with_text=True).collect()}
    assert "[EMAIL]" in texts[0] and "aphod" not in texts[0] and "[PHONE]" in texts[100]
    assert pii.personal_data(df.limit(0)).count() == 0


def test_hot_entities_and_terms(spark, monkeypatch):
    """The same with every key that several rows have going by a broadcast."""
    from strikeloom.llm import base

    real = base.join_keys
    monkeypatch.setattr(pii, "join_keys", lambda rows, per_key, key, count, total, how="inner": real(rows, per_key.withColumn(count, per_key[count] * 400), key, count, total, how))
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, pii.personal_data(df).collect()), key=str) == sorted(by_hand(rows), key=str)


def test_disclosure_of_an_entity_in_every_document_is_null(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(4, 4, 4), (2, 2, 2)], "b long, e long, t long").select(pii.disclosure(4, F.col("b"), F.col("e"), F.col("t"))).collect()
    assert got[0][0] is None and got[1][0] == pytest.approx(1)
