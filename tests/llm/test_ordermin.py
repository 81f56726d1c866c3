"""Near-duplicates against brute force, and the alignment against the plain recurrence."""

from __future__ import annotations

import random
from collections import Counter

from strikeloom.llm import ordermin as O


def common(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_banded_alignment():
    r = random.Random(2)
    for _ in range(1500):
        a = [r.randrange(r.choice([3, 30])) for _ in range(r.randrange(1, 30))]
        b = list(a)
        for _ in range(r.randrange(6)):
            i = r.randrange(len(b) + 1)
            if r.random() < 0.5:
                b.insert(i, r.randrange(30))
            elif i < len(b) and len(b) > 1:
                del b[i]
        least, want = r.randrange(1, max(2, min(len(a), len(b)))), common(a, b)
        assert O.paired(a, b, least) == (want if want >= least else 0)


def shingles(text):
    w = (text or "").lower().split()
    return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def brute(rows):
    """Smallest id of each component of pairs that are near."""
    sh = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sh}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sh)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sh[a], sh[b]
            if not x or not y or sum((Counter(x) & Counter(y)).values()) < O.least_paired(len(x), len(y), 0.8):
                continue
            p = common(x, y)
            if p / (len(x) + len(y) - p) >= 0.8 - 1e-9:
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    return {i: find(i) for i in sh}


def test_documents_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.class_id for r in O.near_duplicates(docs).collect()} == want


def edited(words, r, n):
    words = list(words)
    for _ in range(n):
        i = r.randrange(len(words))
        words[i] = f"x{r.randrange(10**6)}"
    return words


def test_large_group_chain_and_shared_passage(spark):
    """A group of near copies of one text, a chain of edits whose ends are far apart, and texts that share a passage only."""
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(250)]
    rows = [(i, " ".join(edited(base, r, 2))) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(30)]
    chain = [f"c{r.randrange(5000)}" for _ in range(300)]
    for i in range(8):
        rows.append((200 + i, " ".join(chain)))
        chain = edited(chain, r, 4)
    passage = [f"p{k}" for k in range(60)]
    rows += [(300 + i, " ".join([f"q{i}_{k}" for k in range(100)] + passage)) for i in range(40)]
    want = brute(rows)
    got = {x.doc_id: x.class_id for x in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert len({got[i] for i in range(300, 340)}) == 40


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "One  two"), (6, "one two three"), (None, "one two"), (7, "y " * 30000), (8, "y " * 30000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, class_id int")
    got = sorted(((x.doc_id, x.class_id) for x in O.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (None, 4), (7, 7), (8, 7)], key=str)
    assert O.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "z")], "doc_id long, text string")
    assert sorted((x.doc_id, x.class_id, x.class_size) for x in O.near_duplicates(twice).collect()) == [(1, 1, 2), (1, 1, 2), (2, 2, 1)]


def test_blocks_find_what_pairs_find(spark):
    """Every bucket through blocks of four, against brute force."""
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(base, r, r.randrange(1, 6)))) for i in range(90)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in O.near_duplicates(df, pairs_up_to=1, block=4).collect()} == want
    assert {x.doc_id: x.class_id for x in O.near_duplicates(df, pairs_up_to=10**6).collect()} == want


def test_repeated_ids_lose_no_link(spark):
    """Two texts under one id, each with a near copy; a text of an id that has another text too."""
    rows, texts = [], []
    for k in (0, 100, 200):
        a, b = " ".join(f"a{k}_{i}" for i in range(60)), " ".join(f"b{k}_{i}" for i in range(60))
        rows += {0: [(1, a), (1, b), (2, a + " tail")], 100: [(101, a), (103, b), (102, a + " tail")], 200: [(201, b), (201, a), (202, b + " x y"), (203, a + " tail")]}[k]
        texts += [a, b]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, keeper_ int, `id.` int, id_ int")
    got = Counter((x.doc_id, x.class_id, x.class_size) for x in O.near_duplicates(df).collect())
    assert got == Counter([(1, 1, 2), (1, 1, 1), (2, 1, 2), (101, 101, 2), (102, 101, 2), (103, 103, 1), (201, 201, 2), (201, 201, 2), (202, 201, 2), (203, 201, 2)])
    kept = O.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(x.text for x in kept.collect()) == sorted(texts)


def test_one_row_of_each_class_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (None, c), (None, c + " end"), (None, None), (7, ""), (7, ""), (9, b), (9, b), (11, "alone in the world")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_ int")
    kept = O.keep_one(df).collect()
    assert Counter((x.doc_id, x.text) for x in kept if x.text and not x.text.startswith("c0")) == Counter([(5, a), (3, b), (11, "alone in the world")])
    assert sum((x.text or "").startswith("c0") for x in kept) == 1
    assert Counter((x.doc_id, x.text) for x in kept if not x.text) == Counter([(None, None), (7, ""), (7, "")])
    assert sorted(kept, key=str) == sorted(O.keep_one(df.repartition(3)).collect(), key=str)
    assert O.keep_one(df.limit(0)).count() == 0


def test_sketch_in_blocks_is_the_sketch():
    import numpy as np

    own = O.mixed(np.arange(1, 5001, dtype=np.uint64))
    for seed in (3, 9):
        drawn = O.mixed(own ^ np.uint64(seed))
        assert list(O.smallest(own, np.uint64(seed), 4, step=64)) == sorted(np.argsort(drawn)[:4].tolist())


def test_short_texts_meet(spark):
    """A text of nine words and its first eight: five and four shingles, similarity 0.8, 300 times over."""
    rows = []
    for k in range(300):
        words = [f"w{k}_{i}" for i in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    got = {x.doc_id: x.class_id for x in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i // 2 * 2 for i in got)
