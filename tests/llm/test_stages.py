"""Stages of the pipeline on odd tables: null ids and texts, repeated rows, columns with the operators' own names; and the mix by hand."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_whole_tables import mixed

NAMES = ("epoch", "tokens_", "block", "slot", "quality_score", "quality_kept", "weak_label", "n_words", "base_failed", "kept", "bad_", "host_", "source_", "class_id", "class_size", "keeper_", "key_", "digest_", "n_tokens")


@pytest.fixture(scope="module")
def odd(spark):
    good = [" ".join(f"{w}{k}" for k in range(20) for w in ("the", "river", "of", "a", "town")) for _ in range(1)][0]
    other = " ".join(f"word{k} and the house" for k in range(40))
    rows = [(1, good, "s"), (1, good, "s"), (2, None, "s"), (None, other, None), (None, other, None), (3, "", ""), (4, other + " more", "t"), (5, "x " * 30000, "t"), (6, good + " tail", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)], F.lit(9).alias("a.b"))


@pytest.mark.parametrize("name", ["quality_rules", "quality_classifier", "near_dedup", "source_mix"])
def test_stage_keeps_its_input_s_columns(spark, sf, odd, name):
    import corpus_pipeline as P

    out = dict(P.STAGES)[name](spark, odd, sf)
    assert out.columns == odd.columns
    got = out.collect()
    before = Counter(odd.collect())
    assert set(got) <= set(before)
    if name == "near_dedup":
        assert Counter((r.doc_id, bool(r.text)) for r in got) == Counter([(1, True), (2, False), (3, False), (4, True), (5, True)])
    if name == "source_mix":
        assert set(got) == set(before)
    if name == "quality_rules":
        assert Counter(got) <= before and {r.doc_id for r in got} <= {None, 1, 4, 6}


@pytest.mark.parametrize("name", ["quality_rules", "quality_classifier", "source_mix", "token_ids"])
def test_stage_of_nothing(spark, sf, odd, name):
    import corpus_pipeline as P

    assert dict(P.STAGES)[name](spark, odd.limit(0), sf).count() == 0


def test_tokens_of_odd_rows(spark, sf, odd):
    import corpus_pipeline as P

    got = Counter((r.doc_id, r.n_tokens > 0) for r in P.token_ids(spark, odd, sf).collect())
    assert got == Counter((r.doc_id, bool(r.text)) for r in odd.collect())


def test_the_mix_by_hand(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Counter((r.doc_id, r.source, r.text) for r in P.source_mix(spark, docs, sf).collect())
    assert set(got) == {(r.doc_id, r.source, r.text) for r in docs.collect()}
    alone = docs.select("doc_id", "source", "text")
    assert Counter((r.doc_id, r.source, r.text) for r in P.source_mix(spark, alone, sf).collect()) == mixed([tuple(r) for r in alone.collect()])
