"""Round trips of tar shards, archives, chats and shards."""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm import chat, media, shards, warc
from strikeloom.llm.base import fresh_dir


def test_media_from_the_stored_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    folder = fresh_dir(spark, "media")
    index = media.store_texts(docs, folder)
    got = {r.doc_id: r for r in media.read_payloads(media.read_headers(index)).collect()}
    for r in docs.collect():
        raw = r.text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.width, x.bit_depth) == (len(raw), len(payload), 64, 8)
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest() and x.tail_crc32 == zlib.crc32(payload[-64:])
    shard = {x.shard for x in got.values()}.pop()
    with tarfile.open(shard.removeprefix("file:")) as tar:
        names = [m.name for m in tar.getmembers()]
        assert len(names) == len(set(names)) == len({x.media_sha256 for x in got.values() if x.shard == shard})
        body = tar.extractfile(names[0]).read()
        assert hashlib.sha256(body).hexdigest() + ".png" == names[0]


def test_media_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 64, 1), (None, "\0", 1), (4, "é" * 70000, 1), (2, "", 1)], "doc_id long, text string, length int")
    got = [(r.doc_id, r.n_bytes, r.payload_bytes) for r in media.media_columns(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 64), (2, 0, 64), (3, 64, 64), (None, 1, 64), (4, 140000, 140032), (2, 0, 64)], key=str)
    assert media.media_columns(df.limit(0)).count() == 0
    bad = bytearray(media.to_png(bytes(64), 3))
    bad[-20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.from_png(bytes(bad))


def test_archives_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(pages.filter("page_id < 20").withColumn("page_id", F.col("page_id") + 1000)).unionByName(pages.filter("page_id = 3").withColumn("page_id", F.lit(None).cast("long")))
    got = warc.read_archives(warc.write_archives(pages, fresh_dir(spark, "warc"))).collect()
    assert not [r for r in got if r.error]
    rows = pages.collect()
    least = {}
    for p in rows:
        if p.page_id is not None:
            least[p.html] = min(least.get(p.html, p.page_id), p.page_id)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter((p.page_id, *(("response", None) if least[p.html] == p.page_id or len(p.html.encode()) < 100 else ("revisit", least[p.html]))) for p in rows)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes


def test_archive_edges(spark):
    df = spark.createDataFrame([(1, None, None, 0), (2, "http://a/\r\nX: y", "short", 0), (3, "u", "short", 0), (None, "u", "z" * 200, 0), (4, "u", "z" * 200, 0), (4, "u", "z" * 200, 0)], "page_id long, url string, html string, file int")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted([(1, "response", None, 0), (2, "response", None, 5), (3, "response", None, 5), (None, "revisit", 4, 200), (4, "response", None, 200), (4, "response", None, 200)], key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_broken_archives_are_reported(spark, tmp_path):
    good = warc.record_bytes(1, "u", b"hello", 5, hashlib.sha256(b"hello").hexdigest(), None, False)
    wrong = good.replace(b"Content-Length: 5", b"Content-Length: 6").replace(b"hello", b"jello")
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", warc.DICTIONARY_FRAME, 8) + b"12345678" + pack(good) + pack(wrong) + pack(b"junk") + pack(good)[:-4])
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "file string")
    got = warc.read_archives(files).orderBy("offset").collect()
    assert [bool(r.error) for r in got] == [False, True, True, True] and got[0].payload == b"hello"


def test_chat_round_trip(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "assistant", None), (-8, 0, None, "<|turn|>\\e<|end|>\n\\"), (None, 1, "a\nb", "x"), (-9, 0, "assistant", "<<<s>\\b")], "conv_id long, turn long, role string, text string")
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(odd)
    parts = chat.format_conversations(rows)
    for segment in [r.segment for r in parts.filter("conv_id < 0").collect()]:
        assert not [c for c in chat.CONTROL if c in segment.removeprefix(chat.OPEN).removesuffix(chat.CLOSE)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    every = {}
    for r in sorted(rows.collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        every.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert set(got) == set(every)
    for c, said in every.items():
        learned = "".join(t for role, t in said if role == "assistant")
        assert got[c].n_turns == len(said) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in said).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(rows.limit(0))).count() == 0


def test_chat_parts(spark):
    data = [json.dumps({"conv_id": 1, "turn": t, "role": "user", "text": None, "parts": p}) for t, p in [(0, [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}]), (1, [{"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}])]]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("parts", T.ArrayType(chat.PART))])
    df = spark.createDataFrame([(x,) for x in data], "j string").select(F.from_json("j", schema).alias("x")).select("x.*")
    got = chat.format_conversations(df).orderBy("position").collect()
    whole = "".join(r.segment for r in got)
    found = [a for r in got for a in r.attachments]
    assert [(a.number, a.kind, a.ref, a.tokens) for a in found] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 25), (2, "document", "c.pdf", 768)]
    for a in found:
        assert whole[a.at :].startswith(f"<|{a.kind}:{a.number}|>")
    assert [r.expanded_tokens for r in got] == [4, 793]


def test_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shards.slots(docs, [1.0] * 24, [1.0] * 25).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    by = {}
    for r in rows:
        assert r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id])
        assert r.grown_shard in (r.shard, 24)
        draws = [(int(hashlib.md5(f"{r.doc_id}:{s}".encode()).hexdigest()[:13], 16)) for s in range(25)]
        assert r.shard == max(range(24), key=lambda s: draws[s])
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shard_edges_and_weights(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5)] * 50 + [(None, None, 5), (2, "", 5)], "doc_id long, text string, shard int")
    got = shards.slots(df, [1.0, 2.0], None).collect()
    assert len(got) == 52
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shards.slots(df.limit(0), [1.0] * 3).count() == 0
    share = spark.range(20000).select(shards.shard_of(F.col("id").cast("string"), [1.0, 3.0, 0.0])["shard"].alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20000 for r in share}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.02
    shards.write_shards(df.drop("shard"), f"file://{tmp_path}/out", "doc_id", [1.0, 1.0])
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 52


def test_parts_that_are_unknown_or_null(spark):
    rows = [(1, 0, "user", None, [None, ("video", "x", "r", None, None, None, None), ("text", "tail", None, None, None, None, None)]), (1, 1, "assistant", "four", None), (2, 0, None, None, [])]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("parts", T.ArrayType(chat.PART))])
    formatted = chat.format_conversations(spark.createDataFrame(rows, schema))
    got = {(r.conv_id, r.position): r for r in formatted.collect()}
    assert "<|unknown:0|>tail" in got[1, 0].segment and got[1, 0].attachments[0].kind == "video"
    assert (got[1, 0].expanded_tokens, got[1, 0].text_tokens, got[1, 1].text_tokens) == (0, 1, 1)
    back = {r.conv_id: r for r in chat.read_back(formatted.orderBy(F.rand(3))).collect()}
    assert back[1].n_turns == 2 and back[1].loss_chars == 4 and back[2].n_turns == 1
