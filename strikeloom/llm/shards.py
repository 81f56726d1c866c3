"""Sharding by rendezvous hashing over weighted shards.

Every shard draws a number for a record's key; the smallest draw, divided by the
shard's weight, wins. A new shard can only win records for itself, and a shard
that goes only gives up its own, so few records move when the count changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.llm.base import text_of

DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that key and shard decide: from MD5 of ``key:shard``."""
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def draws_of(key: Column, shards: int) -> Column:
    """Array of -log of the draws of shards 0 to ``shards`` - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: -F.log(draw(key, s)))


def winner(draws: Column, weights: Sequence[float]) -> Column:
    """struct<score, shard> of the smallest draw for its weight; a tie goes to the smaller number, weight 0 never wins."""
    given = F.array(*[F.lit(float(w)) for w in weights])
    scores = F.transform(draws, lambda d, i: F.when(F.get(given, i) > 0, F.struct((d / F.get(given, i)).alias("score"), i.alias("shard"))))
    return F.array_min(scores)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """struct<score, shard> of the shard that wins ``key``."""
    return winner(draws_of(key, len(weights)), weights)


def key_text(column: Column) -> Column:
    """A key as text; a null key is a key of its own."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def assign(rows: DataFrame, id_col: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """``rows`` with the shard of each (replacing a column of that name). Row by row, without a shuffle."""
    return rows.withColumn(column, shard_of(key_text(F.col(id_col)), weights)["shard"])


def write_shards(rows: DataFrame, path: str, id_col: str, weights: Sequence[float], files: int = 16) -> None:
    """Write ``rows`` into one folder for each shard, each in up to ``files`` files dealt by key."""
    placed = assign(rows, id_col, weights)
    deal = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(files))
    placed.repartition(len(weights) * files, "shard", deal).write.partitionBy("shard").parquet(path)


def slots(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text", digits: int = 3) -> DataFrame:
    """Each row's shard, its slot there (gapless from 0) and its shard among ``grown``.

    Columns: the id, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law``
    (``key``), ``shard``, ``slot``, ``grown_shard`` (null without ``grown``).
    A null text counts as empty; a null id is a key of its own; rows that are equal
    in all of this get slots in a row; other columns are left out; an empty table
    gives an empty table.

    Slots follow the MD5 of id, size and checksum. No shard is sorted in one task:
    its rows are dealt by the first ``digits`` of that digest, each bucket is
    numbered by itself and starts where the buckets before it end (only bucket
    counts meet in a task). Equal rows are counted before the shuffle, so that a
    key with many copies stays one row until slots are given out.
    """
    text = text_of(text_col)
    key = key_text(F.col(id_col))
    # drawn where the rows are read, once for both lists of shards
    sized = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), draws_of(key, max(len(weights), len(grown or []))).alias("draws_"))
    wider = winner(F.col("draws_"), grown)["shard"] if grown is not None else F.lit(None).cast("int")
    kinds = sized.select(id_col, "size", "text_crc32", winner(F.col("draws_"), weights)["shard"].alias("shard"), wider.alias("grown_shard"))
    kinds = kinds.groupBy(id_col, "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("copies"))
    order = F.md5(F.concat_ws(":", key, F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary"))
    placed = kinds.withColumn("order_", order).withColumn("bucket_", F.substring("order_", 1, digits))
    counts = placed.groupBy("shard", "bucket_").agg(F.sum("copies").alias("rows_"))
    before = W.partitionBy("shard").orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("start_"))
    inside = W.partitionBy("shard", "bucket_").orderBy("order_", F.col(id_col).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("first_", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(starts, ["shard", "bucket_"])
    out = numbered.withColumn("copy_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.select(F.col(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start_") + F.col("first_") + F.col("copy_")).alias("slot"), "grown_shard")


#: The sharding query in SQL; the checksum is reduced over the bytes with a table of 256 made from its polynomial.
SQL = """
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT rid, doc_id, octet_length(encode(text))::BIGINT + 8 AS size,
      xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
k AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') AS key FROM b),
s AS (SELECT rid, s, -ln((('0x' || substr(md5(key || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS score FROM k, range(25) r(s)),
p AS (SELECT rid, arg_min(s, score) FILTER (s < 24) AS shard, arg_min(s, score) AS grown_shard FROM s GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key || ':' || size || ':' || text_crc32), doc_id NULLS FIRST) - 1 AS slot, grown_shard::INT AS grown_shard
FROM k JOIN p USING (rid)
"""
