"""Mixing sources to target weights by temperature, in DataFrame functions alone.

Source token shares are raised to an exponent that is bisected until the mix has
a target entropy, unless small sources would then be repeated too often. The
weights are realised as block permutations: every pass over a source is a
permutation of it, laid along the whole mix, so that each block of the mix holds
every source's share to within one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.llm.base import SHARE, Work, column, join_keys, set_apart, written

def tokens_of(text_col: str = "text") -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up, 1 at least."""
    return F.greatest(F.ceil(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) / 4), F.lit(1)).cast("long")


def rounded(weight: Column) -> Column:
    """Rounded to nine places, under 0.001 to nine significant digits, so that no positive weight becomes 0."""
    return F.when(weight < 0.001, F.format_string("%.8e", weight).cast("double")).otherwise(F.round(weight, 9))


LEVELS = 6


def exponent(sources: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """The exponent, to six places, for sources (n_tokens) that are written; see ``weigh``.

    Entropy falls as the exponent grows, so the largest that reaches the target is
    bisected between 0 and 1. One pass over the sources takes the sums for all
    midpoints that LEVELS steps may need, so their number isn't bounded by a task.
    """
    found = sources.agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most")).first()
    if not found["k"]:
        return 1.0
    share = F.col("n_tokens").cast("double") / F.lit(float(found["n"]))

    def reached(exponents: list[float]) -> list[bool]:
        power = [F.pow(share, F.lit(e)) for e in exponents]
        sums = sources.agg(*[F.sum(x).alias(f"z{i}") for i, x in enumerate(power)], *[F.sum(x * F.log(share)).alias(f"l{i}") for i, x in enumerate(power)]).first()
        target = entropy * math.log(found["k"])
        return [math.log(sums[f"z{i}"]) - e * sums[f"l{i}"] / sums[f"z{i}"] >= target for i, e in enumerate(exponents)]

    wanted = 1.0
    if entropy is not None and not reached([1.0])[0]:
        low, high = 0.0, 1.0
        for _ in range(5):  # thirty steps, far beyond six places
            parts = 1 << LEVELS
            grid = [low + (high - low) * k / parts for k in range(1, parts)]
            good = dict(zip(range(1, parts), reached(grid), strict=True))
            lo, hi = 0, parts
            for _ in range(LEVELS):
                lo, hi = ((lo + hi) // 2, hi) if good[(lo + hi) // 2] else (lo, (lo + hi) // 2)
            low, high = (grid[lo - 1] if lo else low), (grid[hi - 1] if hi < parts else high)
        wanted = low
    spread = found["most"] / found["least"]
    least = 1 - math.log(repeats) / math.log(spread) if repeats is not None and spread > repeats else 0.0
    return round(max(wanted, least), 6)


def weigh(sources: DataFrame, entropy: float | None = 0.97, repeats: float | None = 2.0) -> DataFrame:
    """``sources`` (source, n_tokens) with the ``weight`` of each, rounded (``rounded``), and the ``exponent``, to six places.

    ``entropy`` is the target as a part of the largest, that of equal weights;
    the exponent is the largest that reaches it, 1 where the shares reach it
    themselves. ``repeats`` bounds how many times more often than any other a
    source may be passed; where both can't be met it comes first. There may be any
    number of sources; only sums over them reach the driver.
    """
    e = exponent(sources, entropy, repeats)
    power = F.pow(F.col("n_tokens").cast("double"), F.lit(e))
    total = sources.agg(F.sum(power).alias("z")).first()["z"]
    return sources.withColumns({"weight": rounded(power / F.lit(total)), "exponent": F.lit(e)})


def plan(sources: DataFrame, budget: int | None) -> DataFrame:
    """``sources`` with the ``quota`` of tokens and the ``passes`` of each.

    Without ``budget`` the mix is as long as it has to be for every document to
    be there once; then a quota is never under the source's tokens.
    """
    n, w = F.col("n_tokens"), F.col("weight")
    if budget is None:
        budget = sources.agg(F.ceil(F.max(n / w)).alias("b")).first()["b"] or 0
        quota = F.greatest(F.round(w * F.lit(float(budget))).cast("long"), n)
    else:
        quota = F.round(w * F.lit(float(budget))).cast("long")
    return sources.withColumns({"quota": quota, "passes": F.ceil(quota / n).cast("int")})


#: Equal rows are laid out in stretches of so many.
CHUNK = 256


def keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, tokens: Column | None) -> DataFrame:
    """``docs`` with key_ (a digest of the whole row; equal rows are interchangeable) and tokens_."""
    parts = [F.coalesce(x, F.lit("null")) for x in (F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.md5(F.col(text_col).cast("binary")))]
    rest = [column(c) for c in docs.columns if c not in (id_col, source_col, text_col)]
    if rest:
        parts.append(F.md5(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).cast("binary")))
    return docs.withColumns({"key_": F.md5(F.concat_ws(":", *parts).cast("binary")), "tokens_": tokens if tokens is not None else tokens_of(text_col)})


def placements(kinds: DataFrame, planned: DataFrame, block_tokens: int, seed: int, digits: int, work: Work) -> DataFrame:
    """key_, copies_, tokens_, copy_, epoch, block, slot of each row of the mix, from small rows alone.

    ``kinds`` has source_, key_, tokens_ and copies_ of the rows that are equal. No
    source is sorted in one task: a pass is dealt by the first ``digits`` of the
    order's digest, buckets are ordered by themselves, and only their sums are run
    up along the source. Many equal rows are laid out in stretches of CHUNK.
    """
    blocks = max(1, -(-(planned.agg(F.sum("quota").alias("q")).first()["q"] or 0) // block_tokens))
    per_source = planned.select(F.coalesce(F.concat(F.lit("s"), F.col("source_").cast("string")), F.lit("n")).alias("part_"), F.col("n_tokens").alias("total_"), F.col("quota").alias("quota_"), F.col("passes").alias("passes_"), "kinds_")
    rows = kinds.select(F.coalesce(F.concat(F.lit("s"), F.col("source_").cast("string")), F.lit("n")).alias("part_"), "key_", "tokens_", "copies_")
    n_kinds = kinds.count()
    spread = join_keys(rows, work.written(per_source, "sources"), "part_", "kinds_", n_kinds).filter("passes_ > 0")
    spread = spread.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes_") - 1)))
    spread = spread.withColumn("chunk_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies_") - 1) / CHUNK))))
    spread = spread.withColumn("order_", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), "key_", F.col("chunk_").cast("string")).cast("binary")))
    held = F.least(F.lit(CHUNK), F.col("copies_") - F.col("chunk_") * CHUNK)
    spread = spread.withColumns({"held_": held, "sum_": held * F.col("tokens_"), "bucket_": F.substring("order_", 1, digits)})
    sums = spread.groupBy("part_", "epoch", "bucket_").agg(F.sum("sum_").alias("sum_"))
    before = W.partitionBy("part_", "epoch").orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("part_", "epoch", "bucket_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("start_"))
    inside = W.partitionBy("part_", "epoch", "bucket_").orderBy("order_", "key_", "chunk_").rowsBetween(W.unboundedPreceding, -1)
    placed = spread.withColumn("run_", F.coalesce(F.sum("sum_").over(inside), F.lit(0))).join(starts, ["part_", "epoch", "bucket_"])
    placed = placed.withColumn("one_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held_") - 1)))
    at = F.col("epoch") * F.col("total_") + F.col("start_") + F.col("run_") + F.col("one_") * F.col("tokens_")
    cut = placed.withColumn("at_", at).filter(F.col("at_") < F.col("quota_"))
    cut = cut.withColumn("block", F.floor(F.col("at_") * F.lit(float(blocks)) / F.col("quota_")).cast("long"))
    cut = cut.withColumn("deal_", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("block").cast("string"), "order_").cast("binary")))
    cut = cut.withColumn("slot", F.row_number().over(W.partitionBy("block").orderBy("deal_", "at_")).cast("long") - 1)
    return cut.select("key_", "copies_", "tokens_", (F.col("chunk_") * CHUNK + F.col("one_")).alias("copy_"), "epoch", "block", "slot")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, entropy: float | None = 0.97, repeats: float | None = 2.0, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 0, digits: int = 3) -> DataFrame:
    """``docs``, each row as often as the mix has it, with tokens_, epoch, block and slot.

    ``block`` counts stretches of ``block_tokens``; ``slot`` is the row's place in a
    permutation of its block. A null source is a source of its own; rows are told
    apart by all their columns, so rows of a null or repeated id are mixed as rows,
    and equal rows as so many; null and empty texts count one token; columns named
    ``tokens_``, ``epoch``, ``block`` or ``slot`` are replaced, others may have any
    name; an empty table gives an empty table. The same seed gives the same mix,
    however the input is partitioned.

    Places are given out on digests and token counts alone. Then whole rows are
    shuffled once, to their places, and repeated after that. A row that ``docs`` has
    very many times is shuffled once for each stretch of its places.
    """
    docs, back = set_apart(docs.drop("tokens_", "epoch", "block", "slot"), id_col, source_col, text_col)
    own = keyed(docs, id_col, source_col, text_col, tokens)
    with Work(docs.sparkSession, "mixing") as work:
        kinds = own.groupBy(column(source_col).alias("source_"), "key_", "tokens_").agg(F.count("*").alias("copies_"))
        kinds = work.written(kinds, "kinds")
        totals = kinds.groupBy("source_").agg(F.sum(F.col("tokens_") * F.col("copies_")).alias("n_tokens"), F.count("*").alias("kinds_"))
        planned = work.written(plan(weigh(work.written(totals, "sources"), entropy, repeats), budget), "plan")
        places = written(placements(kinds, planned, block_tokens, seed, digits, work), "places")
        limit = max(1000, (kinds.agg(F.sum("copies_").alias("n")).first()["n"] or 0) // SHARE)
        hot = written(kinds.filter(F.col("copies_") > limit).select("key_", F.ceil(F.col("copies_") / limit).alias("parts_")), "hot-rows")  # fewer than SHARE
    more = ["tokens_", "epoch", "block", "slot"]
    named = [column(c) for c in docs.columns]
    rows, often = own.drop("tokens_"), None
    if not hot.isEmpty():
        few = F.broadcast(hot)
        one = rows.join(few, "key_").groupBy("key_", "parts_").agg(F.first(F.struct(*named)).alias("row of docs"))
        one = one.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_") - 1))).drop("parts_")
        often = places.join(few, "key_").withColumn("part_", F.pmod("copy_", "parts_")).join(one, ["key_", "part_"]).select("row of docs.*", *more)
        rows, places = rows.join(few, "key_", "left_anti"), places.join(few, "key_", "left_anti")
    lists = places.groupBy("key_", "copies_", "tokens_").agg(F.collect_list(F.struct("copy_", "epoch", "block", "slot")).alias("places_"))
    met = rows.join(lists.hint("shuffle_merge"), "key_")
    # equal rows share their places out among themselves
    turn = F.when(F.col("copies_") > 1, F.row_number().over(W.partitionBy("key_").orderBy("key_")) - 1).otherwise(0)
    met = met.withColumn("turn_", turn.cast("long")).withColumn("place_", F.explode(F.filter("places_", lambda p: p["copy_"] == F.col("turn_"))))
    out = met.select(*named, "tokens_", "place_.epoch", "place_.block", "place_.slot")
    if often is not None:
        out = out.unionByName(often)
    return out.select(*back, *more)


#: The mixing query in SQL, with the defaults of ``mix``.
SQL = """
WITH RECURSIVE d AS (SELECT *, (row_number() OVER (PARTITION BY key) - 1)::BIGINT AS copy FROM (SELECT doc_id, source, greatest(ceil(coalesce(octet_length(encode(text)), 0) / 4.0), 1)::BIGINT AS n_tokens,
      md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), coalesce(md5(text), 'null'))) AS key FROM documents)),
t AS (SELECT source, sum(n_tokens)::BIGINT AS n FROM d GROUP BY source),
p AS (SELECT list(n::DOUBLE / total ORDER BY n) AS ps, count(*)::DOUBLE AS k FROM t, (SELECT sum(n)::DOUBLE AS total FROM t)),
m AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 1.0::DOUBLE AS e
      UNION ALL
      SELECT step + 1, CASE WHEN good AND step > 0 THEN e ELSE lo END, CASE WHEN good OR step = 0 THEN hi ELSE e END,
             CASE WHEN step = 0 AND good THEN NULL ELSE ((CASE WHEN good AND step > 0 THEN e ELSE lo END) + (CASE WHEN good OR step = 0 THEN hi ELSE e END)) / 2 END
      FROM (SELECT m.*, ln(list_sum(list_transform(ps, lambda x: pow(x, e)))) - e * list_sum(list_transform(ps, lambda x: pow(x, e) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, e))) >= 0.97::DOUBLE * ln(k) AS good FROM m, p WHERE step <= 60 AND e IS NOT NULL)),
x AS (SELECT CASE WHEN bool_or(e IS NULL) THEN 1.0::DOUBLE ELSE max(lo) END AS wanted FROM m),
r AS (SELECT CASE WHEN list_max(ps) / list_min(ps) > 2 THEN 1 - ln(2.0::DOUBLE) / ln(list_max(ps) / list_min(ps)) ELSE 0.0::DOUBLE END AS least FROM p),
w AS (SELECT source, n, pow(n::DOUBLE, e) / sum(pow(n::DOUBLE, e)) OVER () AS share, CASE WHEN share < 0.001 THEN printf('%.8e', share)::DOUBLE ELSE round(share, 9) END AS weight FROM t, (SELECT round(greatest(wanted, least), 6) AS e FROM x, r)),
q AS (SELECT source, n, greatest(round(weight * budget)::BIGINT, n) AS quota FROM w, (SELECT ceil(max(n / weight))::DOUBLE AS budget FROM w)),
b AS (SELECT greatest(1, ceil(sum(quota) / 1048576.0))::DOUBLE AS blocks FROM q),
e AS (SELECT d.*, n, quota, unnest(range(ceil(quota / n)::BIGINT)) AS epoch FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
o AS (SELECT *, md5('0:' || epoch || ':' || key || ':' || (copy // 256)) AS ord FROM e),
a AS (SELECT *, epoch * n + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY ord, key, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM o),
c AS (SELECT *, floor(pos * blocks / quota)::BIGINT AS block FROM a, b WHERE pos < quota)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, block, row_number() OVER (PARTITION BY block ORDER BY md5('0:' || block || ':' || ord), pos) - 1 AS slot FROM c
"""
