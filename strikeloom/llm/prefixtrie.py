"""Trie of conversation prefixes, kept as chains of nodes that one conversation owns.

A node is a sequence of first turns; its owner is the smallest conversation that
starts with it. What a conversation owns is one chain, from its first owned depth
down to its end, as fewer conversations share a longer prefix. That depth is found
by binary search: every round joins one prefix digest of each conversation to the
smallest conversation of each shared digest. Chains hang from chains, so sums over
subtrees are taken over chains first (by pointer doubling, in rounds that grow with
the logarithm of the tree's height) and then run up each chain from its end.

Digests of prefixes are sums of digests of (place, turn), so that a conversation of
any length can be summed in stretches, and no conversation lands in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm.base import MOST_BROADCAST, SHARE, Work, column, fresh_dir, join_keys, small, text_of

#: 32-bit pieces of a turn's SHA-256 that are summed one by one.
LANES = 8
#: Depths that one row of the search carries.
BLOCK = 64
#: Turns that one window runs over.
STRETCH = 4096
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered(work: Work, conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest of (role, text), n_bytes of the text.

    Turns are in the order of ``turn``, nulls first, those of one number by role and
    then digest; null roles and texts are empty; rows without conv_id belong to no
    conversation and are left out; repeated rows are turns each. Rows are dealt by
    ranges of that order and counted in each range, so that a conversation may
    spread over many tasks.
    """
    role, text = text_of("role"), text_of("text")
    turns = conversations.filter(column("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    ).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]
    dealt = work.written(turns.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    split = parts.withColumn("before", before).filter(F.col("before").isNotNull()).drop("n")  # one a range at most
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = dealt.withColumn("at", at).join(F.broadcast(split), ["conv_id", "part"], "left")
    return work.written(placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "digest", "n_bytes"), "placed")


def branched(work: Work, turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches: the first h turns of the group's leader, then a conversation's own turns after its first h.

    The leader of c is c - c % ``group`` (all its turns if it has fewer than h, none
    if it isn't there), h the CRC-32 of c in decimal modulo ``most``. Returns turns
    (of ``ordered``'s columns) and one row for each conversation with its ``length``.
    """
    sizes = work.written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    own = sizes.withColumns({"leader": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string")) % most})
    led = own.join(sizes.select(F.col("conv_id").alias("leader"), F.col("n").alias("has")), "leader", "left")
    taken = F.least("h", F.coalesce("has", F.lit(0)))
    convs = work.written(led.select("conv_id", "n", "leader", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "branches")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rest = join_keys(turns, convs.select("conv_id", "n", "h", "taken"), "conv_id", "n", total).filter(F.col("place") > F.col("h"))
    rest = rest.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "digest", "n_bytes")
    asked = convs.filter("taken > 0").select(F.col("conv_id").alias("branch"), F.col("leader").alias("conv_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("place"))
    first = asked.join(turns.filter(F.col("place") < most), ["conv_id", "place"]).select(F.col("branch").alias("conv_id"), "place", "digest", "n_bytes")
    return work.written(rest.unionByName(first), "rebuilt"), convs.select("conv_id", "length")


def run_up(rows: DataFrame, longest: DataFrame, key: str, place: str, sums: list[str], down: bool = False) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its running sum along ``place`` (from the end if ``down``) within ``key``.

    Windows run over stretches of STRETCH places; for the keys of ``longest``, which
    have more, the sums of the stretches before are added.
    """
    by = F.col(place).desc() if down else F.col(place)
    run = Window.partitionBy(key, "stretch").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stretch", F.expr(f"`{place}` div {STRETCH}"))
    out = rows.withColumns({c: F.sum(c).over(run) for c in sums})
    if longest.isEmpty():
        return out.drop("stretch")
    totals = rows.join(small(longest.select(key)), key, "left_semi").groupBy(key, "stretch").agg(*[F.sum(c).alias(f"{c} before") for c in sums])
    past = Window.partitionBy(key).orderBy(F.col("stretch").desc() if down else F.col("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"{c} before": F.sum(f"{c} before").over(past) for c in sums})
    out = out.join(small(totals), [key, "stretch"], "left")
    return out.select(*[(F.col(c) + F.coalesce(column(f"{c} before"), F.lit(0))).alias(c) if c in sums else F.col(c) for c in rows.columns if c != "stretch"])


def prefixes(work: Work, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, prefix (32 bytes), n_bytes of the last text: every prefix but the empty one."""
    turn = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("digest")), 256)
    lanes = [f"lane{k}" for k in range(LANES)]
    cut = {lane: F.conv(F.substring("turn", 8 * k + 1, 8), 16, 10).cast("long") for k, lane in enumerate(lanes)}
    rows = turns.withColumn("turn", turn).withColumns(cut).drop("turn", "digest")
    summed = run_up(rows, convs.filter(F.col("length") >= STRETCH), "conv_id", "place", lanes)
    return work.written(summed.select("conv_id", F.col("place").alias("depth"), F.unhex(F.sha2(F.concat_ws(",", *lanes), 256)).alias("prefix"), "n_bytes"), "prefixes")


class Minima:
    """The smallest conversation of each shared prefix, asked in batches.

    Prefixes that more than one in SHARE of all conversations have (and over 1,000)
    go by a broadcast if they are few, so that no task gets all that ask for one.
    """

    def __init__(self, work: Work, nodes: DataFrame, n_convs: int):
        limit = max(1000, n_convs // SHARE)
        shared = nodes.filter("n_convs > 1").select("prefix", F.col("conv_id").alias("owner"), "n_convs")
        hot = work.written(shared.filter(F.col("n_convs") > limit).drop("n_convs"), "hot")
        self.hot = F.broadcast(hot) if 0 < hot.count() <= MOST_BROADCAST else None
        self.cold = (shared if self.hot is None else shared.filter(F.col("n_convs") <= limit)).drop("n_convs")

    def owners(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have a ``prefix``, with its ``owner``; null where no two conversations share it."""
        if self.hot is None:
            return rows.join(self.cold, "prefix", "left")
        rest = rows.join(self.hot.select("prefix"), "prefix", "left_anti").join(self.cold, "prefix", "left")
        return rows.join(self.hot, "prefix").unionByName(rest)


def first_owned(work: Work, known: DataFrame, minima: Minima) -> DataFrame:
    """conv_id, first (the first owned depth; null if a smaller conversation is the same), above (the prefix before it, or the whole one; null: the root's).

    Blocks of BLOCK depths are searched each for itself, all at once, so the number
    of rounds doesn't follow the longest conversation; each block has the prefix before it.
    """
    last = F.expr(f"(depth - 1) div {BLOCK}")
    block = F.explode(F.when(F.col("depth") % BLOCK == 0, F.array(last, last + 1)).otherwise(F.array(last)))
    rows = known.select("conv_id", block.alias("block"), F.struct("depth", "prefix").alias("item"))
    rows = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
    end = F.element_at("items", -1)["depth"]
    state = rows.withColumns({"low": F.col("block") * BLOCK + 1, "high": end + 1}).filter("low < high")
    state = work.written(state, "search")
    at = lambda depth: F.get("items", (depth - F.col("items")[0]["depth"]).cast("int"))["prefix"]
    found = []
    while not state.isEmpty():
        middle = F.expr("(low + high) div 2")
        asked = minima.owners(state.withColumn("prefix", at(middle)))
        owned = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        state = work.written(asked.select("conv_id", "block", "items", F.when(owned, F.col("low")).otherwise(middle + 1).alias("low"), F.when(owned, middle).otherwise(F.col("high")).alias("high")), "search")
        found.append(state.filter("low >= high"))
        state = state.filter("low < high")
    if not found:
        return known.select("conv_id", F.col("depth").alias("first"), F.col("prefix").alias("above"))  # of no rows
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    first = F.when(F.col("low") <= end, F.col("low"))
    done = done.select("conv_id", "block", first.alias("first"), F.when(first.isNotNull(), at(first - 1)).alias("before"), F.element_at("items", -1)["prefix"].alias("whole"))
    chosen = done.groupBy("conv_id").agg(F.min("first").alias("first"), F.min_by("before", "first").alias("before"), F.max_by("whole", "block").alias("whole"))
    return chosen.select("conv_id", "first", F.when(F.col("first").isNull(), F.col("whole")).otherwise(F.col("before")).alias("above"))


def summed_chains(work: Work, chains: DataFrame, sums: list[str]) -> DataFrame:
    """``chains`` (conv_id, up, and ``sums``) with every sum taken over all chains below, by pointer doubling."""
    state = work.written(chains, "chains")
    total = state.count()
    while not state.filter("up is not null").isEmpty():
        given = state.filter("up is not null").groupBy("up").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"{c} given") for c in sums])
        given = work.written(given.join(state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up"), "given")
        moved = join_keys(state, given.select("up", "next", "n"), "up", "n", total, "left")
        added = moved.join(given.select(F.col("up").alias("conv_id"), *[f"{c} given" for c in sums]), "conv_id", "left")
        state = work.written(added.select("conv_id", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(column(f"{c} given"), F.lit(0))).alias(c) for c in sums]), "chains")
    return state


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: the digest of the ascending, comma-joined ``member`` ids of each node.

    Ids are dealt by ranges and joined to strings there; a node's digest then streams
    over its strings in order, so that a node where very many conversations end costs
    its task a row for each batch of ids and no memory.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, depth, member = (batch.column(k) for k in range(3))
            o, d = owner.to_numpy(zero_copy_only=False), depth.to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero((o[1:] != o[:-1]) | (d[1:] != d[:-1])) + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(o)), pa.int32()), member.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([owner.take(pa.array(starts)), depth.take(pa.array(starts)), member.take(pa.array(starts)), pc.binary_join(lists, ",")], ["conv_id", "depth", "least", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (conv, depth) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["conv_id", "depth", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    keys = ["conv_id", "depth", "member"]
    strings = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(joined, "conv_id long, depth long, least long, ids string")
    return strings.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "least").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def trie(work: Work, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes (NODES) of conversations: ``turns`` with conv_id, place, digest and n_bytes, ``convs`` with conv_id and length, turnless ones too."""
    spark = turns.sparkSession
    convs = work.written(convs, "conversations")
    top = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], NODES)
    root, n_convs = top["root"], top["n"]
    known = prefixes(work, turns, convs)
    nodes = work.written(known.groupBy("prefix", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes")), "nodes")
    minima = Minima(work, nodes, n_convs)
    searched = work.written(first_owned(work, known, minima), "first")
    upper = minima.owners(searched.filter("above is not null").withColumnRenamed("above", "prefix")).select("conv_id", "first", "owner")
    upper = upper.unionByName(searched.filter("above is null").select("conv_id", "first", F.lit(root).cast("long").alias("owner")))
    is_root = F.col("conv_id") == root
    chains = convs.join(upper, "conv_id", "left").select(
        "conv_id", "length", F.when(is_root, F.lit(0)).otherwise(F.coalesce("first", F.col("length") + 1)).cast("long").alias("first"),
        F.when(~is_root, F.coalesce("owner", F.lit(root))).cast("long").alias("up"),
    )
    chains = work.written(chains, "owned")
    owning = chains.filter(F.col("first") <= F.col("length"))

    # nodes with their parents: the owner's own chain, or where it hangs
    rootnode = spark.createDataFrame([(root, 0, n_convs, 0)], "conv_id long, depth long, n_convs long, n_bytes long")
    tree = nodes.drop("prefix").unionByName(rootnode).join(owning.select("conv_id", F.col("first").alias("depth"), "up"), ["conv_id", "depth"], "left")
    tree = tree.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("up", "conv_id"))).drop("up")
    tree = work.written(tree, "tree")
    children = tree.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = tree.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = tree.withColumns({"saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes"), "n_leaves": (F.col("n_children") == 0).cast("long")})
    tree = work.written(tree, "tree")

    # sums over chains first, then up each chain
    sums = ["saved_tokens", "n_leaves"]
    below = summed_chains(work, tree.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in sums]).join(owning.select("conv_id", "up"), "conv_id"), sums)
    hung = owning.filter("up is not null").drop("length").join(below.drop("up"), "conv_id").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(*[F.sum(c).alias(f"{c} hung") for c in sums])
    tree = tree.join(hung, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *[(F.col(c) + F.coalesce(column(f"{c} hung"), F.lit(0))).alias(c) for c in sums])
    tree = run_up(work.written(tree, "tree"), owning.filter(F.col("length") >= STRETCH), "conv_id", "depth", sums, down=True)

    owner = F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("up"))
    ends = end_digests(chains.select(owner.alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member")))
    out = tree.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select(*[part.split()[0] for part in NODES.split(", ")])


def prefix_trie(conversations: DataFrame, group: int | None = None) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text), one row a node (NODES).

    With ``group``, conversations are first rebuilt as branches of their group's
    leader (``branched``). Ids are whole numbers; rows without one are left out, null
    turns come first, null roles and texts are empty (``ordered``); a conversation
    left without turns ends at the root; equal conversations end at one node; other
    columns may have any name and are ignored; an empty table has no node, not even
    a root. Works through tables in the shared folder; the result is one of them.
    """
    spark = conversations.sparkSession
    with Work(spark, "trie") as work:
        turns = ordered(work, conversations)
        if group is None:
            convs = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
        else:
            turns, convs = branched(work, turns, group)
        path = fresh_dir(spark, "prefix-trie")
        trie(work, turns, convs).write.parquet(path)
    return spark.read.schema(T._parse_datatype_string(NODES)).parquet(path)


SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
           FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS leader FROM o GROUP BY conv_id),
h AS (SELECT conv_id, n, leader, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
                                     lambda v, x: xor(v >> 8, t[(xor(v, x) & 255) + 1])), 4294967295) % 9 AS h FROM c, crc),
m AS (SELECT h.*, least(h, coalesce(l.n, 0)) AS taken FROM h LEFT JOIN (SELECT conv_id AS leader, n FROM c) l USING (leader)),
r AS (SELECT m.conv_id, o.place AS pos, o.role, o.text FROM m JOIN o ON o.conv_id = m.leader AND o.place <= m.h
      UNION ALL SELECT m.conv_id, m.taken + o.place - m.h, o.role, o.text FROM m JOIN o ON o.conv_id = m.conv_id AND o.place > m.h),
p AS (SELECT conv_id, pos AS depth, strlen(text) AS n_bytes,
             sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ORDER BY pos)
                    OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS prefix FROM r
      UNION ALL SELECT conv_id, 0, 0, 'root' FROM m),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes FROM p GROUP BY prefix, depth),
e AS (SELECT prefix, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
      FROM (SELECT conv_id, depth, prefix FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY prefix, depth),
up AS (SELECT n.prefix, n.depth, a.conv_id AS parent, a.prefix AS parent_prefix
       FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN n a ON a.prefix = p.prefix AND a.depth = p.depth),
k AS (SELECT parent_prefix AS prefix, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
w AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * n_bytes AS saved FROM n LEFT JOIN k USING (prefix, depth)),
s AS (SELECT a.prefix, a.depth, sum(w.saved) AS saved, sum((w.n_children = 0)::INT) AS leaves
      FROM w JOIN p a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.prefix, a.depth)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.parent AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN s USING (prefix, depth) LEFT JOIN up USING (prefix, depth) LEFT JOIN e USING (prefix, depth)
"""
