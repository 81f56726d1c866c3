"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles. For sampling, each is labelled with
how often it occurred before, so that repeats count. A sketch draws, for each of
``bands`` random orders, the ``width`` smallest labelled shingles and keeps the
shingles themselves as they stand in the text, so texts meet that share shingles
in the same order. Texts of few shingles have as many bands of SHORT_WIDTH besides,
because draws of four from so few seldom agree. Texts that meet are aligned; two
are near-duplicates when the shingles that the alignment pairs are at least
``similarity`` of all that either has: paired / (n1 + n2 - paired).

Equal texts are one from the start and have a number of their own, whatever their
ids. Buckets of the same texts are one bucket. Within a bucket, first all are
compared with two pivots; then, after components were formed, only texts of a
bucket that are still in different components, which loses no link: in small
buckets pair by pair, in larger ones block by block, where pairs are ruled out by
matrices of shared shingles and never become rows.

Texts are moved only where they are compared: a pivot once for a stretch of the
texts that meet it, each other text once for each pivot. Hot buckets, pivots and
texts are split or broadcast (``base.join_keys``). Work tables go at the end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm.base import SHARE, Work, column, join_keys, set_apart, slices, small, text_of, written
from strikeloom.llm.grams import mixed, runs, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, WIDTH = 18, 4
SHORT, SHORT_WIDTH = 32, 2


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's hash mixed with the number of equal ones before it."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return shingles
    at = np.arange(len(ranked))
    count = np.empty(len(ranked), np.uint64)
    count[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(count > 0, mixed(shingles + count * np.uint64(0x9E3779B97F4A7C15)), shingles)


def smallest(own: np.ndarray, seed: np.uint64, width: int, step: int = 1 << 16) -> np.ndarray:
    """Places of the ``width`` smallest of ``own`` in the order of ``seed``, as they stand; works in blocks of ``step``."""
    places, drawn = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for begin in range(0, len(own), step):
        places = np.concatenate([places, np.arange(begin, min(begin + step, len(own)))])
        drawn = np.concatenate([drawn, mixed(own[begin : begin + step] ^ seed)])
        if len(drawn) > width:
            least = np.argpartition(drawn, width - 1)[:width]
            places, drawn = places[least], drawn[least]
    return np.sort(places)


def sketch(shingles: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """One hash for each seed: the shingles at the ``width`` smallest labelled ones, in text order."""
    own = labelled(shingles)
    if len(own) <= width:
        places = np.broadcast_to(np.arange(len(own)), (len(seeds), len(own)))
    elif len(own) * len(seeds) > 1 << 20:
        places = np.array([smallest(own, seed, width) for seed in seeds])
    else:
        drawn = mixed(own[None, :] ^ seeds[:, None])
        places = np.sort(np.argpartition(drawn, width - 1, axis=1)[:, :width], axis=1)
    value = seeds.copy()
    for k in range(places.shape[1]):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + shingles[places[:, k]])
    return value


def paired(a: np.ndarray | list[int], b: np.ndarray | list[int], least: int) -> int:
    """Length of the longest common subsequence of ``a`` and ``b`` within the band that ``least`` pairs leave; 0 if under ``least``.

    An alignment with ``least`` pairs leaves at most len(a) - least of a and
    len(b) - least of b unpaired, so no pair lies further off the diagonal. Where
    shingles seldom repeat, the few matches in the band are chained one by one
    (``chained``); else rows are bit vectors as wide as the band (``banded``).
    """
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    kinds, n = np.unique(a, return_counts=True)
    others, m = np.unique(b, return_counts=True)
    both, x, y = np.intersect1d(kinds, others, assume_unique=True, return_indices=True)
    if np.minimum(n[x], m[y]).sum() < least:
        return 0
    size = min(len(a), len(b))
    apart = np.flatnonzero(a[:size] != b[:size])
    lead = int(apart[0]) if len(apart) else size
    apart = np.flatnonzero(a[::-1][: size - lead] != b[::-1][: size - lead])
    tail = int(apart[0]) if len(apart) else size - lead
    up, down = len(a) - least, len(b) - least  # how far a pair may lie above and below the diagonal
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    matches = int((n[x].astype(np.float64) * m[y]).sum())
    rest = least - lead - tail
    found = lead + tail + (chained if matches <= 4 * (len(a) + len(b)) + 4096 else banded)(a, b, up, down, rest)
    return found if found >= least else 0


def chained(a: np.ndarray, b: np.ndarray, up: int, down: int, least: int) -> int:
    """The longest chain of matches in the band, from the least ends of chains of each length; 0 once ``least`` is out of reach."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    ends: list[int] = []
    for j, x in enumerate(b.tolist()):
        if len(ends) + len(b) - j < least:
            return 0
        for i in reversed(places.get(x, ())):
            if j - down <= i <= j + up:
                if not ends or i > ends[-1]:
                    ends.append(i)
                else:
                    ends[bisect_left(ends, i)] = i
    return len(ends)


def banded(a: np.ndarray, b: np.ndarray, up: int, down: int, least: int) -> int:
    """The same by bit vectors: only the band's bits are held, those below it are counted as they leave; 0 once ``least`` is out of reach."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    masks: dict[int, tuple[int, int]] = {}  # bits of a shingle's places, from a place on
    found, low, high = 0, 0, 0
    row = 0
    for j, x in enumerate(b.tolist()):
        if found + len(b) - j + min(len(a) - low, up + down + 1) < least:
            return 0
        first, last = max(0, j - down), min(len(a), j + up + 1)
        if first >= len(a):
            break
        if first > low:
            gone = row & (1 << first - low) - 1
            found += first - low - gone.bit_count()
            row >>= first - low
            low = first
        if last > high:
            row |= (1 << last - high) - 1 << high - low
            high = last
        if x in places:
            base, bits = masks.get(x, (0, -1))
            if bits < 0:
                base, bits = places[x][0], 0
                whole = bytearray((places[x][-1] - base) // 8 + 1)
                for i in places[x]:
                    whole[i - base >> 3] |= 1 << (i - base & 7)
                bits = int.from_bytes(whole, "little")
                masks[x] = base, bits
            match = (bits >> low - base if low >= base else bits << base - low) & (1 << high - low) - 1
            if match:
                hit = row & match
                row = (row + hit | row - hit) & (1 << high - low) - 1
    return found + high - low - row.bit_count()


def least_paired(n1: int, n2: int, similarity: float) -> int:
    """Fewest pairs with which texts of n1 and n2 shingles are near-duplicates."""
    k = int(similarity * (n1 + n2) / (1 + similarity))
    while k < similarity * (n1 + n2 - k) - 1e-9:
        k += 1
    return k


def near(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """True if two shingle sequences are near-duplicates."""
    least = least_paired(len(a), len(b), similarity)
    if not len(a) or not len(b) or least > min(len(a), len(b)):
        return False
    return paired(a, b, least) > 0


def same_words(text: F.Column) -> F.Column:
    """Digest of a lower-cased text's words."""
    return F.md5(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).cast("binary"))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, width: int, seed: int) -> DataFrame:
    """id_, digest_ (of the words), place_ (hash of the lower-cased text), n_ (shingles), keys_ of each row; map only."""
    seeds = mixed(np.arange(1, 2 * bands + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))
    schema = T.StructType([T.StructField("id_", T.LongType()), T.StructField("digest_", T.StringType()), T.StructField("place_", T.LongType()), T.StructField("n_", T.LongType()), T.StructField("keys_", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                found, at = words(part.column(1))
                shingles, begins = runs(found, at, shingle)
                n = np.diff(begins)
                keys = []
                for i in range(part.num_rows):
                    own = shingles[begins[i] : begins[i + 1]]
                    if n[i]:
                        keys.append(sketch(own, seeds[:bands], width))
                    if 0 < n[i] <= SHORT:
                        keys.append(sketch(own, seeds[bands:], SHORT_WIDTH))
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0) + np.where((n > 0) & (n <= SHORT), bands, 0))])
                flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(n.astype(np.int64)), lists], names=schema.names)

    text = F.lower(text_of(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), text.alias("text_"), same_words(text).alias("digest_"), F.xxhash64(text).alias("place_"))
    return rows.mapInArrow(run, schema)


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``pairs`` (a, b) whose texts in ``texts`` (rep_, text_) are near-duplicates.

    Texts are laid beside the ``b`` they are compared with; a ``b`` of many pairs is
    dealt into stretches, and only the text of the ``b`` at hand is held.
    """
    counts = pairs.groupBy("b").agg(F.count("*").alias("count_"))
    limit = max(512, pairs.count() // SHARE)
    hot = F.broadcast(counts.filter(F.col("count_") > limit))  # fewer than SHARE
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("count_") / limit)), F.lit(0)).alias("deal_"))
    pivots = dealt.select("b", "deal_").distinct().join(texts.withColumnRenamed("rep_", "b"), "b").select("b", "deal_", F.lit(None).cast("long").alias("a"), "text_")
    others = dealt.join(texts.withColumnRenamed("rep_", "a"), "a").select("b", "deal_", "a", "text_")
    rows = pivots.unionByName(others).repartition("b", "deal_").sortWithinPartitions("b", "deal_", F.col("a").asc_nulls_first()).select("b", "deal_", "a", "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, 500):
                found, at = words(part.column(3))
                sh, begins = runs(found, at, shingle)
                b, a = part.column(0).to_pylist(), part.column(2).to_pylist()
                good = []
                for i in range(part.num_rows):
                    own = sh[begins[i] : begins[i + 1]]
                    if a[i] is None:
                        pivot = own.copy()
                    elif near(own, pivot, similarity):
                        good.append(i)
                if good:
                    yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=PAIR.names)

    return rows.mapInArrow(run, PAIR)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many labelled shingles each left text shares with each right one, by products of 0-1 matrices ``step`` columns wide."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    total = np.zeros((len(left), len(right)), np.float32)
    places = []
    for texts in (left, right):
        size = [len(x) for x in texts]
        row, every = np.repeat(np.arange(len(texts)), size), np.concatenate(texts)
        at = np.searchsorted(both, every)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == every[hit]
        order = np.argsort(at[hit], kind="stable")
        places.append((row[hit][order], at[hit][order], len(texts)))
    for begin in range(0, len(both), step):
        width = min(step, len(both) - begin)
        sides = []
        for row, at, n in places:
            lo, hi = np.searchsorted(at, [begin, begin + width])
            side = np.zeros((n, width), np.float32)
            side[row[lo:hi], at[lo:hi] - begin] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def linked(ids: list[int], roots: list[int], blocks: list[int], texts: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between texts of two blocks (or within one, if all are of one) that join different components.

    Only pairs whose shared shingles allow it are aligned, and no pair whose
    components a link found here has joined already.
    """
    first = blocks[0]
    x = [k for k, b in enumerate(blocks) if b == first]
    y = [k for k, b in enumerate(blocks) if b != first] or x
    same = y is x
    marked = [labelled(t) for t in texts]
    shared = shared_counts([marked[k] for k in x], [marked[k] for k in y])
    size = np.array([len(t) for t in texts])
    nx, ny, rx, ry = size[x][:, None], size[y][None, :], np.array(roots)[x][:, None], np.array(roots)[y][None, :]
    good = (shared * (1 + similarity) >= similarity * (nx + ny) - 1e-6) & (rx != ry)
    if same:
        good &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
    joined: dict[int, int] = {}

    def root(r: int) -> int:
        while r in joined:
            r = joined[r]
        return r

    out = []
    for i, j in zip(*np.nonzero(good), strict=True):
        a, b = root(roots[x[i]]), root(roots[y[j]])
        if a != b and near(texts[x[i]], texts[y[j]], similarity):
            joined[max(a, b)] = min(a, b)
            out.append((ids[x[i]], ids[y[j]]))
    return out


def block_links(members: DataFrame, texts: DataFrame, similarity: float, shingle: int, block: int) -> DataFrame:
    """Links (a, b) between different components within each bucket of ``members`` (key_, rep_, root_, size_).

    A bucket is dealt into blocks of about ``block`` texts and every two blocks meet
    in one group of bounded size, whatever the bucket's: pairs never become rows.
    """
    count = F.ceil(F.col("size_") / block)
    own = F.pmod(F.xxhash64("rep_"), count)
    rows = members.withColumn("own_", own).withColumn("other_", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    rows = rows.select("key_", F.least("own_", "other_").alias("i_"), F.greatest("own_", "other_").alias("j_"), "own_", "rep_", "root_")
    rows = rows.join(texts, "rep_").select("key_", "i_", "j_", "own_", "rep_", "root_", "text_")
    dealt = rows.repartition("key_", "i_", "j_").sortWithinPartitions("key_", "i_", "j_", "own_", "rep_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])

        def ended() -> pa.RecordBatch:
            found = linked(*held, similarity) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=PAIR.names)

        for batch in batches:
            for part in slices(batch, 500):
                found, at = words(part.column(6))
                sh, begins = runs(found, at, shingle)
                columns = [part.column(c).to_pylist() for c in range(6)]
                for k in range(part.num_rows):
                    key = columns[0][k], columns[1][k], columns[2][k]
                    if key != now:
                        if now is not None:
                            yield ended()
                        now, held = key, ([], [], [], [])
                    for values, value in zip(held, (columns[4][k], columns[5][k], columns[3][k], sh[begins[k] : begins[k + 1]].copy()), strict=True):
                        values.append(value)
        if now is not None:
            yield ended()

    return dealt.mapInArrow(run, PAIR).distinct()


def settled(edges: DataFrame) -> bool:
    """True if every ``a`` (the larger end) has one edge and no ``b`` is an ``a``: then each ``b`` is the root of its component."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not each.agg(F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open")).first()["open"]


def components(edges: DataFrame, work: Work) -> DataFrame:
    """rep_ and root_ (the smallest number of its component) of every number in ``edges`` (a, b).

    Alternates two steps until only stars are left: each number's larger neighbours go
    to its smallest neighbour, then its smaller ones do. Every round is written, so
    that no plan grows and a lost executor costs one round at most; the neighbours
    of a number that has many are not gathered in one task.
    """
    now = work.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not settled(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("count_")), "least")
        total = 2 * now.count()
        large = join_keys(both, least, "a", "count_", total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # smaller neighbours, and the number itself, go to the smallest
        large = work.written(large.filter("a <> b").distinct(), "large")
        small_least = work.written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("count_")), "least")
        moved = join_keys(large, small_least, "a", "count_", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = work.written(moved.unionByName(small_least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    roots = now.select(F.col("b").alias("rep_")).distinct()
    return now.select(F.col("a").alias("rep_"), F.col("b").alias("root_")).unionByName(roots.select("rep_", F.col("rep_").alias("root_")))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, width: int = WIDTH, seed: int = 1, pairs_up_to: int = 32, block: int = 256) -> DataFrame:
    """id_, digest_, class_ (a number; null for a row that is alone), least_ (smallest id in the class), size_ of each row, written.

    See ``near_duplicates``; here rows are told apart by their words, so that two
    texts of one id may be in different classes.
    """
    with Work(docs.sparkSession, "near-duplicates") as work:
        marks = work.written(sketches(docs, id_col, text_col, shingle, bands, width, seed), "sketches")
        n_rows = marks.count()
        kinds = marks.filter("n_ > 0").groupBy("digest_").agg(F.min("id_").alias("least_"), F.count("*").alias("copies_"), F.min("place_").alias("place_"), F.first("n_").alias("n_"), F.first("keys_").alias("keys_"))
        same = work.written(kinds.withColumn("rep_", F.monotonically_increasing_id()), "distinct-texts")
        # each band has a seed of its own, so keys of different bands don't meet
        buckets = same.select("rep_", "n_", F.explode("keys_").alias("key_"))
        met = buckets.groupBy("key_").agg(F.min("rep_").alias("low_"), F.max("rep_").alias("high_"), F.count("*").alias("count_"), F.bit_xor(F.xxhash64("rep_")).alias("x_"), F.bit_xor(F.xxhash64("rep_", F.lit(1))).alias("y_"))
        # buckets of the same texts: one is enough
        met = met.filter("low_ < high_").groupBy("low_", "high_", "count_", "x_", "y_").agg(F.min("key_").alias("key_")).drop("x_", "y_")
        counts = same.select("rep_", "n_")
        met = met.join(counts.toDF("low_", "low_n_"), "low_").join(counts.toDF("high_", "high_n_"), "high_")
        met = work.written(met, "buckets")
        n_met = met.agg(F.sum("count_").alias("n")).first()["n"] or 0
        members = work.written(join_keys(buckets, met, "key_", "count_", n_met), "members")
        pivots = F.explode(F.array(F.struct(F.col("low_").alias("b"), F.col("low_n_").alias("nb")), F.struct(F.col("high_").alias("b"), F.col("high_n_").alias("nb"))))
        stars = members.select(F.col("rep_").alias("a"), F.col("n_").alias("na"), "low_", "high_", pivots.alias("p_")).select("a", "na", "low_", "high_", "p_.*").filter("a <> b and not (a = low_ and b = high_)")
        pairs = work.written(fitting(stars, similarity), "pairs")
        wanted = same.join(members.select("rep_").distinct(), "rep_", "left_semi").select("rep_", "place_", F.col("digest_").alias("wanted_"), "copies_")
        wanted = work.written(wanted, "wanted")
        lower = F.lower(text_of(text_col))
        source = docs.select(lower.alias("text_"), F.xxhash64(lower).alias("place_"))
        if wanted.count() <= MOST_WANTED:
            found = source.join(F.broadcast(wanted.drop("copies_")), "place_")
        else:
            found = join_keys(source, wanted, "place_", "copies_", n_rows)
        texts = work.written(found.filter(same_words(F.col("text_")) == F.col("wanted_")).groupBy("rep_").agg(F.first("text_").alias("text_")), "texts")
        links = work.written(verified(pairs, texts, similarity, shingle), "links")
        roots = work.written(components(links, work), "roots")
        placed = work.written(members.select("key_", "rep_", "n_").join(roots, "rep_", "left").withColumn("root_", F.coalesce("root_", "rep_")), "placed")
        open_ = placed.groupBy("key_").agg(F.min("root_").alias("r1"), F.max("root_").alias("r2"), F.count("*").alias("count_")).filter("r1 < r2").select("key_", "count_", F.col("count_").alias("size_"))
        open_ = work.written(open_, "open")
        final = roots
        if not open_.isEmpty():
            rest = work.written(join_keys(placed, open_, "key_", "count_", n_met), "open-members")
            few = rest.filter(F.col("size_") <= pairs_up_to)
            left = few.select("key_", F.col("rep_").alias("a"), F.col("n_").alias("na"), F.col("root_").alias("ra"))
            right = few.select("key_", F.col("rep_").alias("b"), F.col("n_").alias("nb"), F.col("root_").alias("rb"))
            late = fitting(left.join(right, "key_").filter("a < b and ra <> rb"), similarity)
            tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            more = work.written(verified(work.written(late.join(tried, ["a", "b"], "left_anti"), "late-pairs"), texts, similarity, shingle), "late-links")
            many = block_links(rest.filter(F.col("size_") > pairs_up_to), texts, similarity, shingle, block)
            more = more.unionByName(work.written(many, "block-links"))
            if not more.isEmpty():
                final = work.written(components(links.unionByName(more), work), "roots")
        of_text = same.select("rep_", "digest_", F.col("least_").alias("own_"), "copies_").join(final, "rep_", "left").filter("root_ is not null or copies_ > 1")
        of_text = work.written(of_text.select("digest_", "own_", "copies_", F.coalesce("root_", "rep_").alias("class_")), "grouped")
        classes = work.written(of_text.groupBy("class_").agg(F.min("own_").alias("least_"), F.sum("copies_").alias("size_"), F.count("*").alias("count_")), "classes")
        of_text = work.written(join_keys(of_text, classes, "class_", "count_", n_rows).drop("own_"), "grouped")
        out = join_keys(marks.select("id_", "digest_"), of_text, "digest_", "copies_", n_rows, "left")
        out = out.select("id_", "digest_", "class_", F.when(F.col("class_").isNull(), F.col("id_")).otherwise(F.col("least_")).alias("least_"), F.coalesce("size_", F.lit(1)).cast("long").alias("size_"))
        return written(out, "near-duplicates")


#: Texts that are compared with others whose place and digest may be broadcast; beyond that the join shuffles.
MOST_WANTED = 500_000


def fitting(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) once each, of shingle counts (na, nb) that may be near."""
    return pairs.filter(F.least("na", "nb") + 1e-9 >= F.greatest("na", "nb") * similarity).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """id, ``class_id`` (smallest id of its class) and ``class_size`` (rows) of each row; ``how`` as in ``text_classes``.

    Texts are compared by their words in lower case, whole, however long. Null and
    empty texts, and texts of blanks alone, are in no class but their own; texts of
    fewer than five words are one shingle. Repeated rows are in one class. Rows that
    share an id but not their words are compared each for itself, so an id may come
    back with two classes. A null id is ignored when the smallest is taken: its row
    has its class's, null where no row of the class has one. Other columns, whatever
    their names, are left out; an empty table gives an empty table.

    Buckets of up to ``pairs_up_to`` texts are compared pair by pair, larger ones in
    blocks of ``block``; both compare all that may be near.

    Two texts that share 0.8 of their shingles, in the same order, meet in a band
    with a probability of 0.9997 or more, at any length.
    """
    kind = docs.schema[id_col].dataType
    out = text_classes(docs, id_col, text_col, **how)
    return out.select(F.col("id_").cast(kind).alias(id_col), F.col("least_").cast(kind).alias("class_id"), F.col("size_").alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """``docs`` without near-duplicates: one row of each class stays, that of the smallest id.

    Of rows of that id, one of the smallest digest of its words stays, and of equal
    ones that with the smallest hash of all its columns. Null ids come after all
    others. Texts without words all stay. All columns of ``docs`` come back, whatever
    their names; an empty table gives an empty table.

    Rows whose id occurs once are kept or dropped by id; only ids that occur again
    are looked up by the digest of their words. Ids are broadcast when they are
    counted and few, else the join shuffles.
    """
    docs, back = set_apart(docs, id_col, text_col)
    rows = text_classes(docs, id_col, text_col, **how)
    with Work(docs.sparkSession, "keep-one") as work:
        found = rows.filter("class_ is not null")
        first = F.min(F.struct(F.col("id_").isNull().alias("none_"), "id_", "digest_")).alias("k_")
        keepers = found.groupBy("class_").agg(first).select(F.col("k_.id_").alias("keep_"), F.col("k_.digest_").alias("words_"))
        ids = found.filter("id_ is not null").select("id_").distinct()
        again = rows.join(ids, "id_", "left_semi").groupBy("id_").agg(F.count("*").alias("n_")).filter("n_ > 1").select("id_")
        again = written(again, "repeated-ids")
        kinds = found.select("id_", "digest_").distinct().join(keepers, F.col("id_").eqNullSafe(F.col("keep_")) & (F.col("digest_") == F.col("words_")), "left")
        kinds = work.written(kinds.select("id_", "digest_", F.col("words_").isNotNull().alias("keeper_")), "kinds")
        once = kinds.filter("id_ is not null and not keeper_").join(again, "id_", "left_anti").select("id_")
        drop = written(once.unionByName(again), "dropped-ids")
        odd = kinds.join(again, "id_", "left_semi").unionByName(kinds.filter("id_ is null"))
        odd = written(odd.toDF("odd id", "odd digest", "keeper"), "repeated-kinds")
    named = [column(c) for c in docs.columns]
    own = docs.withColumns({"id of row": F.col(id_col).cast("long"), "digest of row": same_words(F.lower(text_of(text_col)))})
    kept = docs.filter(F.col(id_col).isNotNull()).join(small(drop.toDF("dropped id")), F.col(id_col).cast("long") == F.col("dropped id"), "left_anti")
    contested = own.filter(F.col(id_col).isNull()).unionByName(own.join(small(again.toDF("odd id")), F.col("id of row") == F.col("odd id"), "left_semi"))
    contested = contested.join(odd, F.col("id of row").eqNullSafe(F.col("odd id")) & (F.col("digest of row") == F.col("odd digest")), "left")
    free = contested.filter("keeper is null").select(*named)  # in no class
    chosen = contested.filter("keeper").select("id of row", "digest of row", F.struct(*named).alias("row of docs"))
    chosen = chosen.groupBy("id of row", "digest of row").agg(F.min_by("row of docs", F.xxhash64(F.to_json("row of docs"))).alias("row of docs")).select("row of docs.*")
    return kept.select(*named).unionByName(free).unionByName(chosen).select(*back)
