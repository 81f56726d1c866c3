"""A quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or nothing (-1) on every document.
Expectation-maximisation over the counts of vote patterns, of all documents,
estimates how often each labeller is right; the posterior of a document's pattern
is its label. A linear scorer over hashed features is trained with these labels in
blocks of documents, the mean of all blocks' weights scores all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm.base import arrow_map, text_of, written

GOOD, BAD, NONE = 1, 0, -1
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset("the of and to in is that it for was on are as with be by this he at from der die und das von zu den mit ist im des ein eine nicht für auf sich le la les et des un une du en que qui est dans pour par sur au avec el los las y del se por con una su para es al".split())
#: Thresholds that are tried; weights are summed in steps of 1 / FIXED; features that a block has at most, about.
STEPS, FIXED, BLOCK_FEATURES = [k / 100 for k in range(1, 100)], float(1 << 40), 8_000_000
_SCORES = [T.StructField("quality_score", T.DoubleType()), T.StructField("weak_label", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())]
_SHAPE = bytes(b"A"[0] if 65 <= b <= 90 else b"a"[0] if 97 <= b <= 122 or b >= 128 else b"0"[0] if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+")


@dataclass
class Signs:
    """What labellers and features see of a text."""

    n: int
    words: list[bytes]
    symbols: float  # for each word
    pipes: float
    shouts: float
    upper: float  # of all letters a to z
    distinct: float  # of words
    windows: float  # distinct three-word windows of all
    same: float  # words equal to the one before
    function: float
    length: float
    lines: float  # repeated lines of all


def signs(text: str) -> Signs:
    data = text.encode()
    words = data.split()
    n = len(words)
    m = max(1, n)
    letters = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    small = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    symbols = len(data) - len(data.translate(None, b"#*$%&<>@^~=_\\{}"))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    lower = data.lower().split()
    known = Counter(lower)
    function = sum(known[w] for w in _FUNCTION if w in known)
    return Signs(n, words, symbols / m, words.count(b"|") / m, data.count(b"!!") / m, (letters - small) / max(1, letters), len(known) / m, len(set(windows)) / len(windows) if windows else 1.0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, function / m, (len(data) - n) / m, 1 - len(set(lines)) / max(1, len(lines)))


_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)


def bad_from(value: float, limit: float) -> int:
    return BAD if value >= limit else NONE


def plain(s: Signs) -> int:
    """Bad where marks of any kind abound, good where there are none and little repeats."""
    marks = s.symbols + s.pipes + s.shouts
    return BAD if marks >= 0.2 else GOOD if marks < 0.03 and s.upper < 0.15 and s.windows > 0.9 else NONE


#: The labellers; they overlap on purpose. Those that know one kind of bad text say nothing of others.
LABELLERS: dict[str, Callable[[Signs], int]] = {
    "symbols": lambda s: bad_from(s.symbols, 0.25),
    "pipes": lambda s: bad_from(s.pipes, 0.1),
    "shouting": lambda s: bad_from(s.shouts, 0.15),
    "capitals": lambda s: bad_from(s.upper, 0.4),
    "few_windows": lambda s: NONE if s.n < 10 else bad_from(1 - s.windows, 0.3),
    "stutter": lambda s: bad_from(s.same, 0.2),
    "repeated_lines": lambda s: bad_from(s.lines, 0.4),
    "function_words": lambda s: NONE if s.n < 20 else BAD if s.function < 0.08 else GOOD if s.function > 0.15 else NONE,
    "varied": lambda s: GOOD if s.n >= 30 and s.windows > 0.92 and s.same < 0.06 else NONE,
    "plain": plain,
    "length": lambda s: BAD if s.n == 0 else GOOD if s.n >= 30 and 3 <= s.length <= 12 else NONE,
}


def votes(s: Signs) -> str:
    """One character for each labeller: 1, 0 or ``-``."""
    return "".join("01-"[f(s)] for f in LABELLERS.values())


@dataclass
class LabelModel:
    """Good documents' share, and each labeller's chances of each vote, by class."""

    prior: float
    chances: np.ndarray  # class, labeller, vote (bad, good, none)

    def posterior(self, pattern: str) -> float:
        """Probability that a document of this pattern is good."""
        k = ["01-".index(c) for c in pattern]
        log = np.log([1 - self.prior, self.prior]) + np.log(self.chances[:, np.arange(len(k)), k]).sum(axis=1)
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))))

    def accuracy(self) -> dict[str, float]:
        """How often each labeller, where it votes, is right."""
        share = np.array([1 - self.prior, self.prior])
        right = (share[:, None] * self.chances[[0, 1], :, [0, 1]]).sum(axis=0)
        return dict(zip(LABELLERS, (right / (share[:, None] * self.chances[:, :, :2].sum(axis=2)).sum(axis=0)).tolist(), strict=True))


def fit_labels(patterns: dict[str, int], prior: float = 0.85, rounds: int = 200, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over pattern counts, from labellers that are all alike; no pattern leaves the start as it is.

    At the start a labeller calls a bad document bad in half of all cases and a
    good one in few, and good documents good more often than bad ones.
    """
    m = len(LABELLERS)
    chances = np.repeat(np.array([[0.5, 0.15, 0.35], [0.02, 0.6, 0.38]])[:, None, :], m, axis=1)
    if not patterns:
        return LabelModel(prior, chances)
    names = sorted(patterns)
    counts = np.array([patterns[p] for p in names], float)
    seen = np.array([["01-".index(c) for c in p] for p in names])
    one_hot = np.eye(3)[seen]  # pattern, labeller, vote
    for _ in range(rounds):
        log = np.log([1 - prior, prior])[None, :] + np.einsum("plv,clv->pc", one_hot, np.log(chances))
        log -= log.max(axis=1, keepdims=True)
        post = np.exp(log)
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        new = np.einsum("pc,plv->clv", weight, one_hot) + smooth
        new /= new.sum(axis=2, keepdims=True)
        prior = float(np.clip((weight[:, 1].sum() + smooth) / (counts.sum() + 2 * smooth), 0.01, 0.99))
        if np.abs(new - chances).max() < 1e-7:
            break
        chances = new
    return LabelModel(prior, chances)


def featured(s: Signs, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and their values: whole words and their shapes as shares, signs in steps."""
    mask, found = (1 << bits) - 1, Counter()
    m = max(1, s.n)
    shapes: Counter[bytes] = Counter()
    for w, k in Counter(s.words).items():
        shape = w.translate(_SHAPE)
        shapes[_RUN.sub(rb"\1+", shape)] += k
        if not shape.strip(b"Aa"):  # letters of any script
            found[crc32(b"w" + w.lower()) & mask] += k / m
    for w, k in shapes.items():
        found[crc32(b"s" + w) & mask] += 3 * k / m
    for name in ("symbols", "pipes", "shouts", "upper", "distinct", "windows", "same", "function", "lines"):
        found[crc32(f"{name}{min(10, int(getattr(s, name) * 10 + 0.5))}".encode()) & mask] += 0.3
    found[crc32(f"n{min(8, s.n.bit_length())}".encode()) & mask] += 0.3
    return np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int, rounds: int = 8, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Weights (the last is the constant) by stochastic gradient descent on the log loss against soft labels, classes weighted alike."""
    w, square = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-3)
    if not rows:
        return w
    good = sum(y for *_, y in rows) / len(rows)
    weight = 0.5 / np.clip([1 - good, good], 0.02, 1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            error = (1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))) - y) * (y * weight[1] + (1 - y) * weight[0])
            g = error * x + decay * w[at]
            square[at] += g * g
            w[at] -= rate * g / np.sqrt(square[at])
            square[-1] += error * error
            w[-1] -= rate * error / np.sqrt(square[-1])
    return w


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bits: int
    threshold: float = 0.5

    def score(self, s: Signs) -> float:
        return chance(self.weights, *featured(s, self.bits))


def chance(weights: np.ndarray, at: np.ndarray, x: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -30, 30))))


def step_of(score: float) -> int:
    """How many of the thresholds 0.01 to 0.99 a score reaches."""
    return int(np.searchsorted(STEPS, score, side="right"))


def cut(scored: dict[tuple[int, float], int], good_cost: float) -> float:
    """The score from which on to keep, of hundredths: where ``good_cost`` for each good document lost and 1 for each bad one kept are least.

    ``scored`` counts documents by step and posterior; of several such scores it's the middle one.
    """
    costs = [round(sum(n * (good_cost * y if step <= k else 1 - y) for (step, y), n in sorted(scored.items())), 9) for k in range(len(STEPS))]
    least = [t for t, c in zip(STEPS, costs, strict=True) if c == min(costs)]
    return least[len(least) // 2]


_OWN = [T.StructField("pattern", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))]


def _seen(docs: DataFrame, id_col: str, text_col: str, bits: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """pattern, at, x and hash_ (of id and text) of every document, and its columns ``keep`` as ``kept 0`` and so on, written."""
    text = text_of(text_col)
    rows = docs.select(text.alias("text_"), F.xxhash64(F.col(id_col).cast("string"), text).alias("hash_"), *[F.col(c).alias(f"kept {i}") for i, c in enumerate(keep)])
    schema = T.StructType([*_OWN, *rows.schema.fields[1:]])

    def look():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(votes(s), *featured(s, bits)) for s in map(signs, batch.column(0).to_pylist())]
            own = [pa.array([p for p, *_ in found], pa.string()), pa.array([a for _, a, _ in found], pa.list_(pa.int32())), pa.array([x for *_, x in found], pa.list_(pa.float32()))]
            return pa.RecordBatch.from_arrays([*own, *batch.columns[1:]], names=schema.names)

        return step

    return written(arrow_map(rows, look, schema, rows=500), "signs")


def _arrays(at: pa.Array, x: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    ends, numbers, values = np.asarray(at.offsets), at.values.to_numpy(), x.values.to_numpy()
    return [(numbers[a:b], values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _fitted(seen: DataFrame, bits: int, block: int, features: int | None, good_cost: float) -> QualityModel:
    """The model of what ``_seen`` has: labels from all patterns, weights as means over blocks, the threshold from what no block was trained on."""
    sums = {r["pattern"]: r for r in seen.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.size("at")).alias("size")).collect()}
    counts = {p: r["n"] for p, r in sums.items()}
    labels = fit_labels(counts)
    if not counts:
        return QualityModel(labels, train([], bits), bits, cut({}, good_cost))
    posterior = {p: labels.posterior(p) for p in counts}
    blocks = max(-(-sum(counts.values()) // block), -(-sum(r["size"] for r in sums.values()) // BLOCK_FEATURES))
    rows = seen.select("pattern", "at", "x", "hash_")
    if features is not None:
        # only on demand: the first so many features in order of the hash
        sizes = rows.groupBy("hash_").agg(F.first(F.size("at")).alias("n"))
        last = sizes.withColumn("upto_", F.sum("n").over(W.orderBy("hash_"))).filter(F.col("upto_") <= features).agg(F.max("hash_")).first()[0]
        rows, blocks = rows.filter(F.col("hash_") <= F.lit(last)) if last is not None else rows.filter("false"), 1
    share = F.col("hash_").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
    rows = rows.withColumn("block_", F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("int")).repartition("block_")
    rows = rows.groupBy("block_", "hash_").agg(*[F.first(c).alias(c) for c in ("pattern", "at", "x")])

    def learn(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("hash_").combine_chunks()
        pattern, at, x = (table[c].combine_chunks() for c in ("pattern", "at", "x"))
        found = [(*ax, posterior[p]) for ax, p in zip(_arrays(at, x), pattern.to_pylist(), strict=True)]
        weights = train([r for i, r in enumerate(found) if i % 5], bits)
        used, apart = np.flatnonzero(weights), np.arange(0, len(found), 5)
        none = lambda n, kind: pa.nulls(n, kind)
        own = [pa.concat_arrays([pa.array(used, pa.int32()), none(len(apart), pa.int32())]), pa.concat_arrays([pa.array(np.rint(weights[used] * FIXED).astype(np.int64)), none(len(apart), pa.int64())])]
        rest = [pa.concat_arrays([none(len(used), v.type), v.take(pa.array(apart))]) for v in (at, x, pa.array([y for *_, y in found], pa.float64()))]
        return pa.table([*own, *rest], names=["number", "weight", "at", "x", "y"])

    learned = written(rows.groupBy("block_").applyInArrow(learn, "number int, weight long, at array<int>, x array<float>, y double"), "learned")
    # sums of whole numbers: the same in any order
    means = learned.filter("number is not null").groupBy("number").agg(F.sum(F.col("weight").cast("decimal(20,0)")).cast("double").alias("w")).toArrow()
    weights = np.zeros((1 << bits) + 1)
    weights[means["number"].to_numpy()] = means["w"].to_numpy() / FIXED / blocks
    shared = seen.sparkSession.sparkContext.broadcast(weights)

    def place():
        w = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([step_of(chance(w, *ax)) for ax in _arrays(batch.column(0), batch.column(1))], pa.int32()), batch.column(2)], names=["step", "y"])

        return step

    kind = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("y", T.DoubleType())])
    held = arrow_map(learned.filter("number is null").select("at", "x", "y"), place, kind).groupBy("step", "y").agg(F.count("*").alias("n")).collect()
    return QualityModel(labels, weights, bits, cut({(r["step"], r["y"]): r["n"] for r in held}, good_cost))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 10_000, bits: int = 17, features: int | None = None, good_cost: float = 4.0) -> QualityModel:
    """Label model and scorer from all documents, equal ones (id and text) once.

    Documents are dealt by a hash of id and text to blocks of about ``block`` (fewer
    where texts are long). Each block is one task's stochastic descent in order of the
    hash; the weights are the means over all blocks. Every fifth document of each
    block is in no descent: all of these set the threshold, by the mean weights, where
    losing a good document costs ``good_cost`` times keeping a bad one. What reaches the
    driver is pattern counts (at most 3 to the number of labellers), one mean for each
    weight and counts by hundredth and pattern. ``features``, if given, bounds what is
    learned from. Null texts are empty ones, null ids choose like any other; other
    columns aren't read; an empty table gives a model that knows nothing.
    """
    return _fitted(_seen(docs, id_col, text_col, bits), bits, block, features, good_cost)


def fit_classify(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", bits: int = 17, block: int = 10_000, good_cost: float = 4.0) -> DataFrame:
    """``classify(docs, fit(docs))`` with the columns ``keep`` of ``docs``; texts are looked at once, what was seen of them is stored."""
    seen = _seen(docs, id_col, text_col, bits, tuple(keep))
    model = _fitted(seen, bits, block, None, good_cost)
    rows = seen.select("pattern", "at", "x", *[F.col(f"`kept {i}`") for i in range(len(keep))])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in _SCORES], *rows.schema.fields[3:]])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.labels))
    threshold = model.threshold

    def score():
        w, labels = shared.value
        known: dict[str, float] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            patterns = batch.column(0).to_pylist()
            known.update({p: labels.posterior(p) for p in {*patterns} - {*known}})
            scores = [round(chance(w, *ax), 6) for ax in _arrays(batch.column(1), batch.column(2))]
            own = [pa.array(scores, pa.float64()), pa.array([round(known[p], 6) for p in patterns], pa.float64()), pa.array([x >= threshold for x in scores], pa.bool_())]
            return pa.RecordBatch.from_arrays([*own, *batch.columns[3:]], names=schema.names)

        return step

    found = arrow_map(rows, score, schema)
    return found.select(*[F.col(f"`kept {i}`").alias(c) for i, c in enumerate(keep)], *[f.name for f in _SCORES])


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """``docs`` with ``quality_score`` (good, 0 to 1, six places), ``weak_label`` (posterior) and ``quality_kept``, replacing columns of those names.

    Kept is what scores ``threshold`` or more, the model's own unless given. Row by
    row, without a shuffle: null and empty texts are scored as empty ones, equal texts
    alike, whole, however long; repeated rows stay; other columns may have any name;
    an empty table gives an empty table. The model's size is bounded by its bits.
    """
    threshold = model.threshold if threshold is None else threshold
    more = _SCORES
    rest = docs.drop(*[f.name for f in more])
    at = rest.columns.index(text_col)
    schema = T.StructType([*rest.schema.fields, *more])
    weights = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.labels, model.bits))

    def score():
        w, labels, bits = weights.value
        own = QualityModel(labels, w, bits)
        known: dict[str, float] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, weak = [], []
            for t in batch.column(at).to_pylist():
                s = signs(t or "")
                p = votes(s)
                if p not in known:
                    known[p] = labels.posterior(p)
                weak.append(round(known[p], 6))
                scores.append(round(own.score(s), 6))
            kept = [x >= threshold for x in scores]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(weak, pa.float64()), pa.array(kept, pa.bool_())], names=schema.names)

        return step

    return arrow_map(rest, score, schema, rows=500)
