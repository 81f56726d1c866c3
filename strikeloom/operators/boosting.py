"""Boosted trees for a normal's mean and log deviation, by natural gradients, learned where the rows are.

Features are cut into bins once. A stage fits one tree to each part of the natural
gradient: a level of both trees comes from one aggregate of counts and sums by node,
feature and bin, and the step's length from one more. Only those sums reach the
driver: their number depends on bins, features and depth, not on rows. Sums are of
whole numbers (gradients in 2^-30, losses in 2^-24), so that a model doesn't depend
on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strikeloom.operators.quantiles import ordered_values, value_ranges
from strikeloom.sources.scratch import Scratch

#: Features of the pooled model in order (fixed values).
FEATURES = ("horizon", "last_return", "mean_return_5", "mean_return_22", "volatility_5", "volatility_22", "range_variance_5", "range_variance_22", "volume_ratio_log")
#: Stages after which what is known of a row is written again.
CUT = 10
GRADIENT, LOSS = float(1 << 30), float(1 << 24)
#: Powers of two that a stage's step is tried at.
POWERS = range(-12, 10)
#: Under this mean length of the gradient nothing more is learned (fixed value).
SMALLEST = 1e-4
#: What a cohort must have: tickers, sessions of each, rows.
LEAST_TICKERS, MOST_TICKERS, LEAST_SESSIONS, MOST_SESSIONS, LEAST_ROWS = 20, 100, 500, 756, 5_000


def pooled_features(stocks: DataFrame) -> DataFrame:
    """ticker, ts, place (from 0) and FEATURES without the horizon; null where the last 23 bars have a split, a gap in their values, or are too few.

    ``stocks``: ticker, ts, high, low, close, volume, split.
    """
    w = W.partitionBy("ticker").orderBy("ts")
    good = F.coalesce((F.col("close") > 0) & (F.col("low") > 0) & (F.col("volume") > 0) & (F.col("high") > 0) & ~(F.coalesce("split", F.lit(0.0)) > 0), F.lit(False))
    rows = stocks.withColumns({"place": F.row_number().over(w) - 1, "bad": F.when(good, 0).otherwise(1)})
    rows = rows.withColumns({"r": F.when(F.col("bad") + F.lag("bad").over(w) == 0, F.log(F.try_divide("close", F.lag("close").over(w)))), "v": F.when(F.col("bad") == 0, F.log(F.try_divide("high", "low")) ** 2 / (4 * math.log(2)))})
    last = lambda n: w.rowsBetween(1 - n, 0)
    whole = (F.col("place") >= 22) & (F.sum("bad").over(last(23)) == 0)
    values = {
        "last_return": F.col("r"), "mean_return_5": F.avg("r").over(last(5)), "mean_return_22": F.avg("r").over(last(22)), "volatility_5": F.stddev_pop("r").over(last(5)), "volatility_22": F.stddev_pop("r").over(last(22)),
        "range_variance_5": F.avg("v").over(last(5)), "range_variance_22": F.avg("v").over(last(22)), "volume_ratio_log": F.log(F.try_divide("volume", F.avg("volume").over(last(22)))),
    }
    return rows.select("ticker", "ts", "place", *[F.when(whole, value).alias(name) for name, value in values.items()])


def cohort_reason(stocks: DataFrame, rows: DataFrame, least_tickers: int = LEAST_TICKERS, most_tickers: int = MOST_TICKERS, least_sessions: int = LEAST_SESSIONS, most_sessions: int = MOST_SESSIONS, least_rows: int = LEAST_ROWS) -> str | None:
    """Why a cohort can't be trained on, or None: sizes, one last session, enough rows."""
    each = stocks.groupBy("ticker").agg(F.count("*").alias("n"), F.max("ts").alias("through"), F.count_distinct("ts").alias("days"))
    x = each.agg(F.count("*").alias("tickers"), F.count_distinct("through").alias("ends"), F.min("n").alias("least"), F.max("n").alias("most"), F.bool_or(F.col("n") != F.col("days")).alias("twice")).first()
    if not least_tickers <= x["tickers"] <= most_tickers:
        return "pooled_training_cohort_size_invalid"
    if x["twice"]:
        return "pooled_training_cohort_duplicate"
    if x["ends"] != 1:
        return "pooled_training_vintage_mismatch"
    if not (least_sessions <= x["least"] and x["most"] <= most_sessions):
        return "pooled_training_history_invalid"
    return "pooled_training_support_insufficient" if rows.count() < least_rows else None


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature the values up to which 1/bins, 2/bins, ... of all rows lie, each once, without the greatest."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for k, c in enumerate(features)])).alias("e")).select("e.feature", "e.x")
    ranges = value_ranges(each, ["feature"], "x")
    ranks = {f"q{i}": F.greatest(F.ceil(F.col("count_") * i / bins), F.lit(1)) for i in range(1, bins)}
    found = {r["feature"]: r for r in ordered_values(each, ranges, ["feature"], "x", ranks).collect()}
    most = {r["feature"]: r["most_"] for r in ranges.collect()}
    return [sorted({found[k][f"q{i}"] for i in range(1, bins)} - {most[k]}) if k in found else [] for k in range(len(features))]


def leaves(tree: dict[str, list], codes: np.ndarray) -> np.ndarray:
    """The node that each row (a column of ``codes``) comes to."""
    feature, code, left, right = (np.array(tree[k]) for k in ("feature", "code", "left", "right"))
    node = np.zeros(codes.shape[1], np.int64)
    at = np.arange(codes.shape[1])
    for _ in range(len(feature)):
        inner = feature[node] >= 0
        if not inner.any():
            break
        goes = np.where(codes[feature[node], at] <= code[node], left[node], right[node])
        node = np.where(inner, goes, node)
    return node


def walked(tree: dict[str, list], codes: np.ndarray) -> np.ndarray:
    return np.array(tree["value"], float)[leaves(tree, codes)]


def gradient(y: np.ndarray, mean: np.ndarray, log_dev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural gradient of the negative log likelihood: by the mean, and by the logarithm of the deviation."""
    off = mean - y
    return off, (1 - off * off * np.exp(-2 * log_dev)) / 2


def loss(y: np.ndarray, mean: np.ndarray, log_dev: np.ndarray) -> np.ndarray:
    """Negative log likelihood; very bad where it isn't a number."""
    value = 0.5 * math.log(2 * math.pi) + log_dev + (y - mean) ** 2 * np.exp(-2 * log_dev) / 2
    return np.where(np.isfinite(value), np.minimum(value, 1e9), 1e9)


def advanced(batches: Iterator[pa.RecordBatch], pending: list[dict], n_features: int, rate: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Codes, target, mean and log deviation of each batch, the latter two after the ``pending`` stages."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            codes, (y, mean, log_dev) = np.stack(columns[:n_features]), columns[n_features:]
            for stage in pending:
                step = rate * stage["scale"]
                mean, log_dev = mean - step * walked(stage["trees"][0], codes), log_dev - step * walked(stage["trees"][1], codes)
            yield codes, y, mean, log_dev


class Learner:
    """Rows with bin codes, target and what is predicted of them so far, and the aggregates over them."""

    def __init__(self, scratch: Scratch, rows: DataFrame, n_features: int, rate: float):
        self.scratch, self.rows, self.n_features, self.rate = scratch, rows, n_features, rate
        self.pending: list[dict] = []

    def _aggregate(self, make, finish) -> dict[int, tuple[int, int]]:  # noqa: ANN001
        """Sums by key of what ``make`` adds to a task's state and ``finish`` gives as (keys, n, total)."""
        pending, n_features, rate = list(self.pending), self.n_features, self.rate

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for part in advanced(batches, pending, n_features, rate):
                state = make(state, *part)
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in finish(state)], ["key", "n", "total"])

        sums = self.rows.mapInArrow(run, "key long, n long, total long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return {r["key"]: (r["n"], r["total"]) for r in sums.collect()}

    def level(self, trees: list[dict], bins: int) -> np.ndarray:
        """[tree, node, feature, bin, (count, gradient)] of the rows at each node of both trees."""
        n_features, sizes = self.n_features, [len(t["feature"]) for t in trees]
        nodes = max(sizes)

        def make(state, codes, y, mean, log_dev):  # noqa: ANN001, ANN202
            if state is None:
                state = np.zeros((2, 2 * nodes * n_features * bins), np.int64)
            for t, g in enumerate(gradient(y, mean, log_dev)):
                base = (t * nodes + leaves(trees[t], codes)) * n_features
                whole = np.rint(np.clip(g, -1e6, 1e6) * GRADIENT)
                for f in range(n_features):
                    at = (base + f) * bins + codes[f]
                    np.add.at(state[0], at, 1)
                    np.add.at(state[1], at, whole.astype(np.int64))
            return state

        def finish(state):  # noqa: ANN001, ANN202
            there = np.flatnonzero(state[0])
            return there, state[0][there], state[1][there]

        out = np.zeros((2, nodes, n_features, bins, 2))
        flat = out.reshape(-1, 2)
        for key, (n, total) in self._aggregate(make, finish).items():
            flat[key] = n, total / GRADIENT
        return out

    def tried(self, trees: list[dict], powers: list[int]) -> tuple[float, float, list[float]]:
        """Mean loss now, mean length of the step, and the mean loss after steps of each power of two."""

        def make(state, codes, y, mean, log_dev):  # noqa: ANN001, ANN202
            a, b = walked(trees[0], codes), walked(trees[1], codes)
            losses = [loss(y, mean, log_dev)] + [loss(y, mean - 2.0**p * a, log_dev - 2.0**p * b) for p in powers]
            found = [int(np.rint(np.hypot(a, b) * LOSS).sum()), *[int(np.rint(np.minimum(x, 1e6) * LOSS).sum()) for x in losses]]
            return [len(y), found] if state is None else [state[0] + len(y), [x + z for x, z in zip(state[1], found, strict=True)]]

        def finish(state):  # noqa: ANN001, ANN202
            return range(len(state[1])), [state[0]] * len(state[1]), state[1]

        sums = self._aggregate(make, finish)
        means = [sums[k][1] / LOSS / sums[k][0] for k in range(len(powers) + 2)]
        return means[1], means[0], means[2:]

    def add(self, stage: dict) -> None:
        """Take in a stage; every CUT stages the rows are written with what is predicted by then."""
        self.pending.append(stage)
        if len(self.pending) >= CUT:
            pending, n_features, rate, names = list(self.pending), self.n_features, self.rate, self.rows.columns

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for codes, y, mean, log_dev in advanced(batches, pending, n_features, rate):
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in codes], pa.array(y), pa.array(mean), pa.array(log_dev)], names)

            self.rows, self.pending = self.scratch.written(self.rows.mapInArrow(run, self.rows.schema)), []


def best_split(sums: np.ndarray, least_leaf: int) -> tuple[int, int] | None:
    """(feature, code) of the cut of a node's [feature, bin, (count, gradient)] that lowers the squared error most; the first of equals."""
    n, g = sums[:, :, 0].cumsum(axis=1), sums[:, :, 1].cumsum(axis=1)
    all_n, all_g = n[:, -1:], g[:, -1:]
    allowed = (n >= least_leaf) & (all_n - n >= least_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, g * g / n + (all_g - g) ** 2 / (all_n - n) - all_g * all_g / all_n, -1.0)
    best = int(np.argmax(gain))
    found = gain.reshape(-1)[best]
    return divmod(best, sums.shape[1]) if found > 1e-12 * max(1.0, float(all_g[0, 0] ** 2 / max(all_n[0, 0], 1))) else None


def grown(learner: Learner, bins: int, depth: int, least_leaf: int) -> list[dict]:
    """Two trees fitted to the natural gradient, level by level."""
    trees = [{"feature": [-1], "code": [0], "left": [0], "right": [0], "value": [0.0]} for _ in range(2)]
    open_nodes = [[0], [0]]
    for level in range(depth + 1):
        if not any(open_nodes):
            break
        sums = learner.level(trees, bins)
        for t, tree in enumerate(trees):
            now, open_nodes[t] = open_nodes[t], []
            for node in now:
                own = sums[t, node]
                total = own[0].sum(axis=0)
                tree["value"][node] = float(total[1] / total[0]) if total[0] else 0.0
                split = best_split(own, least_leaf) if level < depth else None
                if split:
                    feature, code = split
                    at = len(tree["feature"])
                    tree["feature"][node], tree["code"][node], tree["left"][node], tree["right"][node] = feature, code, at, at + 1
                    part = own[feature, : code + 1].sum(axis=0), own[feature, code + 1 :].sum(axis=0)
                    for side in part:
                        for k, v in (("feature", -1), ("code", 0), ("left", 0), ("right", 0), ("value", float(side[1] / side[0]))):
                            tree[k].append(v)
                    if level + 1 < depth:
                        open_nodes[t] += [at, at + 1]
    return trees


def step_of(learner: Learner, trees: list[dict]) -> tuple[float, float]:
    """The stage's step, and the mean length of its gradient: doubled from 1 while no worse than now, then halved until better."""
    now, length, after = learner.tried(trees, list(POWERS))
    value = dict(zip(POWERS, after, strict=True))
    power = 0
    while power < max(POWERS) and value[power] <= now:
        power += 1
    while True:
        if power not in value:
            low = range(power - 11, power + 1)
            value |= dict(zip(low, learner.tried(trees, list(low))[2], strict=True))
        if value[power] < now or length * 2.0**power < SMALLEST:
            return 2.0**power, length
        power -= 1


def train(rows: DataFrame, features: list[str], target: str, stages: int = 60, rate: float = 0.05, depth: int = 2, least_leaf: int = 40, bins: int = 64) -> dict:
    """A model for ``operators.models.predicted``, learned from all ``rows``: start values, stages, rate, and each feature's domain (its range and a quarter more).

    Rows with a missing feature or target are left out; without any left, or with
    equal targets alone, ValueError says so. A leaf has ``least_leaf`` rows or more.
    """
    spark = rows.sparkSession
    given = [F.col(f"`{c}`").cast("double") for c in features]
    known = rows.select(*[c.alias(f"x{k}") for k, c in enumerate(given)], F.col(f"`{target}`").cast("double").alias("y")).dropna()
    known = known.filter(~F.isnan("y")) if features else known
    with Scratch(spark, "boosting") as scratch:
        known = scratch.written(known)
        names = [f"x{k}" for k in range(len(features))]
        start = known.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("dev"), *[f(c).alias(f"{side}{c}") for c in names for side, f in (("low", F.min), ("high", F.max))]).first()
        if not start["n"] or not start["dev"]:
            raise ValueError("pooled_training_support_insufficient")
        cuts = cut_points(known, names, bins)
        code = lambda k: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[k]]).cast("array<double>"), lambda c: c < F.col(f"x{k}"))).cast("int")
        begun = (float(start["mean"]), math.log(start["dev"]))
        coded = known.select(*[code(k).alias(f"c{k}") for k in range(len(features))], "y", F.lit(begun[0]).alias("mean"), F.lit(begun[1]).alias("log_dev"))
        learner = Learner(scratch, scratch.written(coded), len(features), rate)
        out = []
        for _ in range(stages):
            trees = grown(learner, bins, depth, least_leaf)
            scale, length = step_of(learner, trees)
            stage = {"scale": scale, "trees": trees}
            learner.add(stage)
            out.append(stage)
            if length < SMALLEST:
                break
    for stage in out:
        for tree in stage["trees"]:
            tree["cut"] = [cuts[f][c] if f >= 0 else 0.0 for f, c in zip(tree["feature"], tree["code"], strict=True)]
    wide = [max((start[f"highx{k}"] - start[f"lowx{k}"]) * 0.25, 1e-12) for k in range(len(features))]
    return {"start": begun, "rate": rate, "stages": out, "lower": [start[f"lowx{k}"] - w for k, w in enumerate(wide)], "upper": [start[f"highx{k}"] + w for k, w in enumerate(wide)]}


def priced(features: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``features`` with mean, deviation and ``reason``: inputs that are missing or out of the model's domain, or parameters out of range, give a reason instead."""
    from strikeloom.operators.models import predicted

    outside = [(F.col(c) < low) | (F.col(c) > high) for c, low, high in zip(columns, model["lower"], model["upper"], strict=True)]
    rows = predicted(features, model, columns)
    missing = F.greatest(*[(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in columns]) == 1
    bad = ~F.log("deviation").between(-20 + 1e-12, 5 - 1e-12) | F.col("mean").isNull()
    reason = F.when(missing, "pooled_inputs_invalid").when(F.greatest(*[F.coalesce(x, F.lit(False)).cast("int") for x in outside]) == 1, "pooled_inputs_out_of_domain").when(bad, "pooled_parameters_invalid")
    rows = rows.withColumn("reason", reason)
    return rows.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("mean", "deviation")})
