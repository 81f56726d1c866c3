"""Odds from option prices: model-free bounds, slopes, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["ticker", "month"]


def strikes(quotes: DataFrame) -> DataFrame:
    """Best bid and ask of each strike of a call expiry."""
    return quotes.filter("side = 'call' and bid > 0").groupBy("ticker", F.date_format("expiry", "yyyy-MM").alias("month"), "strike").agg(F.max("bid").alias("bid"), F.min("ask").alias("ask"))


def steepest(k: list[float], base: list[float], value: list[float]) -> list[float | None]:
    """For each i the largest (value[i] - base[j]) / (k[i] - k[j]) of all j before i; None for the first.

    The best j is where a line from the point touches the lower hull of the points
    before it, which is found by bisection: n log n steps, no pairs.
    """
    hull: list[int] = []
    out: list[float | None] = []

    def slope(i: int, j: int) -> float:
        return (value[i] - base[j]) / (k[i] - k[j])

    for i in range(len(k)):
        if hull:
            low, high = 0, len(hull) - 1
            while low < high:
                mid = (low + high) // 2
                if slope(i, hull[mid]) < slope(i, hull[mid + 1]):
                    low = mid + 1
                else:
                    high = mid
            out.append(max(slope(i, hull[j]) for j in range(max(0, low - 2), min(len(hull), low + 3))))
        else:
            out.append(None)
        while len(hull) > 1 and (base[hull[-1]] - base[hull[-2]]) * (k[i] - k[hull[-2]]) >= (base[i] - base[hull[-2]]) * (k[hull[-1]] - k[hull[-2]]):
            hull.pop()
        hull.append(i)
    return out


def vertical_bounds(chain: DataFrame, clamped: bool = True) -> DataFrame:
    """Bounds on the chance of ending above each strike from all pairs of strikes on one side of it.

    Upper: the least (ask below - bid) / distance of the strikes below; lower: the
    greatest (bid - ask above) / distance of those above. Different strikes of an expiry
    are one group, walked through once in either direction. Unless ``clamped``, bounds may lie outside 0 and 1.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    given = chain.select(*KEY, "strike", "bid", "ask")
    schema = T.StructType([*given.schema.fields[:-2], T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])
    dealt = given.repartition(*KEY).sortWithinPartitions(*KEY, "strike")
    n = len(KEY)

    def bounded(k: list[float], bid: list[float], ask: list[float]) -> tuple[list, list]:
        up = steepest(k, ask, bid)
        down = steepest([-x for x in reversed(k)], ask[::-1], bid[::-1])[::-1]
        cut = (lambda x: min(max(x, 0.0), 1.0)) if clamped else (lambda x: x)
        return [None if x is None else cut(-x) for x in up], [None if x is None else cut(x) for x in down]

    def walk(batches):  # noqa: ANN001, ANN202
        held: list[list] = [[] for _ in range(n + 3)]

        def done(keep: int):  # noqa: ANN202
            """Rows of the groups that have ended: all but the last ``keep`` rows."""
            stop = len(held[0]) - keep
            upper, lower, at = [], [], 0
            while at < stop:
                end = at + 1
                while end < stop and all(held[c][end] == held[c][at] for c in range(n)):
                    end += 1
                u, low = bounded(*(held[n + c][at:end] for c in range(3)))
                upper += u
                lower += low
                at = end
            columns = [held[c][:stop] for c in range(n + 1)]
            for c in range(n + 3):
                del held[c][:stop]
            arrays = [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(upper, pa.float64()), pa.array(lower, pa.float64())], names=schema.names)

        kinds = None
        for batch in batches:
            kinds = batch.schema.types[: n + 1]
            for c in range(n + 3):
                held[c] += batch.column(c).to_pylist()
            last = len(held[0]) - 1
            first = last
            while first > 0 and all(held[c][first - 1] == held[c][last] for c in range(n)):
                first -= 1
            if first > 0:
                yield done(last - first + 1)
        if held[0]:
            yield done(0)

    return dealt.mapInArrow(walk, schema)


def slopes(chain: DataFrame) -> DataFrame:
    """Slope to the next strike, second difference, and the digital's probability from both slopes around a strike."""
    w = W.partitionBy(*KEY).orderBy("strike")
    mid = chain.withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    s = mid.withColumn("slope", (F.lead("mid").over(w) - F.col("mid")) / (F.lead("strike").over(w) - F.col("strike")))
    s = s.withColumn("before", F.lag("slope").over(w))
    return s.withColumns({"second": F.col("slope") - F.col("before"), "digital": -(F.col("slope") + F.col("before")) / 2})


def monotone_guard(probabilities: DataFrame, slack: float = 0.001) -> DataFrame:
    """Whether the chances of an expiry never rise with the strike by more than ``slack``."""
    w = W.partitionBy(*KEY).orderBy("strike")
    rises = probabilities.withColumn("rise", F.coalesce(F.col("p") < F.lead("p").over(w) - slack, F.lit(False)))
    return rises.groupBy(*KEY).agg(F.bool_or("rise").alias("broken"), F.count("*").alias("strikes"))
