"""What the operators of this subpackage share: the shared folder, written tables, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, as a URI.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, a local
    master gets a temporary folder, which is remembered, and any other raises ValueError.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strikeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder, never used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives the loss of any executor and
    makes values drawn at write time (row numbers, file names) final.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Work:
    """Tables that an operator writes in the shared folder and that go when it has its result.

    Used as a context: what ``written`` wrote is deleted at its end, whether it
    failed or not, so results must be written elsewhere before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, fresh_dir(spark, name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As ``written``, in this context's folder."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_: object) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers or one digest each that may be broadcast; they are counted first.
MOST_BROADCAST = 1_000_000
#: Keys that hold more than one in so many rows; there can't be more of them than this.
SHARE = 100_000


def small(rows: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``rows``, counted, and marked to be broadcast if they are ``most`` at most; beyond that joins shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def join_keys(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``per_key``, which has one row for each key and in ``count`` how many of ``rows`` it has.

    Keys with more than one in SHARE of all ``total`` rows (and over 1,000) go by
    a broadcast, as there are fewer than SHARE of them at any size; the other
    rows are shuffled by key, so that no task gets a hot one. Both should be
    written tables. ``count`` isn't among the columns returned.
    """
    limit = max(1000, total // SHARE)
    hot = per_key.filter(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(per_key.drop(count), key, how)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.filter(F.col(count) <= limit).drop(count), key, how)
    return rows.join(F.broadcast(hot.drop(count)), key).unionByName(cold)


def column(name: str) -> F.Column:
    """The top-level column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def set_apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[F.Column]]:
    """``docs`` with all columns but ``used`` under names that no operator has, and the columns that bring the old names back in order."""
    names = {c: c if c in used else f"own column {i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[column(c).alias(n) for c, n in names.items()]), [column(n).alias(c) for c, n in names.items()]


def slices(batch: pa.RecordBatch, rows: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of text, one row at least."""
    lengths = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` in slices bounded in rows and bytes; ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, rows):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out
        pa.default_memory_pool().release_unused()  # workers are kept for later tasks

    return df.mapInArrow(run, schema)


def text_of(column: str) -> F.Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
