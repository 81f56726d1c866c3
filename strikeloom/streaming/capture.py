"""Streams: windowed bars, capture windows with state, deduplicated and latest-wins sinks.

Each runs over whatever its source has (``availableNow``) and goes on from its
checkpoint. Results are kept as Parquet by micro-batch, so a batch that is run
again replaces its own files and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder; a temporary one where that isn't set and the master is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="strikeloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder, or one file)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*")


def drain(stream: DataFrame, mode: str, name: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run ``stream`` until its source is used up; all micro-batches' rows with their ``batch``."""
    spark = stream.sparkSession
    home = work_dir(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        out = each(rows, batch) if each else rows
        out.write.mode("overwrite").parquet(f"{home}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{home}/out")


def hourly(ticks: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Tumbling hours of each contract under a watermark: count and sum."""
    return ticks.withWatermark("at", late).groupBy("contract", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select("contract", F.col("w.start").alias("start"), "n", "cents")


def latest_windows(batches: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The last update of each key."""
    return batches.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*key, "v.*")


def deduplicated(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


RANK = {"pending": 0, "missed": 1, "captured": 2}


def capture_states(events: DataFrame) -> DataFrame:
    """State of each contract and session kept across batches: captured stands over missed, missed over pending.

    The state is Spark's own of an aggregate, a rank and a count for each key; no Python sees a row.
    """
    rank = F.coalesce(*[F.when(F.col("state") == name, F.lit(k)) for name, k in RANK.items()])
    kept = events.groupBy("contract", "session").agg(F.max(rank).alias("rank"), F.count("*").alias("events"))
    return kept.select("contract", "session", F.element_at(F.array(*[F.lit(name) for name in RANK]), F.col("rank") + 1).alias("state"), "events")
