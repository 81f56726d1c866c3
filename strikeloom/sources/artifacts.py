"""Immutable study artifacts: a snapshot's tables written once, a manifest with hashes, and verification.

Tables are written by Spark with explicit schemas into a staging folder that is
renamed when the manifest is complete. Paths go through Hadoop's file system, so
any store that Spark writes to will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOLATILE = ("written_at", "manifest_sha256")


class ArtifactError(ValueError):
    """An artifact that isn't what its manifest says."""


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys and no spaces; what changes from run to run is left out."""
    if isinstance(value, Mapping):
        value = {k: v for k, v in value.items() if k not in VOLATILE}
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, make = _store(spark, path)
    out = fs.create(make(path), False)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def content_hash(table: DataFrame) -> DataFrame:
    """Rows and an order-free hash of all columns, summed on the executors."""
    row = F.xxhash64(*[F.col(c) for c in sorted(table.columns)]).cast("decimal(38,0)")
    return table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("hash"))


def files_hash(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the names and SHA-256 digests of a folder's Parquet files, each digested on an executor."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    each = files.select(F.concat(F.element_at(F.split("path", "/"), -1), F.lit(":"), F.sha2("content", 256)).alias("x"))
    return each.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("x"))).cast("binary"), 256).alias("h")).first()["h"]


def describe(spark: SparkSession, folder: str) -> dict:
    """Rows, content hash, schema and the files' hash of a written table, as a manifest has them."""
    table = spark.read.parquet(folder)
    found = content_hash(table).first()
    return {"rows": found["rows"], "hash": found["hash"], "schema": table.schema.simpleString(), "files_sha256": files_hash(spark, folder)}


def publish(spark: SparkSession, stage: str, path: str) -> None:
    """Give ``stage`` the name ``path`` in one step; raises ArtifactError if something has it, also if it came a moment ago."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri(), conf).rename(make(stage), make(path), none)
    except Py4JJavaError as fault:
        raise ArtifactError(f"{path} can't be made: {fault.java_exception.getClass().getSimpleName()}") from fault


def write_artifact(tables: Mapping[str, DataFrame], path: str, metadata: Mapping[str, object]) -> dict:
    """Write every table and the manifest; an artifact that exists already raises ArtifactError.

    Each writer has a stage of its own, so two can't mix; the first to publish wins.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, make = _store(spark, path)
    if fs.exists(make(path)):
        raise ArtifactError(f"{path} exists")
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    try:
        entries = {}
        for name, table in sorted(tables.items()):
            table.write.mode("errorifexists").option("compression", "zstd").parquet(f"{stage}/{name}")
            entries[name] = describe(spark, f"{stage}/{name}")
        manifest = {**metadata, "tables": entries, "spark": spark.version}
        manifest["manifest_sha256"] = canonical_hash(manifest)
        _put(spark, f"{stage}/manifest.json", json.dumps(manifest, sort_keys=True, indent=1))
        publish(spark, stage, path)
    finally:
        fs.delete(make(stage), True)
    return manifest


def verify_artifact(spark: SparkSession, path: str) -> dict:
    """The manifest, after every table was read and compared with it; raises ArtifactError otherwise."""
    manifest = json.loads(_get(spark, f"{path}/manifest.json"))
    if manifest.get("manifest_sha256") != canonical_hash(manifest):
        raise ArtifactError("the manifest was changed")
    fs, make = _store(spark, path)
    there = {s.getPath().getName() for s in fs.listStatus(make(path)) if s.isDirectory()}
    if there != set(manifest["tables"]):
        raise ArtifactError(f"tables {sorted(there)}; the manifest has {sorted(manifest['tables'])}")
    for name, entry in manifest["tables"].items():
        if (found := describe(spark, f"{path}/{name}")) != entry:
            raise ArtifactError(f"{name} is {found}, not {entry}")
    return manifest


def freeze_snapshot(spark: SparkSession, ticks: DataFrame, contracts: DataFrame, sessions: DataFrame, stocks: DataFrame, path: str) -> dict:
    """Validate, roll up and reconcile an archive and write it as a snapshot.

    Every tick is in exactly one of the valid and the excluded rows, which is checked.
    """
    from strikeloom.operators import archive as R
    from strikeloom.sources.adapters import bars

    checked = R.hour_validity(ticks, contracts, sessions)
    days = R.contract_days(checked.withColumn("usable", F.col("reason").isNull() & F.col("regular")))
    reconciled = R.reconcile(bars(ticks, "hour"), bars(ticks.filter("kind <> 'error'"), "day"))
    tables = {"contracts": contracts, "hours": checked.drop("open_at", "close_at"), "days": days, "stocks": stocks, "daily_validation": reconciled, "exclusions": R.exclusions(contracts, checked, reconciled)}
    manifest = write_artifact(tables, path, {"kind": "snapshot", "version": 1})
    kept = spark.read.parquet(f"{path}/days").agg(F.sum("rows").alias("n")).first()["n"] or 0
    if kept != manifest["tables"]["hours"]["rows"]:
        raise ArtifactError("days don't account for all rows")
    return manifest


def markdown(rows: DataFrame, columns: list[str], most: int = 200) -> str:
    """A report table of the first ``most`` rows; if there are more, its last line says so."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    found = rows.select(*columns).limit(most + 1).collect()
    for r in found[:most]:
        lines.append("| " + " | ".join("" if v is None else str(v) for v in r) + " |")
    if len(found) > most:
        lines.append(f"\nThe first {most} of {rows.count()} rows.")
    return "\n".join(lines)
