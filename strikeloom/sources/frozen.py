"""A consistent copy of several tables: their schemas are a contract, and rows are counted while they are written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strikeloom.sources.artifacts import ArtifactError


def contracted(spark: SparkSession, tables: Mapping[str, DataFrame], contract: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables of the contract with its columns in its order; a table that isn't there, or has a column missing or of another type, raises ArtifactError.

    ``contract`` maps names to schemas as text. Columns beyond it are left out.
    """
    out = {}
    for name, text in contract.items():
        if name not in tables:
            raise ArtifactError(f"table unavailable: {name}")
        wanted, found = StructType.fromDDL(text), tables[name].schema
        kinds = {f.name: f.dataType for f in found.fields}
        wrong = [f.name for f in wanted.fields if kinds.get(f.name) != f.dataType]
        if wrong:
            raise ArtifactError(f"{name}: columns missing or of another type: {', '.join(wrong)}")
        out[name] = tables[name].select(*[F.col(f"`{f.name}`") for f in wanted.fields])
    return out


def freeze(spark: SparkSession, tables: Mapping[str, DataFrame], contract: Mapping[str, str], folder: str, filters: Mapping[str, str] | None = None) -> dict[str, dict[str, int]]:
    """Write the contract's tables below ``folder`` and return of each how many rows were read and written, without a second scan.

    ``filters`` holds a condition a table; what it leaves out is read and counted, not
    written. Counts come from observations of the very writes, so they are of the
    rows that were seen then, whatever happens to the sources after. Written files
    that have another number of rows raise ArtifactError; their footers tell.
    """
    counts = {}
    for name, table in contracted(spark, tables, contract).items():
        read, kept = Observation(f"{name} read"), Observation(f"{name} kept")
        rows = table.observe(read, F.count(F.lit(1)).alias("n"))
        rows = rows.filter(filters[name]) if filters and name in filters else rows
        rows.observe(kept, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        counts[name] = {"read": read.get["n"], "written": kept.get["n"]}
        if (there := spark.read.parquet(f"{folder}/{name}").count()) != counts[name]["written"]:
            raise ArtifactError(f"{name}: {there} rows are there, {counts[name]['written']} were written")
    return counts
