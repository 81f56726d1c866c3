"""Day files of bars as a Spark data source, batch and stream, and bars and contracts from stored pages.

A day file is a gzip CSV named by its day, or one in a folder ``day=...``. The source makes one partition a file, and
one offset a day when it is streamed, so both readings give the same rows.
"""

from __future__ import annotations

import csv
import datetime
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from strikeloom.functions.display import local_midnight

#: What a day file has of a bar, as it was written: numbers that aren't any are null. ``line`` is the record's place in its file.
RECORD = "day date, line long, ticker string, volume double, open double, close double, high double, low double, window_start long, transactions long"
_ARROW = pa.schema([("day", pa.date32()), ("line", pa.int64()), ("ticker", pa.string()), *[(c, pa.float64()) for c in ("volume", "open", "close", "high", "low")], ("window_start", pa.int64()), ("transactions", pa.int64())])


def day_of(path: str) -> datetime.date | None:
    """The day that a file or its folder is named by; None if it isn't a day file."""
    *_, folder, name = ["", *path.split("/")]
    if not name.endswith(".csv.gz"):
        return None
    try:
        return datetime.date.fromisoformat(folder.removeprefix("day=") if folder.startswith("day=") else name[:10])
    except ValueError:
        return None


def number(text: str | None, whole: bool = False) -> float | int | None:
    try:
        value = float(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    if value != value or abs(value) == float("inf"):
        return None
    return (int(text) if text and text.lstrip("-").isdigit() else int(value)) if whole else value


class DayFile(InputPartition):
    def __init__(self, uri: str, day: datetime.date):
        self.uri, self.day = uri, day


def listed(folder: str, first: datetime.date, last: datetime.date) -> list[DayFile]:
    """The day files below a folder, in the order of their days; of several of a day each is one."""
    store, path = fs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    found = [(day, info.path) for info in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if info.is_file and (day := day_of(info.path)) and first <= day <= last]
    return [DayFile(prefix + p, day) for day, p in sorted(found)]


def records(part: DayFile, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """The records of one file as Arrow batches, read as they are decompressed."""
    store, path = fs.FileSystem.from_uri(part.uri)
    with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as plain:
        held: list[tuple] = []
        for line, r in enumerate(csv.DictReader(io.TextIOWrapper(plain, encoding="utf-8", errors="replace"))):
            held.append((part.day, line, r.get("ticker") or "", *[number(r.get(c)) for c in ("volume", "open", "close", "high", "low")], number(r.get("window_start"), True), number(r.get("transactions"), True)))
            if len(held) >= rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Span:
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.first = datetime.date.fromisoformat(options.get("first", "0001-01-01"))
        self.last = datetime.date.fromisoformat(options.get("last", "9999-12-31"))


class _Reader(_Span, DataSourceReader):
    def partitions(self) -> list[DayFile]:
        return listed(self.folder, self.first, self.last)

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        return records(partition) if isinstance(partition, DayFile) else iter(())


class _Stream(_Span, DataSourceStreamReader):
    """Offsets are days: a batch has the files of the days after the last one; files of a day that is done aren't read again."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": "0001-01-01"}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.folder, self.first, self.last)
        return {"day": files[-1].day.isoformat() if files else "0001-01-01"}

    def partitions(self, start: dict, end: dict) -> list[DayFile]:
        after, upto = (datetime.date.fromisoformat(x["day"]) for x in (start, end))
        return [f for f in listed(self.folder, self.first, self.last) if after < f.day <= upto]

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        return records(partition)

    def commit(self, end: dict) -> None:
        pass


class DayBars(DataSource):
    """``dayfiles``: options ``path``, and ``first`` and ``last`` day, both included."""

    @classmethod
    def name(cls) -> str:
        return "dayfiles"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def read_days(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None, stream: bool = False) -> DataFrame:
    """Records of the day files of a folder (pyarrow's file systems), read by Spark's tasks, a file each."""
    spark.dataSource.register(DayBars)
    reader = (spark.readStream if stream else spark.read).format("dayfiles").option("path", folder)
    for name, value in (("first", first), ("last", last)):
        reader = reader.option(name, value) if value else reader
    return reader.load()


def flat_bars(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """ticker, day, t (milliseconds of the New York midnight), o, h, l, c, v, n: the last record of each ticker and day file.

    ``wanted`` (ticker) keeps only its tickers. An aggregate by ticker and day,
    combined before it's shuffled. Records without a window start have no ``t``.
    """
    if wanted is not None:
        rows = rows.join(wanted.select("ticker").distinct(), "ticker", "left_semi")
    last = rows.groupBy("ticker", "day").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "transactions", "window_start"), "line").alias("r"))
    t = local_midnight(F.expr("r.window_start div 1000000"))
    return last.select("ticker", "day", t.alias("t"), F.col("r.open").alias("o"), F.col("r.high").alias("h"), F.col("r.low").alias("l"), F.col("r.close").alias("c"), F.col("r.volume").alias("v"), F.col("r.transactions").alias("n"))


def daily_lookup(bars: DataFrame, contracts: DataFrame, today: str, back: int = 24) -> DataFrame:
    """Bars of ``flat_bars`` of each contract within its life and the last ``back`` months: contract, and the bars' columns but the ticker."""
    start = F.add_months(F.lit(today).cast("date"), -back)
    rows = bars.join(contracts.select(F.col("contract").alias("ticker"), "expiry"), "ticker")
    return rows.filter((F.col("day") >= start) & (F.col("day") <= F.lit(today).cast("date")) & (F.col("day") <= F.col("expiry"))).withColumnRenamed("ticker", "contract").drop("expiry")


PAGE = "adjusted boolean, results array<struct<t: long, o: double, h: double, l: double, c: double, v: double, n: long, vw: double>>"


def page_bars(pages: DataFrame) -> DataFrame:
    """Bars of stored aggregate pages (ticker, page, body): ticker, adjusted, t, o, h, l, c, v, n, vw; the last of each time.

    What the first page says of adjustment holds for all pages (true where it says
    nothing). Pages that are no JSON have no bars.
    """
    read = pages.withColumn("p", F.from_json("body", PAGE))
    flag = read.groupBy("ticker").agg(F.coalesce(F.min_by("p.adjusted", F.when(F.col("page") == 1, 1)), F.lit(True)).alias("adjusted"))
    rows = read.select("ticker", "page", F.posexplode("p.results").alias("place", "r")).filter("r.t is not null")
    last = rows.groupBy("ticker", F.col("r.t").alias("t")).agg(F.max_by("r", F.struct("page", "place")).alias("r"))
    return last.join(flag, "ticker").select("ticker", "adjusted", "t", *[F.col(f"r.{c}").alias(c) for c in ("o", "h", "l", "c", "v", "n", "vw")])


CONTRACTS = "results array<struct<ticker: string, underlying_ticker: string, contract_type: string, strike_price: double, expiration_date: string, shares_per_contract: double>>"


def listed_contracts(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Contracts of stored listing pages (underlying, place of the underlying, expired, page, body), each the first time it's listed.

    Underlyings go by their place, of each the expired ones first, then pages and
    places. With ``most`` only so many contracts in that order: a report's limit.
    """
    rows = pages.select("underlying", "place", "expired", "page", F.posexplode(F.from_json("body", CONTRACTS)["results"]).alias("at", "r")).filter("r.ticker is not null")
    order = F.struct("place", F.when(F.col("expired"), 0).otherwise(1).alias("late"), "page", "at")
    first = rows.groupBy(F.col("r.ticker").alias("contract")).agg(F.min_by(F.struct("underlying", "expired", "r"), order).alias("f"), F.min(order).alias("order"))
    out = first.select("contract", "f.underlying", "f.expired", F.col("f.r.contract_type").alias("side"), F.col("f.r.strike_price").alias("strike"), F.to_date(F.col("f.r.expiration_date")).alias("expiry"), F.col("f.r.shares_per_contract").alias("shares"), "order")
    return (out.orderBy("order", "contract").limit(most) if most is not None else out).drop("order")
