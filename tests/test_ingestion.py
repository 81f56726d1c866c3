"""Day files read as batch and stream, pages, and consistent copies of tables."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from strikeloom.sources import flatfiles as S
from strikeloom.sources.artifacts import ArtifactError
from strikeloom.sources.frozen import freeze
from strikeloom.streaming.capture import drain, work_dir

HEAD = "ticker,volume,open,close,high,low,window_start,transactions\n"


def nanos(day):
    return int(dt.datetime(day.year, day.month, day.day, 5, tzinfo=dt.UTC).timestamp()) * 1_000_000_000


@pytest.fixture
def folder(tmp_path):
    for k in range(5):
        day = dt.date(2024, 12, 30) + dt.timedelta(days=k)
        path = tmp_path / f"{day:%Y/%m}"
        path.mkdir(parents=True, exist_ok=True)
        lines = [f"O:A{i},{i},1.5,2,3,x,{nanos(day)},{i if i % 2 else 'nan'}" for i in range(20)] + [f"O:A3,{100 + k},,9,9,9,{nanos(day)},7", ",1,1,1,1,1,,1"]
        (path / f"{day}.csv.gz").write_bytes(gzip.compress((HEAD + "\n".join(lines)).encode()))
    (tmp_path / "2024/12/notes.csv.gz").write_bytes(b"no day")
    (tmp_path / "2024/12/2024-12-31.txt").write_text("no bars")
    return f"file://{tmp_path}"


def test_batch(spark, folder):
    rows = S.read_days(spark, folder)
    assert rows.count() == 5 * 22 and rows.rdd.getNumPartitions() == 5
    assert S.read_days(spark, folder, "2024-12-31", "2025-01-01").select("day").distinct().count() == 2
    bars = {(r.ticker, r.day): r for r in S.flat_bars(rows).collect()}
    last = bars["O:A3", dt.date(2025, 1, 2)]
    assert (last.o, last.c, last.v, last.n) == (None, 9.0, 103.0, 7) and last.t == nanos(dt.date(2025, 1, 2)) // 1_000_000
    assert bars["O:A4", dt.date(2024, 12, 30)].l is None and bars["O:A4", dt.date(2024, 12, 30)].n is None and bars["", dt.date(2024, 12, 30)].t is None
    wanted = spark.createDataFrame([("O:A3",), ("O:A3",), ("none",)], "ticker string")
    assert S.flat_bars(rows, wanted).count() == 5
    contracts = spark.createDataFrame([("O:A3", dt.date(2025, 1, 1)), ("O:A5", dt.date(2026, 1, 1))], "contract string, expiry date")
    assert S.daily_lookup(S.flat_bars(rows), contracts, "2025-01-02").groupBy("contract").count().orderBy("contract").collect() == [("O:A3", 3), ("O:A5", 4)]


def test_stream_is_the_batch_and_goes_on(spark, folder, tmp_path):
    got = drain(S.read_days(spark, folder, stream=True), "append", "days").drop("batch")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, S.read_days(spark, folder).collect()), key=str)
    home = work_dir(spark, "days")
    seen = []
    for k in range(2):
        query = S.read_days(spark, folder, stream=True).writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).format("parquet").option("path", f"{home}/out").start()
        query.awaitTermination()
        seen.append(spark.read.parquet(f"{home}/out").count())
        if not k:
            (tmp_path / "2025/01/2025-01-06.csv.gz").write_bytes(gzip.compress((HEAD + f"O:Z,1,1,1,1,1,{nanos(dt.date(2025, 1, 6))},1").encode()))
    assert seen == [110, 111]


def test_pages(spark):
    bar = lambda t, c: {"t": t, "o": 1, "h": 2, "l": 1, "c": c, "v": 3, "n": 4}
    pages = [("A", 1, json.dumps({"adjusted": False, "results": [bar(1, 1), bar(2, 2)]})), ("A", 2, json.dumps({"adjusted": True, "results": [bar(2, 5), bar(3, 3), {}]})), ("B", 1, json.dumps({"results": None})), ("C", 1, "junk"), ("D", 1, json.dumps({"results": [bar(1, 1)]}))]
    got = {(r.ticker, r.t): (r.adjusted, r.c) for r in S.page_bars(spark.createDataFrame(pages, "ticker string, page int, body string")).collect()}
    assert got == {("A", 1): (False, 1.0), ("A", 2): (False, 5.0), ("A", 3): (False, 3.0), ("D", 1): (True, 1.0)}
    one = lambda *names: json.dumps({"results": [{"ticker": n, "strike_price": 5.5, "expiration_date": "2025-01-17", "contract_type": "call"} for n in names]})
    lists = [("Y", 1, False, 1, one("c", "d")), ("X", 0, False, 1, one("b")), ("X", 0, True, 1, one("a", "b")), ("X", 0, True, 2, one("a", "e")), ("Z", 2, True, 1, "{}")]
    df = spark.createDataFrame(lists, "underlying string, place int, expired boolean, page int, body string")
    assert {r.contract: (r.underlying, r.expired) for r in S.listed_contracts(df).collect()} == {"a": ("X", True), "b": ("X", True), "e": ("X", True), "c": ("Y", False), "d": ("Y", False)}
    assert [r.contract for r in S.listed_contracts(df, 2).collect()] == ["a", "b"]


def test_frozen_tables(spark, tmp_path):
    tables = {"a": spark.range(1000).withColumn("x", F.col("id") % 7), "b": spark.createDataFrame([], "k string, more int")}
    contract = {"a": "x bigint, id bigint", "b": "k string"}
    counts = freeze(spark, tables, contract, f"file://{tmp_path}/one", {"a": "x > 0"})
    assert counts == {"a": {"read": 1000, "written": 857}, "b": {"read": 0, "written": 0}}
    assert spark.read.parquet(f"file://{tmp_path}/one/a").columns == ["x", "id"]
    for wrong in ({"c": "k string"}, {"a": "x string"}, {"a": "y bigint"}):
        with pytest.raises(ArtifactError):
            freeze(spark, tables, wrong, f"file://{tmp_path}/two")
