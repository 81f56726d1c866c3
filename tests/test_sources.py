"""Payload readers and artifacts."""

from __future__ import annotations

import gzip
import json

import pytest

from strikeloom.sources import adapters as A
from strikeloom.sources import artifacts as R
from strikeloom.sources import payloads as P


def test_chain_payload(spark):
    row = lambda **x: {"expirygroup": "", "strike": None, **x}
    body = json.dumps({"data": {"totalRecord": 4, "lastTrade": "LAST TRADE: $1,041.13 (AS OF SEP 11, 2026)", "table": {"rows": [
        row(expirygroup="September 18, 2026"),
        row(strike="40.50", c_Bid="1.25", c_Ask="--", c_Openinterest="1,204", p_Bid="", p_Ask="x"),
        row(strike="41.00", c_Bid="0.95", drillDownURL="/market/x--260925C00041000"),
        row(strike="n/a"),
    ]}}, "status": {"rCode": 200}})
    got = P.chain(spark.createDataFrame([("IREN", body), ("BAD", '{"status":{"rCode":400}}')], "ticker string, body string")).orderBy("pos").collect()
    assert [(str(r.expiry), float(r.strike), r.call_ask, r.call_oi) for r in got] == [("2026-09-18", 40.5, None, 1204), ("2026-09-25", 41.0, None, None)]
    assert float(got[0].call_bid) == 1.25 and got[0].put_bid is None and float(got[0].last_price) == 1041.13


def test_listings_and_bars(spark):
    listing = json.dumps({"data": {"rows": [{"symbol": "aa ", "name": "First"}, {"symbol": "AA", "name": "Second"}, {"symbol": "B^C", "name": "x"}, {"symbol": "D", "name": ""}]}, "status": {"rCode": 200}})
    got = P.listings(spark.createDataFrame([(listing,)], "body string")).collect()
    assert [(r.symbol, r["name"]) for r in got] == [("AA", "First")]
    bars = json.dumps({"data": {"tradesTable": {"rows": [{"date": "09/11/2026", "close": "$45.10", "volume": "1,000"}, {"date": "Sep 10, 2026", "close": "--"}, {"date": "2026-09-09", "close": "44"}]}}, "status": {"rCode": 200}})
    got = P.daily_bars(spark.createDataFrame([("AA", bars)], "ticker string, body string")).orderBy("ts").collect()
    assert [(str(r.ts), r.close and float(r.close), r.volume) for r in got] == [("2026-09-09", 44.0, None), ("2026-09-10", None, None), ("2026-09-11", 45.1, 1000)]


def test_day_files_and_curve(spark, tmp_path):
    with gzip.open(tmp_path / "2024-10-30.csv.gz", "wt") as f:
        f.write("ticker,volume,open,close,high,low,window_start,transactions\nO:A,20,.5,.6,.65,.5,1730260800000000000,5\nO:B,1,1,1,1,1,1730260800000000000,1\n")
    got = P.day_files(spark, f"file://{tmp_path}/*.csv.gz", spark.createDataFrame([("O:A",)], "ticker string")).collect()
    assert [(r.ticker, str(r.session), r.transactions) for r in got] == [("O:A", "2024-10-30", 5)]
    entry = lambda d, y: f"<properties><NEW_DATE>{d}T00:00:00</NEW_DATE><BC_1MONTH>{y}</BC_1MONTH><BC_1YEAR>4.0</BC_1YEAR><BC_10YEAR>4.5</BC_10YEAR></properties>"
    (tmp_path / "c.xml").write_text("<feed>" + entry("2026-09-10", 3.9) + entry("2026-09-11", 3.8) + entry("2026-09-14", 9.9) + "</feed>")
    got = P.curve(spark, f"file://{tmp_path}/c.xml", "2026-09-12").orderBy("years").collect()
    assert [str(r.day) for r in got] == ["2026-09-11"] * 3 and abs(got[1].rate - 0.0396052) < 1e-6


def test_snapshot_is_immutable_and_verified(spark, sf, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    args = (A.ticks(spark, sf), A.contracts(spark, sf), A.sessions(spark, sf), A.stocks(spark, sf), path)
    manifest = R.freeze_snapshot(spark, *args)
    assert R.verify_artifact(spark, path) == manifest
    with pytest.raises(R.ArtifactError, match="exists"):
        R.freeze_snapshot(spark, *args)
    spark.range(3).write.parquet(f"{path}/more")
    with pytest.raises(R.ArtifactError, match="tables"):
        R.verify_artifact(spark, path)
    assert R.markdown(spark.range(2), ["id"]).count("\n") == 3


def test_two_payloads_of_one_ticker_keep_their_own_headers(spark):
    def body(*rows):
        return json.dumps({"data": {"table": {"rows": rows}}, "status": {"rCode": 200}})

    a = body({"expirygroup": "March 5, 2027"}, {"strike": "10", "c_Bid": "1"}, {"strike": "11", "c_Bid": "1"})
    b = body({"expirygroup": "April 9, 2027"}, {"strike": "20", "c_Bid": "1"})
    df = spark.createDataFrame([("ZZ", a), ("ZZ", b), ("ZZ", None)], "ticker string, body string")
    got = {(str(r.expiry), int(r.strike)) for r in P.chain(df).collect()}
    assert got == {("2027-03-05", 10), ("2027-03-05", 11), ("2027-04-09", 20)}
    none = json.dumps({"data": {"table": {"rows": None}}, "message": "No record found.", "status": {"rCode": 200}})
    assert [r.ticker for r in P.unavailable(spark.createDataFrame([("NO", none), ("ZZ", a)], "ticker string, body string")).collect()] == ["NO"]


def test_daily_frame_keeps_sound_days(spark):
    rows = [("A", "2026-01-05", 1, 10.0, 11.0, 9.0, 10.5, 5, None), ("A", "2026-01-05", 2, 10.0, 12.0, 9.0, 11.5, 6, 2.0), ("A", "2026-01-06", 1, 10.0, 9.5, 9.0, 9.2, 5, None), ("A", "2026-01-07", 1, 10.0, float("inf"), 9.0, 9.2, 5, None), ("A", "2026-01-08", 1, None, 11.0, 9.0, 10.0, 5, None)]
    df = spark.createDataFrame(rows, "ticker string, ts string, seq int, open double, high double, low double, close double, volume long, split double")
    got = P.daily_frame(df).collect()
    assert [(r.ts, r.close, r.split) for r in got] == [("2026-01-05", 11.5, 2.0)]
    assert {(r.ts, r.close) for r in P.first_positive_close(df).collect()} == {("2026-01-05", 10.5), ("2026-01-06", 9.2), ("2026-01-07", 9.2), ("2026-01-08", 10.0)}


def test_one_exhibit(spark):
    listing = lambda *names: json.dumps({"directory": {"item": [{"name": n, "type": ""} for n in names]}})
    df = spark.createDataFrame([(1, listing("main.htm", "q3ex991.htm")), (2, listing("a_ex99-1.htm", "b_ex991.htm")), (3, listing("main.htm")), (4, None)], "i int, j string")
    assert {r.i: r.x for r in df.select("i", P.exhibit(df["j"]).alias("x")).collect()} == {1: "q3ex991.htm", 2: None, 3: None, 4: None}


def test_a_second_writer_loses(spark, tmp_path):
    path = f"file://{tmp_path}/made"
    R.write_artifact({"t": spark.range(3)}, path, {})
    stage = f"file://{tmp_path}/other"
    spark.range(2).write.parquet(stage)
    with pytest.raises(R.ArtifactError, match="can't be made"):
        R.publish(spark, stage, path)
    assert R.verify_artifact(spark, path)["tables"]["t"]["rows"] == 3
    victim = next((tmp_path / "made" / "t").glob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    (tmp_path / "made" / "t" / f".{victim.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match=r"t is|footer|Parquet"):
        R.verify_artifact(spark, path)
