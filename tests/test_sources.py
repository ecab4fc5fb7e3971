"""Round trips through files."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators.bars import OHLCV, drop_date_prefix, require_rows
from barspark.sources import bar_files as B
from barspark.sources import results as R
from tests.conftest import same, to_pandas, to_spark, walk


@pytest.fixture(scope="module")
def frame():
    return walk(400, 3, start="2024-12-31 20:00", minutes=1)


def test_bar_csv_round_trip(spark, frame, tmp_path):
    B.write_bars_csv(to_spark(spark, frame), str(tmp_path / "out"), files=3)
    back = to_pandas(B.read_bars(spark, str(tmp_path / "out"), "A"))
    same(back, frame.round(6), OHLCV, 1e-9)
    assert list(back.ts) == list(frame.ts)
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    heads = [p.read_text().splitlines()[1].split(";")[0] for p in parts]
    assert len(parts) == 3 and heads == sorted(heads)


def _year_file(folder, year, rows):
    (folder / f"X_{year}.csv").write_text("Date ;Open;High;Low;Close;Volume\n" + "\n".join(rows) + "\n")


def test_years_duplicates_and_bad_rows(spark, tmp_path):
    _year_file(tmp_path, 2023, ["2023.01.02 00:00;1;2;0.5;1.5;10", "2023.01.02 00:00;9;9;9;9;9", "nonsense;1;2;1;1;1", "2023.01.02 00:01;x;2;1;1;1"])
    _year_file(tmp_path, 2024, ["2024.01.02 00:00;2;3;1;2;5"])
    both = to_pandas(B.read_bars(spark, str(tmp_path / "*.csv"), "A"))
    assert list(both.open) == [1.0, 2.0]
    one = B.read_bars(spark, str(tmp_path / "*.csv"), "A", years=[2024])
    assert [r["open"] for r in one.collect()] == [2.0]
    with pytest.raises(ValueError):
        B.read_bars(spark, str(tmp_path / "*.csv"), "A", years=[1999])


def test_strict_load_rejects_rule_breaks(spark, tmp_path):
    _year_file(tmp_path, 2023, ["2023.01.02 00:00;1;0.5;2;1.5;10", "2023.01.02 00:01;1;2;0.5;1;10"])
    with pytest.raises(ValueError, match="high_below_low"):
        B.read_bars(spark, str(tmp_path), "A")
    assert B.read_bars(spark, str(tmp_path), "A", strict=False).count() == 1


def test_round_trip_of_hours_that_break_price_rules(spark, tmp_path):
    """Hours with a value of zero or below come back; the query failed on the first one."""
    from barspark.catalog import CATALOG

    values = [1.5, 0.0, 3.0, -0.0, -2.25, 4.0, 5.0]
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=25 * k), "click", v) for k, v in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = CATALOG["bar_file_round_trip"].build(spark, str(tmp_path)).orderBy("ts").collect()
    assert [tuple(r[c] for c in OHLCV) for r in got] == [(1.5, 3.0, 0.0, 3.0, 3.0), (0.0, 0.0, -2.25, -2.25, 2.0), (4.0, 5.0, 4.0, 5.0, 2.0)]
    B.write_bars_csv(events.selectExpr("ts", *[f"value AS {c}" for c in OHLCV[:4]], "1.0 AS volume"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="n_nonpositive_price = 3"):
        B.read_bars(spark, str(tmp_path / "out"), "A")
    assert B.read_bars(spark, str(tmp_path / "out"), "A", strict=False).count() == 4


def test_by_year(spark, frame, tmp_path):
    B.write_bars_by_year(to_spark(spark, frame), str(tmp_path / "y"))
    assert sorted(p.name for p in (tmp_path / "y").glob("year=*")) == ["year=2024", "year=2025"]
    got = B.read_bars_by_year(spark, str(tmp_path / "y"), [2025])
    assert got.count() == (frame.ts.dt.year == 2025).sum()
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "text, first",
    [
        ("Date;Time;O;H;L;C;Vol\n2024-01-02;10:00;1,5;2;1;1,7;3\n2024-01-02;10:01;1;2;1;1;\n", 1.5),
        ("2024-01-02\t10:00\t1.5\t2\t1\t1.7\t3\n2024-01-02\t10:01\t1\t2\t1\t1\t4\n", 1.5),
        ("datetime,open,high,low,close,not_volume,volume\n02.01.2024 10:00,1.5,2,1,1.7,9,3\n02.01.2024 10:01,1,2,1,1,9,4\n", 1.5),
        ("2024-01-02 10:00 1.5 2 1 1.7 3\n2024-01-02 10:01 1 2 1 1 4\n", 1.5),
    ],
)
def test_foreign_layouts(spark, tmp_path, text, first):
    (tmp_path / "in.txt").write_text(text)
    got = to_pandas(B.normalize_bars(spark, str(tmp_path / "in.txt"), "A"))
    assert list(got.ts) == [pd.Timestamp("2024-01-02 10:00"), pd.Timestamp("2024-01-02 10:01")]
    assert got.open.iloc[0] == first and got.volume.iloc[0] == 3 and got.volume.notna().all()


def test_each_file_has_its_own_layout(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n \nDate;Time;O;H;L;C;Vol\n03.02.2024;10:00;1,5;2;1;1,7;3\n05.02.2024;10:01;1;2;1;1;\n")
    (tmp_path / "b.txt").write_text("v|close|low|high|open|datetime\n4|1.7|1|2|1.25|02/13/2024 10:00\n5|1|1|2|1|02/03/2024 10:00\n")
    (tmp_path / "c.txt").write_text("2024-03-02 10:00 1.5 2 1 1.7 0\n2024-03-02 10:01:30 1 2 1 1 4\n2024-03-02 10:02 7\n")
    (tmp_path / "d.txt").write_text("")
    got = to_pandas(B.normalize_bars(spark, str(tmp_path / "*.txt"), "A")).sort_values("ts")
    # 02/03/2024 is read with the format of its own file, month first, though day first reads it as well.
    assert [str(t) for t in got.ts] == [
        "2024-02-03 10:00:00", "2024-02-03 10:00:00", "2024-02-05 10:01:00", "2024-02-13 10:00:00",
        "2024-03-02 10:00:00", "2024-03-02 10:01:30", "2024-03-02 10:02:00",
    ]
    assert sorted(got.open) == [1.0, 1.0, 1.0, 1.25, 1.5, 1.5, 7.0] and sorted(got.volume) == [0.0, 0.0, 0.0, 3.0, 4.0, 4.0, 5.0]
    given = B.normalize_bars(spark, str(tmp_path / "b.txt"), "A", layout=B.detect_layout("v|close|low|high|open|datetime"))
    assert given.count() == 2
    (tmp_path / "e.txt").write_text("Date;O;H;L;C\nnever;1;2;1;1\n")
    with pytest.raises(ValueError, match="e.txt"):
        B.normalize_bars(spark, str(tmp_path / "*.txt"), "A")
    with pytest.raises(ValueError, match="empty"):
        B.normalize_bars(spark, str(tmp_path / "d.txt"), "A")


def test_mixed_dates_fall_back_per_row(spark):
    df = spark.createDataFrame([("2024-01-02 10:00",), ("02.01.2024 11:00",), ("?",)], "d string")
    got = [r["ts"] for r in B.parse_ts_any(df, "d").collect()]
    assert [t and t.hour for t in got] == [10, 11, None]
    with pytest.raises(ValueError):
        B.parse_ts_any(df.where("d = '?'"), "d")


def test_tab_and_candle_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("2024-01-02 10:00:00\t1\t2\t1\t1.5\t7\textra\nTime\tOpen\tHigh\tLow\tClose\tVolume\n2024-01-02 10:01:00\t1\t2\n")
    assert B.read_tab_export(spark, str(tmp_path / "a.tsv"), "A").count() == 1
    (tmp_path / "b.csv").write_text("Date;O;H;L;C;V\n2024.01.02 10:00;1;2;1;1.5;7\n2024-01-02 10:01:00,1,2,1,1.5,7\nbad;1;2;3;4;5\n")
    assert B.read_candles(spark, str(tmp_path / "b.csv"), "A").count() == 2


def test_prefix_and_short_frames(spark):
    df = spark.createDataFrame([("2025.01.01",), ("2026.01.01",)], "Date string")
    assert drop_date_prefix(df, "Date", "2025.").count() == 1
    with pytest.raises(ValueError):
        require_rows(df, 3)


def test_scan_report(spark, tmp_path):
    report = {
        "Summary": {"TotalSignals": 1},
        "Signals": [
            {"WindowIndex": 31, "EntryTime": "2026-01-07 11:20:00", "EntryPrice": "4462.465", "ExitTime": "2026-01-07 11:30:00", "Outcome": "Loss", "ProfitLoss": "-2,96586", "Probability": "70,37%", "AtrM5": "2.96586"}
        ],
    }
    (tmp_path / "r.json").write_text(json.dumps(report, indent=2))
    row = R.read_scan_report(spark, str(tmp_path / "r.json")).first()
    assert row["window_index"] == 31 and row["probability"] == pytest.approx(0.7037)
    assert row["profit_loss"] == pytest.approx(-2.96586) and row["ts"] == pd.Timestamp("2026-01-07 11:20:00")


def test_results_and_report_sinks(spark, tmp_path):
    sig = spark.sql(
        "SELECT timestamp_ntz'2024-01-02 10:00' entry_ts, 10.5D entry_price, timestamp_ntz'2024-01-02 11:00' exit_ts, 11.5D exit_price,"
        " 9D sl_price, 11.5D tp_price, 'Win' outcome, 1.0D profit_loss, 0.715D probability, 0.5D atr"
    )
    R.write_scan_report(sig, str(tmp_path / "rep"), threshold=0.6)
    back = R.read_scan_report(spark, str(tmp_path / "rep" / "signals")).first()
    assert back["entry_price"] == 10.5 and back["probability"] == pytest.approx(0.715) and back["outcome"] == "Win"
    summary = spark.read.json(str(tmp_path / "rep" / "summary")).first()
    assert summary["WonTrades"] == 1 and summary["WinRate"] == "100.00%" and summary["TotalProfitLoss"] == "1"
    R.write_results(sig, sig, sig.agg(F.count("*").alias("n")), str(tmp_path / "res"))
    assert spark.read.csv(str(tmp_path / "res" / "trades"), header=True).count() == 1
    B.write_features(to_spark(spark, walk(50, 1)).select("symbol", "ts", "volume"), to_spark(spark, walk(50, 1)), str(tmp_path / "f"))
    assert "price" in spark.read.parquet(str(tmp_path / "f")).columns
