"""Round trips: bars of a shared table are written in a file layout and read back by the file readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.catalog.base import D_SQL, hourly, order_days, query, ticks
from barspark.operators.bars import OHLCV, rollup_bars
from barspark.session import run_folder
from barspark.sources import bar_files as B

_ALL_SQL = """a AS (
  SELECT 'ALL' AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 2)"""


def _folder(spark: SparkSession) -> str:
    return f"{run_folder(spark)}/files-{uuid.uuid4().hex}"


def _all_hours(spark, d) -> DataFrame:
    """Hourly bars over all events as one series."""
    return rollup_bars(ticks(spark, d).withColumn("symbol", F.lit("ALL")), "1 hour", tie="tie")


def _text(bars: DataFrame, date: str, **cells: str) -> DataFrame:
    """Text columns in the given order and names; a repr of a double reads back as itself."""
    picked = [F.col(c).cast("string").alias(name) for name, c in cells.items()]
    return bars.select(F.date_format("ts", date).alias("datetime"), *picked)


@query("bar_file_round_trip", f"WITH {_ALL_SQL} SELECT * FROM a", "open high low close volume", digits=5)
def _own_layout(spark, d):
    """Values of events are no prices: some are zero, and their hours come back like all others."""
    path = _folder(spark)
    B.write_bars_csv(_all_hours(spark, d), path)
    return B.read_bars(spark, path, "ALL", rules=False).select("symbol", "ts", *OHLCV)


@query("foreign_file_round_trip", f"WITH {_ALL_SQL} SELECT * FROM a", "open high low close volume")
def _foreign_layouts(spark, d):
    """Files of three layouts, each with its own separator, header, column order and date format, in one read."""
    path, bars = _folder(spark), _all_hours(spark, d)
    third = F.pmod(F.day("ts"), F.lit(3))
    names = {c: c for c in OHLCV}
    _text(bars.where(third == 0), "MM/dd/yyyy HH:mm", **dict(reversed(names.items()))).write.csv(f"{path}/a", sep="|", header=True)
    _text(bars.where(third == 1), "dd.MM.yyyy HH:mm", o="open", h="high", l="low", c="close", vol="volume").write.csv(
        f"{path}/b", sep=";", header=True
    )
    _text(bars.where(third == 2), "yyyy-MM-dd HH:mm:ss", **names).write.csv(f"{path}/c", sep="\t")
    return B.normalize_bars(spark, f"{path}/*", "ALL")


@query("tab_export_round_trip", f"WITH {_ALL_SQL} SELECT * FROM a", "open high low close volume")
def _tab(spark, d):
    path = _folder(spark)
    _text(_all_hours(spark, d), "yyyy-MM-dd HH:mm:ss", **{c: c for c in OHLCV}).write.csv(path, sep="\t", header=True)
    return B.read_tab_export(spark, path, "ALL")


@query("candle_file_round_trip", f"WITH {_ALL_SQL} SELECT * FROM a", "open high low close volume")
def _candles(spark, d):
    path, bars = _folder(spark), _all_hours(spark, d)
    cells = {c: c for c in OHLCV}
    early = F.hour("ts") < 12
    _text(bars.where(early), B.BAR_DATE, **cells).write.csv(f"{path}/a", sep=";", header=True)
    _text(bars.where(~early), "yyyy-MM-dd HH:mm:ss", **cells).write.csv(f"{path}/b", header=True)
    return B.read_candles(spark, f"{path}/*", "ALL")


@query("year_folders", f"WITH {D_SQL} SELECT symbol, ts, open, high, low, close, volume FROM d WHERE year(ts) IN (1995, 1996)", "open high low close")
def _years(spark, d):
    path = _folder(spark)
    B.write_bars_by_year(order_days(spark, d), path)
    return B.read_bars_by_year(spark, path, [1995, 1996]).select("symbol", "ts", *OHLCV)


@query(
    "feature_table",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, max(value) - min(value) AS spread, arg_max(value, (ts, event_id)) AS price
    FROM events GROUP BY 1, 2""",
    "spread price",
)
def _feature_table(spark, d):
    path, bars = _folder(spark), hourly(spark, d)
    spread = (F.col("high") - F.col("low")).alias("spread")
    B.write_features(bars.select("symbol", "ts", spread), bars, path)
    return spark.read.parquet(path)
