"""Writing trades, equity, metrics and scan reports; reading scan reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators.metrics import scan_summary

# Field names of a scan report's signals.
SIGNAL_FIELDS = (
    "EntryTime EntryPrice ExitTime ExitPrice StopLoss TakeProfit Outcome ProfitLoss Probability Threshold Confidence "
    "AtrM5 SlAtrMultiplier TpAtrMultiplier RiskRewardRatio ExpectedWinRate"
).split()
PERCENTS = ("Probability", "Threshold", "ExpectedWinRate")
NUMBERS = ("EntryPrice", "ExitPrice", "StopLoss", "TakeProfit", "ProfitLoss", "AtrM5", "SlAtrMultiplier", "TpAtrMultiplier", "RiskRewardRatio")


def write_results(trades: DataFrame, equity: DataFrame, metrics: DataFrame, folder: str, *, mode: str = "error") -> None:
    """trades and equity as CSV folders, metrics as JSON."""
    trades.write.mode(mode).csv(f"{folder}/trades", header=True)
    equity.write.mode(mode).csv(f"{folder}/equity", header=True)
    metrics.write.mode(mode).json(f"{folder}/metrics")


def _plain(c: Column, digits: int = 5) -> Column:
    """Rounded number as text without trailing zeros."""
    text = F.format_string(f"%.{digits}f", c)
    return F.when(c.isNotNull(), F.regexp_replace(text, r"\.?0+$", ""))


def _percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.format_string("%.2f", c * 100), F.lit("%")))


def write_scan_report(signals: DataFrame, folder: str, *, threshold: float, mode: str = "error") -> None:
    """Summary (one JSON row) and signals (JSON lines, written in parallel) with text numbers."""
    s = scan_summary(signals)
    s.select(
        F.col("total_signals").alias("TotalSignals"),
        F.col("won_trades").alias("WonTrades"),
        F.col("lost_trades").alias("LostTrades"),
        F.col("pending_trades").alias("PendingTrades"),
        F.col("timeout_trades").alias("TimeoutTrades"),
        _percent(F.col("win_rate")).alias("WinRate"),
        _percent(F.col("profitability_rate")).alias("ProfitabilityRate"),
        _plain(F.col("total_profit_loss")).alias("TotalProfitLoss"),
        _plain(F.col("average_win")).alias("AverageWin"),
        _plain(F.col("average_loss")).alias("AverageLoss"),
        _percent(F.lit(float(threshold))).alias("ModelThreshold"),
        F.current_timestamp().alias("GeneratedAt"),
    ).write.mode(mode).json(f"{folder}/summary")
    time = "yyyy-MM-dd HH:mm:ss"
    signals.select(
        F.date_format("entry_ts", time).alias("EntryTime"),
        _plain(F.col("entry_price")).alias("EntryPrice"),
        F.date_format("exit_ts", time).alias("ExitTime"),
        _plain(F.col("exit_price")).alias("ExitPrice"),
        _plain(F.col("sl_price")).alias("StopLoss"),
        _plain(F.col("tp_price")).alias("TakeProfit"),
        F.col("outcome").alias("Outcome"),
        _plain(F.col("profit_loss")).alias("ProfitLoss"),
        _percent(F.col("probability")).alias("Probability"),
        _plain(F.col("atr")).alias("AtrM5"),
    ).write.mode(mode).json(f"{folder}/signals")


def local_number(c: Column) -> Column:
    """Number from text with a decimal comma and an optional percent sign (percent stays in percent)."""
    return F.regexp_replace(F.rtrim(F.regexp_replace(c, "%", "")), ",", ".").try_cast("double")


def read_scan_report(spark: SparkSession, path: str) -> DataFrame:
    """Signals of a nested report file, or of a signals folder, with typed columns.

    Percent fields become shares.
    """
    signal = T.StructType([T.StructField("WindowIndex", T.LongType())] + [T.StructField(f, T.StringType()) for f in SIGNAL_FIELDS])
    report = T.StructType([T.StructField("Signals", T.ArrayType(signal))] + list(signal.fields))
    raw = spark.read.schema(report).json(path, multiLine=not path.rstrip("/").endswith("signals"))
    own = F.struct(*[F.col(f.name) for f in signal.fields])
    rows = raw.select(F.explode(F.when(F.col("Signals").isNull(), F.array(own)).otherwise(F.col("Signals"))).alias("s")).select("s.*")
    names = {
        "EntryTime": "ts",
        "EntryPrice": "entry_price",
        "ExitTime": "exit_ts",
        "ExitPrice": "exit_price",
        "StopLoss": "sl_price",
        "TakeProfit": "tp_price",
        "Outcome": "outcome",
        "ProfitLoss": "profit_loss",
        "Probability": "probability",
        "Threshold": "threshold",
        "Confidence": "confidence",
        "AtrM5": "atr",
        "SlAtrMultiplier": "sl_multiplier",
        "TpAtrMultiplier": "tp_multiplier",
        "RiskRewardRatio": "rr",
        "ExpectedWinRate": "expected_win_rate",
    }

    def typed(field: str) -> Column:
        c = F.col(field)
        if field in PERCENTS:
            return local_number(c) / 100
        if field in NUMBERS:
            return local_number(c)
        if field in ("EntryTime", "ExitTime"):
            return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
        return c

    return rows.select(F.col("WindowIndex").alias("window_index"), *[typed(f).alias(n) for f, n in names.items()])
