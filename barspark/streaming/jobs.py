"""Structured Streaming forms of the bar, signal and position steps.

Event time must be TIMESTAMP here (a watermark on TIMESTAMP_NTZ is refused), in a UTC session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Fixed values of the live rules.
MIN_PROBABILITY, MIN_MINUTES, CLOSE_TIME, MARKET_ZONE, EXTRA_MINUTES = 0.70, 10.0, "23:00", "Europe/Warsaw", 5.0


def event_time(stream: DataFrame, ts: str = "ts") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_bars(
    ticks: DataFrame, width: str, delay: str, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", tie: str | None = None
) -> DataFrame:
    """Closed bars of a tick or bar stream; in append mode a bar comes out when the watermark passes it."""
    rank = F.struct(ts, tie) if tie else F.col(ts)
    rolled = (
        event_time(ticks, ts)
        .withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, width).alias("_w"))
        .agg(
            F.min_by("open", rank).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", rank).alias("close"),
            F.sum("volume").alias("volume"),
        )
    )
    return rolled.select(*keys, F.col("_w.start").alias("ts"), F.col("_w.end").alias("bar_end"), "open", "high", "low", "close", "volume")


def stream_dedup(stream: DataFrame, delay: str, *, keys: Sequence[str] = ("symbol", "ts"), ts: str = "ts") -> DataFrame:
    """Drop rows later than the watermark and repeats of a key inside it."""
    return event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def incomplete_bars(bars: DataFrame, expected_rows: Column, count: str = "volume") -> DataFrame:
    """Closed bars built from fewer rows than expected: to be logged, not traded."""
    return bars.where(F.col(count) < expected_rows)


def stream_gate(
    scored: DataFrame,
    p_min: float = MIN_PROBABILITY,
    close_time: str = CLOSE_TIME,
    *,
    min_minutes: float = MIN_MINUTES,
    zone: str = MARKET_ZONE,
    ts: str = "ts",
    minutes: str = "expected_minutes",
) -> DataFrame:
    """Signals sure enough, long enough and done before the market closes (local time)."""
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    close = F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd "), F.lit(close_time)), "yyyy-MM-dd HH:mm")
    left = (F.unix_micros(close) - F.unix_micros(local)) / 60_000_000.0
    return scored.where(
        (F.col("probability") >= p_min) & (F.col(minutes) > min_minutes) & (F.col(minutes) <= left)
    )


def _ms(value: Any) -> int:
    return int(pd.Timestamp(value).value // 1_000_000)


class _SignalLife(StatefulProcessor):
    """One open signal per key: ended by a lower probability or by its time."""

    def __init__(self, p_min: float, extra: float) -> None:
        self.p_min, self.extra = p_min, extra

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "signal_ms long, until_ms long, probability double")

    def _out(self, key, signal_ms: int, at_ms: int, state: str, p: float) -> tuple:
        return (*key, pd.Timestamp(signal_ms, unit="ms"), pd.Timestamp(at_ms, unit="ms"), state, p)

    def _close(self, key, at_ms: int, state: str, p: float) -> tuple:
        signal_ms, until_ms, _ = self.open.get()
        self.open.clear()
        self.handle.deleteTimer(until_ms)
        return self._out(key, signal_ms, at_ms, state, p)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines = []
        # Rows of one key in one micro-batch.
        for row in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            at, p = _ms(row.ts), float(row.probability)
            if self.open.exists():
                _, until, _ = self.open.get()
                if at >= until:
                    lines.append(self._close(key, until, "expired", p))
                elif p < self.p_min:
                    lines.append(self._close(key, at, "cancelled", p))
            if not self.open.exists() and bool(row.is_signal):
                until = at + int((float(row.expected_minutes) + self.extra) * 60_000)
                self.open.update((at, until, p))
                self.handle.registerTimer(until)
                lines.append(self._out(key, at, at, "active", p))
        yield pd.DataFrame(lines, columns=["symbol", "signal_ts", "event_ts", "state", "probability"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lines = []
        if self.open.exists():
            signal_ms, until, p = self.open.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                lines.append(self._out(key, signal_ms, until, "expired", p))
        yield pd.DataFrame(lines, columns=["symbol", "signal_ts", "event_ts", "state", "probability"])

    def close(self) -> None:
        pass


def stream_signal_life(
    scored: DataFrame, delay: str = "10 minutes", *, p_min: float = MIN_PROBABILITY, extra: float = EXTRA_MINUTES, ts: str = "ts"
) -> DataFrame:
    """Signal events (active, cancelled, expired) from scored rows.

    Rows carry symbol, ts, probability, expected_minutes and ``is_signal`` (passed the gate).
    """
    slim = event_time(scored, ts).select(
        "symbol", F.col(ts).alias("ts"), "probability", "expected_minutes", F.col("is_signal").cast("boolean").alias("is_signal")
    )
    return slim.withWatermark("ts", delay).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_SignalLife(p_min, extra),
        outputStructType="symbol string, signal_ts timestamp, event_ts timestamp, state string, probability double",
        outputMode="append",
        timeMode="eventTime",
    )


_POSITION_OUT = (
    "symbol string, position_id string, entry_ts timestamp, entry_price double, exit_ts timestamp, exit_price double, "
    "reason string, pnl double, predicted_rr double, actual_rr double, probability double"
)
_POSITION_COLS = [c.strip().split(" ")[0] for c in _POSITION_OUT.split(",")]


class _Positions(StatefulProcessor):
    """Open positions of a key, checked against each later bar (stop first on a tie)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState(
            "open", "position_id string", "entry_ms long, entry double, sl double, tp double, probability double"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "kind"])
        lines = []
        for row in frame.itertuples(index=False):
            at = _ms(row.ts)
            if row.kind == "position":
                self.open.updateValue(
                    (row.position_id,), (at, float(row.entry_price), float(row.sl_price), float(row.tp_price), float(row.probability))
                )
                continue
            for (pid,), (entry_ms, entry, sl, tp, p) in list(self.open.iterator()):
                if at <= entry_ms:
                    continue
                if row.low <= sl:
                    price, reason = sl, "stop"
                elif row.high >= tp:
                    price, reason = tp, "target"
                else:
                    continue
                self.open.removeKey((pid,))
                risk = entry - sl
                lines.append(
                    (
                        key[0], pid, pd.Timestamp(entry_ms, unit="ms"), entry, pd.Timestamp(at, unit="ms"), price, reason,
                        price - entry, (tp - entry) / risk if risk else None, (price - entry) / risk if risk else None, p,
                    )
                )
        yield pd.DataFrame(lines, columns=_POSITION_COLS)

    def close(self) -> None:
        pass


def stream_positions(positions: DataFrame, bars: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Closed positions with reason and result, from a stream of opened positions and a stream of bars."""
    empty = {c: F.lit(None).cast("double") for c in ("entry_price", "sl_price", "tp_price", "probability")}
    cols = ["symbol", "ts", "kind", "position_id", "entry_price", "sl_price", "tp_price", "probability", "high", "low"]
    opened = event_time(positions, ts).withColumns(
        {"kind": F.lit("position"), "high": F.lit(None).cast("double"), "low": F.lit(None).cast("double")}
    )
    moved = event_time(bars, ts).withColumns({**empty, "kind": F.lit("bar"), "position_id": F.lit(None).cast("string")})
    both = opened.select(*cols).unionByName(moved.select(*cols)).withWatermark("ts", delay)
    return both.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=_Positions(), outputStructType=_POSITION_OUT, outputMode="append", timeMode="eventTime"
    )


def score_each_batch(
    score: Callable[..., DataFrame], write: Callable[[DataFrame, int], None], history: Callable[[], DataFrame], **fixed: Mapping
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: score the latest window of the symbols that got new bars.

    ``history`` returns the stored bars; only the symbols of the batch are read from it.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        touched = batch.select("symbol").distinct()
        stored = history().join(touched, "symbol", "left_semi")
        write(score(stored, **fixed), epoch)

    return run
