"""Named queries over the shared tables, each with its SQL twin, and the frames they start from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators.bars import rollup_bars, ticks_as_bars

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


CATALOG: dict[str, Query] = {}


def _nudge(digits: int) -> float:
    """Added before rounding on both sides, so an exact half is not decided by the last bit."""
    return 0.00371 * 10.0**-digits


def _rounded(col: str, digits: int) -> Column:
    r = F.round(F.col(col) + F.lit(_nudge(digits)), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6) -> Callable[[Build], Build]:
    """Register a query. ``doubles`` are rounded on both sides before they are compared."""
    cols = doubles.split()

    def wrap(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(spark, sf_dir)
            return out.withColumns({c: _rounded(c, digits) for c in cols}) if cols else out

        text = sql
        if sql is not None and cols:
            def side(c: str) -> str:
                r = f"round({c} + {_nudge(digits)!r}::DOUBLE, {digits})"
                return f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END AS {c}"

            parts = ", ".join(side(c) for c in cols)
            text = f"SELECT * REPLACE ({parts}) FROM ({sql}) AS q_"
        if name in CATALOG:
            raise ValueError(f"query registered twice: {name}")
        CATALOG[name] = Query(name, run, text)
        return build

    return wrap


# -- starting frames -------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_as_bars(table(spark, sf_dir, "events"), symbol="event_type", ts="ts", price="value", tie="event_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_bars(ticks(spark, sf_dir), "1 hour", tie="tie")


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices per priority."""
    rows = ticks_as_bars(
        table(spark, sf_dir, "orders"), symbol="o_orderpriority", ts="o_orderdate", price="o_totalprice", tie="o_orderkey"
    )
    return rollup_bars(rows, "1 day", tie="tie")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: probability from the value, label from the k property."""
    p = F.round(F.least(F.col("value") / 200, F.lit(1.0)), 6)
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "event_id",
        p.alias("probability"),
        (k > 50).cast("int").alias("label"),
        (p >= 0.5).cast("int").alias("prediction"),
    )


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as finished trades of three strategies (return flags)."""
    entry = F.round(F.col("l_extendedprice") / F.col("l_quantity") + 1e-9, 4)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("strategy"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        entry.alias("entry_price"),
        F.lit(0.01).alias("position_size"),
        F.round(entry * (F.col("l_discount") - F.col("l_tax")) + 1e-6, 2).alias("pnl"),
    )


# -- the same frames in SQL ------------------------------------------------------------------------

H_SQL = """h AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""

D_SQL = """d AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS ts, first(o_totalprice ORDER BY o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close,
         count(*)::DOUBLE AS volume
  FROM orders GROUP BY 1, 2)"""

P_SQL = """p AS (
  SELECT event_type AS symbol, ts, event_id, round(least(value / 200, 1.0), 6)::DOUBLE AS probability,
         (regexp_extract(props, '"k": ([0-9]+)', 1)::INTEGER > 50)::INTEGER AS label,
         (round(least(value / 200, 1.0), 6) >= 0.5)::INTEGER AS prediction
  FROM events)"""

S_SQL = """s AS (
  SELECT l_returnflag AS strategy, l_shipdate AS ts, l_orderkey, l_linenumber,
         round(l_extendedprice / l_quantity + 1e-9::DOUBLE, 4) AS entry_price, 0.01::DOUBLE AS position_size,
         round(round(l_extendedprice / l_quantity + 1e-9::DOUBLE, 4) * (l_discount - l_tax) + 1e-6::DOUBLE, 2) AS pnl
  FROM lineitem)"""


def rows(n: int) -> str:
    """SQL window over the current row and the n-1 before it."""
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


O = "(PARTITION BY symbol ORDER BY ts)"
