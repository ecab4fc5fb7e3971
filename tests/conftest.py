from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from barspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "barspark-tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(n: int, seed: int, start: str = "2024-01-02", minutes: int = 1, base: float = 1800.0, symbol: str = "A") -> pd.DataFrame:
    """Random-walk bars with gaps at night-like places (every 97th bar is missing)."""
    rng = np.random.default_rng(seed)
    close = base + np.cumsum(rng.normal(0, 0.5, n))
    high = close + np.abs(rng.normal(0, 0.3, n))
    low = close - np.abs(rng.normal(0, 0.3, n))
    frame = pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range(start, periods=n, freq=f"{minutes}min"),
            "open": close + rng.normal(0, 0.2, n),
            "high": high,
            "low": low,
            "close": close,
            "volume": np.floor(np.abs(rng.normal(0, 1000, n))) + 5000,
        }
    )
    return frame[np.arange(n) % 97 != 96].reset_index(drop=True)


def to_spark(spark, frame: pd.DataFrame):
    df = spark.createDataFrame(frame)
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, df[name].cast("timestamp_ntz"))
    return df


def to_pandas(df, *by: str) -> pd.DataFrame:
    by = by or ("symbol", "ts")
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame, cols, tol: float = 1e-9) -> None:
    assert len(a) == len(b)
    for c in cols:
        x, y = a[c].astype(float).to_numpy(), b[c].astype(float).to_numpy()
        assert (np.isnan(x) == np.isnan(y)).all(), c
        gap = np.nanmax(np.abs(x - y) / np.maximum(1.0, np.abs(y))) if len(x) else 0.0
        assert gap <= tol, (c, gap)
