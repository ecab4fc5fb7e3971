"""One-call indicators: DataFrame in, the same rows with the indicator's columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.study import Study
from barspark.plans.scan import running


def _single(build: Callable[..., str]) -> Callable[..., DataFrame]:
    def run(bars: DataFrame, *args, out: str, keys=("symbol",), ts="ts", chunk_rows=None, **kw) -> DataFrame:
        study = Study()
        study.out(out, build(study, *args, **kw))
        return study.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)

    run.__doc__ = build.__doc__
    return run


def _several(build: Callable[..., tuple[str, ...]]) -> Callable[..., DataFrame]:
    def run(bars: DataFrame, *args, out: tuple[str, ...], keys=("symbol",), ts="ts", chunk_rows=None, **kw) -> DataFrame:
        study = Study()
        for name, col in zip(out, build(study, *args, **kw), strict=True):
            study.out(name, col)
        return study.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)

    run.__doc__ = build.__doc__
    return run


ema = _single(Study.ema)
sma = _single(Study.mean)
rsi = _single(Study.rsi)
cci = _single(Study.cci)
williams_r = _single(Study.williams_r)
true_range = _single(Study.true_range)
atr = _single(Study.atr)
atr_norm = _single(Study.atr_norm)
bb_position = _single(Study.bb_position)
dist_sma_atr = _single(Study.dist_sma_atr)
roc = _single(Study.roc)
volatility = _single(Study.std)
mfi = _single(Study.mfi)
rolling_zscore = _single(Study.zscore)
volume_norm = _single(Study.volume_norm)
new_high_volume_divergence = _single(Study.new_high_divergence)
log_return = _single(Study.log_return)

stochastic = _several(Study.stochastic)
adx = _several(Study.adx)
macd = _several(Study.macd)
bollinger = _several(Study.bollinger)
price_volume_divergence = _several(Study.price_volume_divergence)


def range_atr(bars: DataFrame, n: int = 14, *, out: str = "range_atr", keys=("symbol",), ts="ts", chunk_rows=None) -> DataFrame:
    """Highest high minus lowest low over n full rows."""
    study = Study()
    hi, lo = study.top("high", n, full=True), study.low("low", n, full=True)
    study.out(out, study.calc("_range", [hi, lo], lambda: F.col(hi) - F.col(lo)))
    return study.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)


def _cumulative(bars: DataFrame, step: Callable[[Study], str], out: str, keys, ts, chunk_rows) -> DataFrame:
    study = Study()
    study.out("_step", step(study))
    stepped = study.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)
    return running(stepped, {out: ("sum", "_step")}, keys=keys, ts=ts).drop("_step")


def obv(bars: DataFrame, *, out: str = "obv", keys=("symbol",), ts="ts", chunk_rows=None) -> DataFrame:
    """Cumulative signed volume with its true level (two-level running sum)."""
    return _cumulative(bars, Study.obv_step, out, keys, ts, chunk_rows)


def cvd(bars: DataFrame, *, out: str = "cvd", keys=("symbol",), ts="ts", chunk_rows=None) -> DataFrame:
    """Cumulative volume delta with its true level."""
    return _cumulative(bars, Study.cvd_step, out, keys, ts, chunk_rows)


def obv_z(bars: DataFrame, n: int = 50, *, out: str = "obv_z", keys=("symbol",), ts="ts", chunk_rows=None) -> DataFrame:
    study = Study()
    study.out(out, study.flow_zscore(study.obv_step(), n))
    return study.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)


def cvd_z(bars: DataFrame, n: int = 50, *, out: str = "cvd_z", keys=("symbol",), ts="ts", chunk_rows=None) -> DataFrame:
    study = Study()
    study.out(out, study.flow_zscore(study.cvd_step(), n))
    return study.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)
