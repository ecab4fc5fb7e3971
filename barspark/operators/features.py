"""Feature sets: time context, minimal set, coarse context, and the two multi-width sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.calendar import cyclic
from barspark.functions.study import EPS, Study
from barspark.operators.bars import asof_align, bucket_start, prev_day, rollup_bars
from barspark.operators.quality import clean_features, with_values
from barspark.plans.chunks import Line

# Column order of the five-minute set.
M5_COLUMNS = (
    "rsi_m5 bb_pos_m5 dist_sma_20_m5 stoch_k_m5 stoch_d_m5 macd_hist_m5 atr_norm_m5 atr_m5 atr_norm_m5_native "
    "atr_m5_native atr_norm_m5_smooth atr_m5_smooth adx sma_200 cvd_m5 dist_sma_200_m5 dist_sma_200_m15 dist_sma_200 "
    "ret_1_m5 obv_m5 mfi_m5 volume_m5_norm rsi_m15 bb_pos_m15 dist_sma_20_m15 cvd_m15 obv_m15 mfi_m15 volume_m15_norm "
    "rsi_m60 bb_pos_m60 cvd_m60 obv_m60 mfi_m60 volume_roc divergence_volume_m5 divergence_volume_m5_strong "
    "divergence_volume_new_high_m5"
).split()
# Column order of the one-minute set.
M1_COLUMNS = (
    "rsi_m5 bb_pos_m5 dist_sma_20_m5 stoch_k_m5 macd_hist_m5 rsi_m15 bb_pos_m15 dist_sma_20_m15 rsi_m60 bb_pos_m60 "
    "bb_position dist_sma_20 rsi_14 ret_1 atr_14 volume_roc"
).split()
# Neutral fills.
NEUTRAL = {
    "rsi": 50.0,
    "stoch": 50.0,
    "bb": 0.5,
    "adx": 20.0,
    "atr_norm": 1.0,
    "volume_norm": 1.0,
}


@dataclass(frozen=True)
class FeatureFlags:
    """A switched-off family becomes its neutral constant; the schema stays and its work is pruned."""

    rsi: bool = True
    bb_pos: bool = True
    sma_dist: bool = True
    stoch: bool = True
    macd: bool = True
    atr: bool = True
    adx: bool = True
    cvd: bool = True
    sma200: bool = True
    returns: bool = True
    obv: bool = True
    mfi: bool = False
    volume_m5: bool = True
    volume_m15: bool = True
    m15_context: bool = True
    m60_context: bool = False


def _floor_price(bars: DataFrame, low: float = EPS) -> DataFrame:
    return bars.withColumns({c: F.greatest(F.col(c), F.lit(low)) for c in ("high", "low", "close")})


def minimal_features(
    bars: DataFrame, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", chunk_rows: int | None = None
) -> DataFrame:
    """Twelve columns on full windows; rows with an incomplete window are dropped."""
    s = Study()
    r = s.log_return("close", 1)
    s.out("ret_1", r)
    s.out("ret_5", s.log_return("close", 5))
    s.out("ret_15", s.log_return("close", 15))
    s.out("vol_20", s.std(r, 20, full=True))
    s.out("vol_60", s.std(r, 60, full=True))
    s.calc("range_n", ["high", "low", "close"], lambda: F.try_divide(F.col("high") - F.col("low"), F.col("close")), keep=True)
    s.out("mom_10", s.mean(r, 10, full=True))
    s.out("mom_30", s.mean(r, 30, full=True))
    line, _, _ = s.macd("close", 12, 26, 9)
    s.calc("ema_spread_n", [line, "close"], lambda: F.try_divide(F.col(line), F.col("close")), keep=True)
    s.out("rsi_14", s.rsi("close", 14, full=True))
    sin, cos = cyclic(F.hour(ts) * 60 + F.minute(ts), 1440)
    s.calc("tod_sin", [], lambda: sin, keep=True)
    s.calc("tod_cos", [], lambda: cos, keep=True)
    cols = ["ret_1", "ret_5", "ret_15", "vol_20", "vol_60", "range_n", "mom_10", "mom_30", "ema_spread_n", "rsi_14", "tod_sin", "tod_cos"]
    out = s.apply(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)
    return with_values(out.select(*keys, ts, *cols), cols)


def m5_context(
    bars: DataFrame,
    *,
    width: str = "5 minutes",
    align: str = "close",
    fine_width: str = "1 minute",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Six columns from coarse bars, brought to the fine rows (plus ``atr_m5`` in price units)."""
    coarse = rollup_bars(bars, width, keys=keys, ts=ts)
    s = Study()
    # The first true range here is high - low: only later bars have a previous close.
    before = s.prev("close")
    tr = s.calc(
        "_tr0",
        [before, "high", "low"],
        lambda: F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - F.col(before)), F.abs(F.col("low") - F.col(before))
        ),
    )
    s.out("atr_m5", s.mean(tr, 14, full=True))
    d = s.diff("close")
    gain = s.calc("_gain0", [d], lambda: F.when(F.col(d).isNotNull(), F.greatest(F.col(d), F.lit(0.0))))
    loss = s.calc("_loss0", [d], lambda: F.when(F.col(d).isNotNull(), F.greatest(-F.col(d), F.lit(0.0))))
    up, down = s.mean(gain, 14, full=True), s.mean(loss, 14, full=True)
    s.calc("rsi_m5", [up, down], lambda: 100 - 100 / (1 + F.col(up) / (F.col(down) + EPS)), keep=True)
    mean = s.mean("close", 20, full=True)
    s.calc("dist_sma_20_m5", [mean, "close"], lambda: (F.col("close") - F.col(mean)) / (F.col(mean) + EPS), keep=True)
    line, _, _ = s.macd("close")
    s.calc("macd_n_m5", [line, "close"], lambda: F.col(line) / (F.col("close") + EPS), keep=True)
    s.out("bb_pos_m5", s.bb_position("close", 20, 2.0, full=True))
    cols = ["rsi_m5", "dist_sma_20_m5", "macd_n_m5", "bb_pos_m5", "atr_m5"]
    coarse = s.apply(coarse, keys=keys, ts=ts, chunk_rows=chunk_rows).select(*keys, ts, *cols)
    fills = {"rsi_m5": NEUTRAL["rsi"], "bb_pos_m5": NEUTRAL["bb"], "dist_sma_20_m5": 0.0, "macd_n_m5": 0.0, "atr_m5": 0.0}
    out = asof_align(
        bars, coarse, cols, width, mode=align, fine_width=fine_width, fill=fills, keys=keys, ts=ts, chunk_rows=chunk_rows
    )
    return out.withColumn("atr_m5_n", F.col("atr_m5") / (F.greatest(F.col("close"), F.lit(EPS)) + EPS))


def day_features(
    bars: DataFrame, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", chunk_rows: int | None = None
) -> DataFrame:
    """Time encodings and distances to the day's open, session open, extremes and prior day; long means.

    Chunks hold whole days, so day windows stay inside a chunk and need no further shuffle.
    """
    close = F.col("close")

    def gap(level: Column) -> Column:
        return (close - level) / (level + EPS)

    withprev = prev_day(bars, keys=keys, ts=ts, chunk_rows=chunk_rows)
    s = Study()

    def day(line: Line, running: bool = True):
        spec = Window.partitionBy(*line.part, "_day").orderBy(*line.order)
        return spec.rowsBetween(Window.unboundedPreceding, 0) if running else spec.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )

    s.put("_day", [], lambda line: F.to_date(ts))
    is_open = (F.hour(ts) == 8) & (F.minute(ts) == 0)
    first = s.put("_day_open", ["_day"], lambda line: F.first("open").over(day(line)))
    london = s.put("_london", ["_day"], lambda line: F.last(F.when(is_open, F.col("open")), ignorenulls=True).over(day(line)))
    high = s.put("_day_high", ["_day"], lambda line: F.max("high").over(day(line)))
    low = s.put("_day_low", ["_day"], lambda line: F.min("low").over(day(line)))
    for name, (part, period) in {"hour": (F.hour(ts), 24), "minute": (F.minute(ts), 60)}.items():
        sin, cos = cyclic(part, period)
        s.calc(f"{name}_sin", [], lambda sin=sin: sin, keep=True)
        s.calc(f"{name}_cos", [], lambda cos=cos: cos, keep=True)
    s.calc("dist_daily_open", [first], lambda: gap(F.col(first)), keep=True)
    s.calc("dist_london_open", [london], lambda: F.coalesce(gap(F.col(london)), F.lit(0.0)), keep=True)
    for c in ("high", "low", "close"):
        s.calc(f"dist_prev_{c}", [], lambda c=c: F.coalesce(gap(F.col(f"prev_{c}")), F.lit(0.0)), keep=True)
    s.calc("dist_day_high", [high], lambda: gap(F.col(high)), keep=True)
    s.calc("dist_day_low", [low], lambda: gap(F.col(low)), keep=True)
    for n in (200, 1440):
        mean = s.mean("close", n)
        s.calc(f"dist_sma_{n}", [mean], lambda mean=mean: gap(F.col(mean)), keep=True)
    before = s.prev("close", 60)
    s.calc(
        "roc_60", [before], lambda: F.coalesce((close - F.col(before)) / (F.col(before) + EPS), F.lit(0.0)), keep=True
    )
    r = s.log_return("close", 1)
    v60, v200 = s.std(r, 60), s.std(r, 200)
    s.calc(
        "vol_ratio_60_200", [v60, v200], lambda: F.coalesce(F.col(v60) / (F.col(v200) + EPS), F.lit(0.0)), keep=True
    )
    return s.apply(withprev, keys=keys, ts=ts, chunk_rows=chunk_rows).drop("prev_high", "prev_low", "prev_close")


def _filled(s: Study, name: str, col: str, fill: float | None) -> None:
    s.calc(name, [col], lambda: F.col(col) if fill is None else F.coalesce(F.col(col), F.lit(fill)), keep=True)


def _coarse_context(bars: DataFrame, tag: str, flags: FeatureFlags, keys, ts, chunk_rows, long_mean: bool) -> DataFrame:
    s = Study()
    if flags.cvd:
        s.out(f"cvd_{tag}", s.flow_zscore(s.cvd_step(), 50))
    if flags.obv:
        s.out(f"obv_{tag}", s.flow_zscore(s.obv_step(), 50))
    if flags.mfi:
        m = s.mfi(14)
        s.calc(f"mfi_{tag}", [m], lambda: (F.col(m) - 50) / 25, keep=True)
    s.out(f"rsi_{tag}", s.rsi("close", 14))
    s.out(f"bb_pos_{tag}", s.bb_position("close", 20))
    if long_mean:
        s.out(f"dist_sma_20_{tag}", s.dist_sma_atr("close", 20))
        s.out(f"dist_sma_200_{tag}", s.dist_sma_atr("close", 200))
        s.out("sma_200", s.mean("close", 200))
        s.out("atr_m5_smooth", s.atr(14))
        s.out("atr_norm_m5_smooth", s.atr_norm(14))
        s.out(f"volume_{tag}_norm", s.volume_norm("volume", 20))
    kept = list(s._outputs)
    return s.apply(_floor_price(bars), keys=keys, ts=ts, chunk_rows=chunk_rows).select(*keys, ts, *kept)


def m5_features(
    bars: DataFrame,
    *,
    fine: str = "5 minutes",
    mid: str = "15 minutes",
    slow: str = "1 hour",
    align: str = "close",
    flags: FeatureFlags | None = None,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    rolled: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """The 36-column set on fine bars with context from two coarser widths (bars' OHLCV kept beside it).

    ``align='open'`` shows a coarse bar from its start; ``'close'`` only once it is complete.
    ``rolled=True`` says the input already has the fine width.
    """
    flags = flags or FeatureFlags()
    m5 = bars if rolled else rollup_bars(bars, fine, keys=keys, ts=ts)
    s = Study()
    atr, norm = s.atr(14), s.atr_norm(14)
    # The first bar has no true range: it takes the next bar's value.
    for name, col, fill in (("atr_m5", atr, 0.0), ("atr_norm_m5", norm, 1.0)):
        ahead = s.put(f"_next_{name}", [col], lambda line, col=col: line.next(col), ahead=1)
        s.calc(
            name, [col, ahead], lambda col=col, ahead=ahead, fill=fill: F.coalesce(F.col(col), F.col(ahead), F.lit(fill)), keep=True
        )
    _filled(s, "rsi_m5", s.rsi("close", 14), NEUTRAL["rsi"])
    _filled(s, "bb_pos_m5", s.bb_position("close", 20), NEUTRAL["bb"])
    _filled(s, "dist_sma_20_m5", s.dist_sma_atr("close", 20), 0.0)
    _filled(s, "dist_sma_200_m5", s.dist_sma_atr("close", 200), 0.0)
    k, d = s.stochastic(14, 3)
    _filled(s, "stoch_k_m5", k, NEUTRAL["stoch"])
    _filled(s, "stoch_d_m5", d, NEUTRAL["stoch"])
    if flags.macd:
        _, _, hist = s.macd()
        s.calc("macd_hist_m5", [hist, atr], lambda: F.coalesce(F.col(hist) / (F.col(atr) + EPS), F.lit(0.0)), keep=True)
    adx, _, _ = s.adx(14)
    _filled(s, "adx", adx, NEUTRAL["adx"])
    _filled(s, "volume_m5_norm", s.volume_norm("volume", 20), NEUTRAL["volume_norm"])
    _filled(s, "ret_1_m5", s.roc("close", 1), 0.0)
    vroc, old = s.roc("volume", 5), s.prev("volume", 5)
    # No earlier volume: 0; an earlier zero volume is an infinite change and is cleaned below.
    s.calc("volume_roc", [vroc, old], lambda: F.when(F.col(old).isNull(), F.lit(0.0)).otherwise(F.col(vroc)), keep=True)
    div, strong = s.price_volume_divergence()
    s.out("divergence_volume_m5", div)
    s.out("divergence_volume_m5_strong", strong)
    s.out("divergence_volume_new_high_m5", s.new_high_divergence(20))
    if flags.cvd:
        _filled(s, "cvd_m5", s.flow_zscore(s.cvd_step(), 50), 0.0)
    if flags.obv:
        _filled(s, "obv_m5", s.flow_zscore(s.obv_step(), 50), 0.0)
    if flags.mfi:
        m = s.mfi(14)
        s.calc("mfi_m5", [m], lambda: F.coalesce((F.col(m) - 50) / 25, F.lit(0.0)), keep=True)
    own = s.apply(_floor_price(m5), keys=keys, ts=ts, chunk_rows=chunk_rows)
    m15 = _coarse_context(rollup_bars(m5, mid, keys=keys, ts=ts), "m15", flags, keys, ts, chunk_rows, True)
    ctx15 = [c for c in m15.columns if c not in (*keys, ts)]
    fills = {c: f for c, f in _context_fills("m15").items() if c != "obv_m15" and c != "mfi_m15"}
    out = asof_align(own, m15, ctx15, mid, mode=align, fine_width=fine, fill=fills, keys=keys, ts=ts, chunk_rows=chunk_rows)
    if flags.m60_context:
        m60 = _coarse_context(rollup_bars(m5, slow, keys=keys, ts=ts), "m60", flags, keys, ts, chunk_rows, False)
        ctx60 = [c for c in m60.columns if c not in (*keys, ts)]
        out = asof_align(
            out, m60, ctx60, slow, mode=align, fine_width=fine, fill=_context_fills("m60"), keys=keys, ts=ts, chunk_rows=chunk_rows
        )
    columns = [c for c in M5_COLUMNS if flags.mfi or c not in ("mfi_m15", "mfi_m60")]
    off = _switched_off(flags)
    alias = {
        "atr_norm_m5_native": "atr_norm_m5",
        "atr_m5_native": "atr_m5",
        "dist_sma_200": "dist_sma_200_m15",
    }
    # Only computed columns are cleaned; copies and constants are added to the finished rows.
    real = [c for c in columns if c not in off and c not in alias]
    shaped = out.select(*keys, ts, "open", "high", "low", "close", "volume", *real)
    # The other columns have a neutral fill and cannot be null.
    open_ended = [c for c in real if c in ("volume_roc", "sma_200", "obv_m15", "mfi_m15")]
    done = clean_features(shaped, open_ended, "drop", keys=keys, ts=ts, chunk_rows=chunk_rows)
    final = [F.lit(off[c]).alias(c) if c in off else F.col(alias.get(c, c)).alias(c) for c in columns]
    return done.select(*keys, ts, "open", "high", "low", "close", "volume", *final)


def _context_fills(tag: str) -> dict[str, float]:
    return {
        f"rsi_{tag}": NEUTRAL["rsi"],
        f"bb_pos_{tag}": NEUTRAL["bb"],
        f"dist_sma_20_{tag}": 0.0,
        f"dist_sma_200_{tag}": 0.0,
        f"volume_{tag}_norm": NEUTRAL["volume_norm"],
        f"cvd_{tag}": 0.0,
        f"obv_{tag}": 0.0,
        f"mfi_{tag}": 0.0,
        "atr_m5_smooth": 0.0,
        "atr_norm_m5_smooth": NEUTRAL["atr_norm"],
    }


def _switched_off(flags: FeatureFlags) -> dict[str, float]:
    off: dict[str, float] = {}

    def neutral(on: bool, values: dict[str, float]) -> None:
        if not on:
            off.update(values)

    neutral(flags.rsi, {"rsi_m5": 50.0})
    neutral(flags.bb_pos, {"bb_pos_m5": 0.5})
    neutral(flags.sma_dist, {"dist_sma_20_m5": 0.0})
    neutral(flags.stoch, {"stoch_k_m5": 50.0, "stoch_d_m5": 50.0})
    neutral(flags.macd, {"macd_hist_m5": 0.0})
    for kind in ("", "_native", "_smooth"):
        neutral(flags.atr, {f"atr_norm_m5{kind}": 1.0, f"atr_m5{kind}": 0.0})
    neutral(flags.adx, {"adx": 20.0})
    neutral(flags.cvd, {f"cvd_{t}": 0.0 for t in ("m5", "m15", "m60")})
    neutral(flags.sma200, {"dist_sma_200_m5": 0.0, "dist_sma_200_m15": 0.0, "dist_sma_200": 0.0})
    neutral(flags.returns, {"ret_1_m5": 0.0})
    neutral(flags.obv, {f"obv_{t}": 0.0 for t in ("m5", "m15", "m60")})
    neutral(flags.mfi, {f"mfi_{t}": 0.0 for t in ("m5", "m15", "m60")})
    neutral(flags.volume_m5, {"volume_m5_norm": 1.0})
    neutral(flags.volume_m15, {"volume_m15_norm": 1.0})
    for on, tag in ((flags.m15_context, "m15"), (flags.m60_context, "m60")):
        neutral(on, {f"rsi_{tag}": 50.0, f"bb_pos_{tag}": 0.5, f"cvd_{tag}": 0.0, f"obv_{tag}": 0.0, f"mfi_{tag}": 0.0})
    neutral(flags.m15_context, {"dist_sma_20_m15": 0.0})
    return off


def m1_features(
    bars: DataFrame,
    *,
    widths: tuple[str, str, str] = ("5 minutes", "15 minutes", "1 hour"),
    indicator_grid: str = "coarse",
    align: str = "close",
    fine_width: str = "1 minute",
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    chunk_rows: int | None = None,
) -> DataFrame:
    """The 16-column set on fine bars.

    ``indicator_grid='coarse'`` computes each context indicator on its own bars and aligns it;
    ``'fine'`` first repeats the coarse prices on the fine rows and computes over those.
    """
    if indicator_grid not in ("coarse", "fine"):
        raise ValueError(f"unknown indicator_grid: {indicator_grid}")
    base = bars.withColumns(
        {c: F.when(F.col(c) == 0, F.lit(EPS)).otherwise(F.col(c)) for c in ("high", "low", "close")}
    )
    tags = ("m5", "m15", "m60")
    need = {"m5": ("rsi", "bb", "dist", "stoch", "macd"), "m15": ("rsi", "bb", "dist"), "m60": ("rsi", "bb")}
    fills = {"rsi": 50.0, "bb_pos": 0.5, "dist_sma_20": 0.0, "stoch_k": 50.0, "macd_hist": 0.0}

    def context(s: Study, tag: str, h: str, l: str, c: str) -> list[str]:
        names = [s.out(f"rsi_{tag}", s.rsi(c, 14)), s.out(f"bb_pos_{tag}", s.bb_position(c, 20))]
        if "dist" in need[tag]:
            names.append(s.out(f"dist_sma_20_{tag}", s.dist_sma_atr(c, 20, 14, h, l)))
        if "stoch" in need[tag]:
            names.append(s.out(f"stoch_k_{tag}", s.stochastic(14, 3, h, l, c)[0]))
        if "macd" in need[tag]:
            _, _, hist = s.macd(c)
            rng = s.atr(14, h, l, c)
            names.append(s.calc(f"macd_hist_{tag}", [hist, rng], lambda: F.col(hist) / (F.col(rng) + EPS), keep=True))
        return names

    s = Study()
    frame = base
    if indicator_grid == "fine":
        for tag, width in zip(tags, widths, strict=True):
            side = _floor_price(rollup_bars(bars, width, keys=keys, ts=ts)).select(
                *keys, F.col(ts).alias("_b"), *[F.col(c).alias(f"{c}_{tag}") for c in ("high", "low", "close")]
            )
            frame = frame.withColumn("_b", bucket_start(ts, width)).join(side, [*keys, "_b"]).drop("_b")
            context(s, tag, f"high_{tag}", f"low_{tag}", f"close_{tag}")
    _filled(s, "bb_position", s.bb_position("close", 20), None)
    _filled(s, "dist_sma_20", s.dist_sma_atr("close", 20), None)
    _filled(s, "rsi_14", s.rsi("close", 14), None)
    _filled(s, "ret_1", s.roc("close", 1), 0.0)
    _filled(s, "atr_14", s.atr(14), None)
    _filled(s, "volume_roc", s.roc("volume", 5), 0.0)
    out = s.apply(frame, keys=keys, ts=ts, chunk_rows=chunk_rows)
    if indicator_grid == "coarse":
        for tag, width in zip(tags, widths, strict=True):
            cs = Study()
            names = context(cs, tag, "high", "low", "close")
            coarse = cs.apply(_floor_price(rollup_bars(bars, width, keys=keys, ts=ts)), keys=keys, ts=ts, chunk_rows=chunk_rows)
            out = asof_align(
                out, coarse, names, width, mode=align, fine_width=fine_width, keys=keys, ts=ts, chunk_rows=chunk_rows
            )
    filled = {
        c: F.coalesce(F.col(c), F.lit(v)) for c in M1_COLUMNS for p, v in fills.items() if c.startswith(f"{p}_m")
    }
    out = out.withColumns(filled).select(*keys, ts, *M1_COLUMNS)
    return clean_features(out, M1_COLUMNS, "zero", keys=keys, ts=ts, chunk_rows=chunk_rows)
