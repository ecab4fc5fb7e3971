"""Indicator columns collected by dependency level.

Spark does not nest window functions, so an indicator such as ATR (a mean over a true range that itself
needs the previous close) takes two steps. A ``Study`` records every expression with its level and its
look-back, merges equal helpers, and adds one ``withColumns`` per level; expressions of one level share
the same partitioning and order and so run in one Window operator.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.plans.chunks import UNIT, Line, chunked_rows
from barspark.plans.series import Series

Expr = Callable[[Line], Column]
EPS = 1e-9
# Longer means come from running totals instead of re-adding the frame for every row.
LONG_FRAME = 100
# Largest exponent a weight inside a block may reach.
MAX_EXPONENT = 600.0
POS, BLOCK, OFFSET = "_pos", "_block", "_offset"


class Study:
    def __init__(self) -> None:
        self._levels: list[dict[str, Expr]] = []
        self._level_of: dict[str, int] = {}
        self._reach: dict[str, tuple[int, int]] = {}
        self._outputs: list[str] = []
        self._block = 0
        self._rate = 0.0

    # -- recording ---------------------------------------------------------------------------------
    def level(self, col: str) -> int:
        return self._level_of.get(col, -1)

    def put(
        self,
        name: str,
        needs: Sequence[str],
        expr: Expr,
        *,
        back: int = 0,
        ahead: int = 0,
        keep: bool = False,
    ) -> str:
        """Record ``name``; it is placed one level above the highest column it needs."""
        if name not in self._level_of:
            lvl = 1 + max([self.level(c) for c in needs], default=-1)
            while len(self._levels) <= lvl:
                self._levels.append({})
            self._levels[lvl][name] = expr
            self._level_of[name] = lvl
            reach = [self._reach.get(c, (0, 0)) for c in needs] or [(0, 0)]
            self._reach[name] = (back + max(r[0] for r in reach), ahead + max(r[1] for r in reach))
        if keep and name not in self._outputs:
            self._outputs.append(name)
        return name

    def out(self, name: str, col: str) -> str:
        """Publish helper ``col`` under ``name``."""
        return self.put(name, [col], lambda line: F.col(col), keep=True)

    @property
    def back(self) -> int:
        return max([r[0] for r in self._reach.values()], default=0)

    @property
    def ahead(self) -> int:
        return max([r[1] for r in self._reach.values()], default=0)

    # -- running -----------------------------------------------------------------------------------
    def on(self, df: DataFrame, line: Line) -> DataFrame:
        """Add the columns on an already chunked frame.

        With a recursive mean the rows are first numbered and cut into blocks; ordering every window by
        (block, time) is the same order as by time, and lets all of them share one sort.
        """
        if self._block:
            if self._block * self._rate > MAX_EXPONENT:
                raise ValueError("spans of one study are too far apart; use two studies")
            pos = F.row_number().over(line.ordered) - 1
            df = df.withColumn(POS, pos).withColumns(
                {BLOCK: F.floor(F.col(POS) / self._block), OFFSET: F.col(POS) % self._block}
            )
            line = Line(line.part, (BLOCK, *line.order))
        for exprs in self._levels:
            df = df.withColumns({name: expr(line) for name, expr in exprs.items()})
        return df.drop(POS, BLOCK, OFFSET, *[c for c in self._level_of if c not in self._outputs])

    def apply(
        self,
        df: DataFrame,
        *,
        keys: Sequence[str] = ("symbol",),
        ts: str = "ts",
        order: Sequence[str] | None = None,
        chunk_rows: int | None = None,
        unit: str = UNIT,
    ) -> DataFrame:
        rows = chunked_rows(
            df, keys=keys, ts=ts, order=order, back=self.back, ahead=self.ahead, chunk_rows=chunk_rows, unit=unit
        )
        return rows.trim(self.on(rows.df, rows.line))

    def on_series(self, series: Series) -> Series:
        """Add the columns on a written cut that has all its rows."""
        rows = series.chunks(self.back, self.ahead)
        return series.having(rows.trim(self.on(rows.df, rows.line)))

    # -- building blocks ---------------------------------------------------------------------------
    def prev(self, col: str, k: int = 1) -> str:
        return self.put(f"_{col}_lag{k}", [col], lambda line: line.prev(col, k), back=k)

    def diff(self, col: str, k: int = 1) -> str:
        lag = self.prev(col, k)
        return self.put(f"_{col}_diff{k}", [col, lag], lambda line: F.col(col) - F.col(lag))

    def mean(self, col: str, n: int, *, full: bool = False) -> str:
        """Rolling mean; ``full`` leaves the first n-1 rows null."""
        if full:
            return self._gated(col, n, "mean", self.mean(col, n))
        if n > LONG_FRAME:
            return self._long_mean(col, n)
        return self.put(f"_{col}_mean{n}", [col], lambda line: F.avg(col).over(line.rows(n)), back=n - 1)

    def _long_mean(self, col: str, n: int) -> str:
        total = self.put(f"_{col}_cum", [col], lambda line: F.sum(col).over(line.so_far))
        seen = self.put(f"_{col}_seen", [col], lambda line: F.count(col).over(line.so_far))

        def expr(line: Line) -> Column:
            return F.try_divide(
                F.col(total) - F.coalesce(line.prev(total, n), F.lit(0.0)),
                F.col(seen) - F.coalesce(line.prev(seen, n), F.lit(0)),
            )

        return self.put(f"_{col}_mean{n}", [total, seen], expr, back=n)

    def _gated(self, col: str, n: int, kind: str, plain: str) -> str:
        seen = self.put(f"_{col}_count{n}", [col], lambda line: F.count(col).over(line.rows(n)), back=n - 1)
        return self.put(
            f"_{col}_{kind}{n}_full", [plain, seen], lambda line: F.when(F.col(seen) >= n, F.col(plain))
        )

    def total(self, col: str, n: int) -> str:
        return self.put(f"_{col}_sum{n}", [col], lambda line: F.sum(col).over(line.rows(n)), back=n - 1)

    def std(self, col: str, n: int, *, full: bool = False) -> str:
        name = self.put(f"_{col}_std{n}", [col], lambda line: F.stddev_samp(col).over(line.rows(n)), back=n - 1)
        return self._gated(col, n, "std", name) if full else name

    def top(self, col: str, n: int, *, full: bool = False) -> str:
        name = self.put(f"_{col}_max{n}", [col], lambda line: F.max(col).over(line.rows(n)), back=n - 1)
        return self._gated(col, n, "max", name) if full else name

    def low(self, col: str, n: int, *, full: bool = False) -> str:
        name = self.put(f"_{col}_min{n}", [col], lambda line: F.min(col).over(line.rows(n)), back=n - 1)
        return self._gated(col, n, "min", name) if full else name

    def calc(self, name: str, needs: Sequence[str], expr: Callable[[], Column], *, keep: bool = False) -> str:
        """A row-wise expression over earlier columns."""
        return self.put(name, needs, lambda line: expr(), keep=keep)

    def ema(self, col: str, span: int) -> str:
        """Recursive mean, alpha = 2/(span+1), seeded with the first value.

        Inside a block the recursion is a weighted running sum. A block is long enough that the weight
        of anything before the previous block is below double precision, so the carry is the previous
        block's own end value and no sequential fold is needed.
        """
        alpha = 2.0 / (span + 1)
        decay = 1.0 - alpha
        self._block = max(self._block, ema_memory(span))
        self._rate = max(self._rate, -math.log(decay))
        off = F.col(OFFSET)

        def weighted(line: Line) -> Column:
            weight = F.when(F.col(POS) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
            spec = Window.partitionBy(*line.part, BLOCK).orderBy(*[c for c in line.order if c != BLOCK])
            grown = F.sum(weight * F.col(col) * F.pow(F.lit(decay), -off)).over(
                spec.rowsBetween(Window.unboundedPreceding, 0)
            )
            return grown * F.pow(F.lit(decay), off)

        local = self.put(f"_{col}_ema{span}_local", [col], weighted, back=ema_memory(span))

        def carried(line: Line) -> Column:
            ended = F.last(F.when(off == self._block - 1, F.col(local)), ignorenulls=True)
            before = ended.over(line.between(Window.unboundedPreceding, -1))
            return F.col(local) + F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(decay), off + 1)

        return self.put(f"_{col}_ema{span}", [local], carried)

    # -- indicators --------------------------------------------------------------------------------
    def rsi(self, close: str = "close", n: int = 14, *, full: bool = False) -> str:
        """Gains and losses by simple means; null where there is no loss."""
        d = self.diff(close)
        gain = self.calc(f"_{close}_gain", [d], lambda: F.when(F.col(d).isNotNull(), F.greatest(F.col(d), F.lit(0.0))))
        loss = self.calc(f"_{close}_loss", [d], lambda: F.when(F.col(d).isNotNull(), F.greatest(-F.col(d), F.lit(0.0))))
        up, down = self.mean(gain, n, full=full), self.mean(loss, n, full=full)
        return self.calc(
            f"_{close}_rsi{n}" + ("_full" if full else ""),
            [up, down],
            lambda: 100 - 100 / (1 + F.try_divide(F.col(up), F.col(down))),
        )

    def stochastic(self, n: int = 14, d: int = 3, high="high", low="low", close="close") -> tuple[str, str]:
        hi, lo = self.top(high, n), self.low(low, n)
        k = self.calc(
            f"_{close}_stoch{n}",
            [hi, lo, close],
            lambda: 100 * (F.col(close) - F.col(lo)) / (F.col(hi) - F.col(lo) + EPS),
        )
        return k, self.mean(k, d)

    def typical(self, high="high", low="low", close="close") -> str:
        return self.calc(f"_{close}_typical", [high, low, close], lambda: (F.col(high) + F.col(low) + F.col(close)) / 3)

    def cci(self, n: int = 20, high="high", low="low", close="close") -> str:
        tp = self.typical(high, low, close)
        mean = self.mean(tp, n)
        gap = self.calc(f"{tp}_gap{n}", [tp, mean], lambda: F.abs(F.col(tp) - F.col(mean)))
        mad = self.mean(gap, n)
        return self.calc(
            f"_{close}_cci{n}", [tp, mean, mad], lambda: (F.col(tp) - F.col(mean)) / (0.015 * (F.col(mad) + EPS))
        )

    def williams_r(self, n: int = 14, high="high", low="low", close="close") -> str:
        hi, lo = self.top(high, n), self.low(low, n)
        return self.calc(
            f"_{close}_willr{n}",
            [hi, lo, close],
            lambda: -100 * (F.col(hi) - F.col(close)) / (F.col(hi) - F.col(lo) + EPS),
        )

    def true_range(self, high="high", low="low", close="close") -> str:
        """Null on the first bar, where there is no previous close."""
        before = self.prev(close)
        return self.calc(
            f"_{close}_tr",
            [before, high, low],
            lambda: F.when(
                F.col(before).isNotNull(),
                F.greatest(
                    F.col(high) - F.col(low), F.abs(F.col(high) - F.col(before)), F.abs(F.col(low) - F.col(before))
                ),
            ),
        )

    def atr(self, n: int = 14, high="high", low="low", close="close", *, full: bool = False) -> str:
        return self.mean(self.true_range(high, low, close), n, full=full)

    def adx(self, n: int = 14, high="high", low="low", close="close") -> tuple[str, str, str]:
        tr = self.mean(self.true_range(high, low, close), n)
        up, fall = self.diff(high), self.diff(low)

        def move(mine: Column, other: Column) -> Column:
            return F.when((mine > other) & (mine > 0), mine).otherwise(0.0)

        plus = self.calc(f"_{high}_plus_dm", [up, fall], lambda: move(F.col(up), -F.col(fall)))
        minus = self.calc(f"_{low}_minus_dm", [up, fall], lambda: move(-F.col(fall), F.col(up)))
        mp, mm = self.mean(plus, n), self.mean(minus, n)
        pdi = self.calc(f"_{close}_pdi{n}", [mp, tr], lambda: 100 * (F.col(mp) / (F.col(tr) + EPS)))
        mdi = self.calc(f"_{close}_mdi{n}", [mm, tr], lambda: 100 * (F.col(mm) / (F.col(tr) + EPS)))
        dx = self.calc(
            f"_{close}_dx{n}",
            [pdi, mdi],
            lambda: 100 * F.abs(F.col(pdi) - F.col(mdi)) / (F.col(pdi) + F.col(mdi) + EPS),
        )
        return self.mean(dx, n), pdi, mdi

    def macd(self, close: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[str, str, str]:
        quick, lag = self.ema(close, fast), self.ema(close, slow)
        line = self.calc(f"_{close}_macd{fast}_{slow}", [quick, lag], lambda: F.col(quick) - F.col(lag))
        sig = self.ema(line, signal)
        hist = self.calc(f"{line}_hist{signal}", [line, sig], lambda: F.col(line) - F.col(sig))
        return line, sig, hist

    def bollinger(self, close: str = "close", n: int = 20, k: float = 2.0, *, full: bool = False) -> tuple[str, str, str]:
        mid, dev = self.mean(close, n, full=full), self.std(close, n, full=full)
        tag = f"_{close}_bb{n}" + ("f" if full else "")
        upper = self.calc(f"{tag}_up", [mid, dev], lambda: F.col(mid) + k * F.col(dev))
        lower = self.calc(f"{tag}_low", [mid, dev], lambda: F.col(mid) - k * F.col(dev))
        return upper, mid, lower

    def bb_position(self, close: str = "close", n: int = 20, k: float = 2.0, *, full: bool = False) -> str:
        upper, _, lower = self.bollinger(close, n, k, full=full)
        return self.calc(
            f"{upper}_pos",
            [upper, lower, close],
            lambda: (F.col(close) - F.col(lower)) / (F.col(upper) - F.col(lower) + EPS),
        )

    def dist_sma_atr(self, close: str = "close", n: int = 20, atr: int = 14, high="high", low="low") -> str:
        mean, rng = self.mean(close, n), self.atr(atr, high, low, close)
        return self.calc(
            f"_{close}_dist{n}", [close, mean, rng], lambda: (F.col(close) - F.col(mean)) / (F.col(rng) + EPS)
        )

    def atr_norm(self, n: int = 14, high="high", low="low", close="close") -> str:
        rng = self.atr(n, high, low, close)
        base = self.mean(rng, n)
        return self.calc(f"_{close}_atrnorm{n}", [rng, base], lambda: F.try_divide(F.col(rng), F.col(base)))

    def obv_step(self, close="close", volume="volume") -> str:
        d = self.diff(close)
        return self.calc(
            f"_{close}_obvstep", [d, volume], lambda: F.coalesce(F.signum(F.col(d)), F.lit(0.0)) * F.col(volume)
        )

    def cvd_step(self, open="open", high="high", low="low", close="close", volume="volume") -> str:
        return self.calc(
            f"_{close}_cvdstep",
            [open, high, low, close, volume],
            lambda: (F.col(close) - F.col(open)) / (F.col(high) - F.col(low) + EPS) * F.col(volume),
        )

    def flow_zscore(self, step: str, n: int = 50) -> str:
        """z-score of the cumulative ``step`` over n rows.

        The score does not change when the level is shifted, so the running total starts at the chunk
        and no global cumulative sum is needed.
        """
        level = self.put(f"{step}_level", [step], lambda line: F.sum(step).over(line.so_far), back=1)
        return self.zscore(level, n)

    def zscore(self, col: str, n: int = 50) -> str:
        mean, dev = self.mean(col, n), self.std(col, n)
        return self.calc(f"{col}_z{n}", [col, mean, dev], lambda: (F.col(col) - F.col(mean)) / (F.col(dev) + EPS))

    def roc(self, col: str, n: int) -> str:
        before = self.prev(col, n)
        return self.calc(f"_{col}_roc{n}", [col, before], lambda: F.try_divide(F.col(col), F.col(before)) - 1)

    def mfi(self, n: int = 14, high="high", low="low", close="close", volume="volume") -> str:
        tp = self.typical(high, low, close)
        before = self.prev(tp)
        flow = F.col(tp) * F.col(volume)
        pos = self.calc(
            f"{tp}_in", [tp, before, volume], lambda: F.when(F.col(tp) > F.col(before), flow).otherwise(0.0)
        )
        neg = self.calc(
            f"{tp}_out", [tp, before, volume], lambda: F.when(F.col(tp) < F.col(before), flow).otherwise(0.0)
        )
        a, b = self.total(pos, n), self.total(neg, n)
        return self.calc(f"_{close}_mfi{n}", [a, b], lambda: 100 - 100 / (1 + F.col(a) / (F.col(b) + EPS)))

    def volume_norm(self, volume: str = "volume", n: int = 20) -> str:
        mean = self.mean(volume, n, full=True)
        return self.calc(f"_{volume}_norm{n}", [volume, mean], lambda: F.col(volume) / (F.col(mean) + EPS))

    def price_volume_divergence(self, close="close", volume="volume") -> tuple[str, str]:
        dc, dv = self.diff(close), self.diff(volume)
        flag = self.calc(
            "_pv_div", [dc, dv], lambda: F.coalesce((F.col(dc) * F.col(dv) < 0).cast("int"), F.lit(0))
        )
        three = self.total(flag, 3)
        return flag, self.calc("_pv_div3", [three], lambda: (F.col(three) == 3).cast("int"))

    def new_high_divergence(self, n: int = 20, close="close", volume="volume") -> str:
        """New n-bar high on less volume than at the last new high of the n bars before."""
        top = self.top(close, n)
        new = self.calc(f"_{close}_newhigh{n}", [close, top], lambda: F.col(close) == F.col(top))

        def last_high(line: Line) -> Column:
            return F.last(F.when(F.col(new), F.col(volume)), ignorenulls=True).over(line.between(-n, -1))

        before = self.put(f"{new}_vol", [new, volume], last_high, back=n)
        return self.calc(
            f"{new}_div",
            [new, before, volume],
            lambda: F.coalesce((F.col(new) & (F.col(volume) < F.col(before))).cast("int"), F.lit(0)),
        )

    def log_return(self, close: str = "close", k: int = 1) -> str:
        before = self.prev(close, k)
        return self.calc(f"_{close}_logret{k}", [close, before], lambda: F.ln(F.col(close)) - F.ln(F.col(before)))


def ema_memory(span: int) -> int:
    """Rows after which a value's weight in the recursive mean is below double precision."""
    decay = 1.0 - 2.0 / (span + 1)
    return max(8, math.ceil(45.0 / -math.log(decay))) if decay > 0 else 8
