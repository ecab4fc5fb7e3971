"""The whole training run: bars to features, labels, sequences, split, model, threshold, test metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators.features import FeatureFlags, M5_COLUMNS, m5_features
from barspark.operators.labels import barrier_label
from barspark.operators.quality import newest_rows
from barspark.operators.model import RobustScale, score, train_gbt, with_weights
from barspark.operators.sequences import sequences
from barspark.operators.splits import purge, split_by_date
from barspark.operators.threshold import candidate_thresholds, evaluate_fixed, optimize_threshold, sweep
from barspark.plans.chunks import join_on
from barspark.session import cut_lineage


@dataclass(frozen=True)
class TrainSettings:
    """Fixed default values of a run."""

    window: int = 80
    sl: float = 1.0
    tp: float = 2.0
    min_hold: int = 2
    horizon: int = 60
    session: str = "london_ny"
    #: Newest train rows to fit on; None takes all. Validation and test rows are never cut.
    max_windows: int | None = None
    split_dates: tuple[str, str, str] | None = None
    mode: str = "hybrid"
    min_precision: float = 0.38
    min_recall: float = 0.30
    cap: int | None = 150
    cap_on_val: bool = False
    profile: str = "regularized"
    overrides: Mapping[str, float] = field(default_factory=dict)
    scale_accuracy: int | None = None
    fine: str = "5 minutes"
    mid: str = "15 minutes"
    slow: str = "1 hour"
    align: str = "close"


@dataclass(frozen=True)
class TrainResult:
    model: GBTClassificationModel
    scaler: RobustScale
    threshold: float
    columns: list[str]
    scored: DataFrame
    metrics: DataFrame


def labelled_sequences(
    bars: DataFrame, settings: TrainSettings, flags: FeatureFlags | None = None, *, rolled: bool = False
) -> tuple[DataFrame, list[str]]:
    """Sequences with label and split, before scaling; filters and cap come before any vector is built."""
    flags = flags or FeatureFlags()
    # Narrow feature rows are written once; labels, caps and vectors all start from them.
    feats = cut_lineage(
        m5_features(
            bars, fine=settings.fine, mid=settings.mid, slow=settings.slow, align=settings.align, flags=flags, rolled=rolled
        )
    )
    cols: Sequence[str] = [c for c in M5_COLUMNS if c in feats.columns]
    labelled = barrier_label(feats, settings.sl, settings.tp, settings.min_hold, settings.horizon)
    seqs = sequences(labelled, cols, settings.window, session=settings.session)
    slim = seqs.select("symbol", "ts", "close", "atr_m5", "adx", "sma_200", "label", "features")
    rows = split_by_date(slim, *settings.split_dates) if settings.split_dates else purge(slim, settings.window)
    if settings.max_windows is not None:
        fit = newest_rows(rows.where(F.col("split") == "train").select("symbol", "ts"), settings.max_windows, "ts", "symbol")
        rows = join_on(rows, fit.withColumn("_fit", F.lit(True)), ["symbol", "ts"], "left")
        rows = rows.where((F.col("split") != "train") | F.col("_fit")).drop("_fit")
    return rows, list(cols)


def train_and_evaluate(
    bars: DataFrame, settings: TrainSettings | None = None, flags: FeatureFlags | None = None, *, rolled: bool = False
) -> TrainResult:
    """Fit on train, stop and choose the threshold on val, report on test."""
    settings = settings or TrainSettings()
    rows, cols = labelled_sequences(bars, settings, flags, rolled=rolled)
    # Fitting passes over the rows many times: they are written once to the shared checkpoint folder.
    rows = cut_lineage(rows)
    train, held = F.col("split") == "train", F.col("split") == "val"
    scaler = RobustScale.fit(rows.where(train), accuracy=settings.scale_accuracy)
    weighted = with_weights(scaler.apply(rows), train=train).withColumn("_val", held)
    fit_rows = cut_lineage(weighted.where(train | held).select("features", "label", "weight", "_val"))
    model = train_gbt(
        fit_rows, weight="weight", validation="_val", profile=settings.profile, overrides=settings.overrides
    )
    scored = cut_lineage(score(scaler.apply(rows), model).drop("features", "prediction", "threshold"))
    val = scored.where(held)
    table = sweep(val, candidate_thresholds(val), settings.cap if settings.cap_on_val else None)
    best = optimize_threshold(
        table, mode=settings.mode, min_precision=settings.min_precision, min_recall=settings.min_recall
    )
    threshold = float(best.first()["threshold"])
    metrics = evaluate_fixed(scored.where(F.col("split") == "test"), threshold, settings.cap)
    final = scored.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))
    return TrainResult(model, scaler, threshold, cols, final, metrics)
