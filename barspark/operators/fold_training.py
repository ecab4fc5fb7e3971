"""Training over folds: scaler, model, threshold and test metrics of every fold, from one written table.

The rows of all folds are written once, a folder per fold, so a fold reads its own rows only. Folds are independent and
are fitted a few at a time. Nothing of a fold's test rows reaches its scaler, its weights, its model or its threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barspark.operators.model import DEFAULT_PROFILE, RobustScale, score, train_gbt, with_weights
from barspark.operators.threshold import candidate_thresholds, evaluate_fixed, optimize_threshold, sweep
from barspark.session import run_folder


@dataclass(frozen=True)
class FoldSettings:
    """Fixed default values of training over folds."""

    profile: str = DEFAULT_PROFILE
    #: Folds are fitted with few trees.
    overrides: Mapping[str, float] = field(default_factory=lambda: {"n_estimators": 20})
    #: Roles whose rows the scaler is fitted on; add ``val`` where it is cut off the training rows.
    scale_on: tuple[str, ...] = ("train",)
    positive_weight: float | None = None
    negative_weight: float = 1.0
    mode: str = "hybrid"
    min_precision: float = 0.38
    min_recall: float = 0.30
    cap: int | None = None
    cap_on_val: bool = False
    #: Threshold of a fold without validation rows.
    default_threshold: float = 0.5
    seed: int = 42
    #: Folds fitted at the same time.
    at_once: int = 4


@dataclass(frozen=True)
class FoldRun:
    #: One row per fold: rows and positives per role, threshold, metrics on its test rows.
    metrics: DataFrame
    #: Test rows of all folds with probability, threshold and prediction.
    scored: DataFrame
    #: (fold, pos, center, scale)
    scales: DataFrame


_COUNTS = [(r, k) for r in ("train", "val", "test") for k in ("n", "positives")]
_FOLD = "fold long, " + ", ".join(f"{k}_{r} long" for r, k in _COUNTS) + ", state string, threshold double"
_METRICS = (
    "trades long, tp long, fp long, fn long, tn long, win_rate double, precision double, recall double, f1 double, roc_auc double, pr_auc double"
)
_SCALES = "fold long, pos int, center double, scale double"


def _write_folds(folded: DataFrame, fold: str, role: str, cols: Sequence[str] | None, label: str, keep: Sequence[str]) -> str:
    features = F.array(*[F.col(c).cast("double") for c in cols]).alias("features") if cols else F.col("features")
    slim = folded.select(
        F.col(fold).cast("long").alias("fold"), F.col(role).alias("role"), F.col(label).cast("int").alias("label"), *keep, features
    )
    path = f"{run_folder(folded.sparkSession)}/folds-{uuid.uuid4().hex}"
    # A row without label can neither train nor test.
    slim.where(F.col("fold").isNotNull() & F.col("label").isNotNull()).write.partitionBy("fold").parquet(path)
    return path


def _counts(rows: DataFrame) -> list[Row]:
    """Rows and positives per fold and role: one row per fold."""
    def n(role: str, also=None):
        hit = F.col("role") == role
        return F.count_if(hit if also is None else hit & also)
    aggs = [n(r, None if k == "n" else F.col("label") == 1).alias(f"{k}_{r}") for r, k in _COUNTS]
    return rows.groupBy("fold").agg(*aggs).orderBy("fold").collect()


def _state(c: Row) -> str:
    """Why a fold cannot be trained or tested, or ``trained``."""
    if not c["n_train"] or not c["n_test"]:
        return "empty"
    return "trained" if 0 < c["positives_train"] < c["n_train"] else "one class"


def _fit(spark: SparkSession, path: str, schema, c: Row, s: FoldSettings) -> tuple[tuple, list[tuple]]:
    """Metrics row and scales of a fold; its scored test rows are written beside it."""
    rows = spark.read.schema(schema).parquet(path).where(F.col("fold") == c["fold"])
    train, val = F.col("role") == "train", F.col("role") == "val"
    has_val = c["n_val"] > 0
    scaler = RobustScale.fit(rows.where(F.col("role").isin(*s.scale_on)))
    scaled = scaler.apply(rows)
    weighted = with_weights(scaled.where(train | val), positive=s.positive_weight, negative=s.negative_weight, train=train)
    model = train_gbt(
        weighted.withColumn("_val", val).select("features", "label", "weight", "_val"),
        weight="weight",
        validation="_val" if has_val else None,
        profile=s.profile,
        overrides=s.overrides,
        seed=s.seed,
    )
    written = f"{path}-scored/fold={c['fold']}"
    score(scaled.where(~train), model).drop("features", "fold", "prediction", "threshold").write.parquet(written)
    scored = spark.read.parquet(written)
    best = None
    if has_val:
        held = scored.where("role = 'val'")
        table = sweep(held, candidate_thresholds(held), s.cap if s.cap_on_val else None)
        best = optimize_threshold(table, mode=s.mode, min_precision=s.min_precision, min_recall=s.min_recall).first()
    threshold = float(best["threshold"]) if best is not None else s.default_threshold
    m = evaluate_fixed(scored.where("role = 'test'"), threshold, s.cap).first()
    names = [x.split()[0] for x in _METRICS.split(", ")]
    stats = scaler.stats.first()["s"]
    scales = [(c["fold"], i, a, b) for i, (a, b) in enumerate(zip(stats["center"], stats["scale"], strict=True))]
    return ("trained", threshold, *[m[k] for k in names]), scales


def train_over_folds(
    folded: DataFrame,
    settings: FoldSettings | None = None,
    *,
    cols: Sequence[str] | None = None,
    label: str = "label",
    keep: Sequence[str] = ("symbol", "ts"),
    fold: str = "fold",
    role: str = "role",
) -> FoldRun:
    """Fit and test every fold of rows with ``fold`` and ``role`` (train, val, test), as the fold operators give them.

    Features are the columns ``cols`` or a vector column ``features``. The threshold is chosen on the fold's val rows.
    A fold without train or test rows (``empty``) or with one class in train (``one class``) has null metrics and its
    counts; rows without fold or label take no part; no rows give no folds. ``keep`` must hold ``ts`` where a daily cap
    is set. What reaches the driver is a row per fold and a number pair per fold and vector position.
    """
    s = settings or FoldSettings()
    spark = folded.sparkSession
    path = _write_folds(folded, fold, role, cols, label, keep)
    features = "features array<double>"
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in folded.select(*keep).schema]
    schema = ", ".join(["role string", "label int", *kept, features, "fold long"])
    counts = _counts(spark.read.schema(schema).parquet(path))
    usable = [c for c in counts if _state(c) == "trained"]
    with ThreadPoolExecutor(s.at_once) as pool:
        fit = inheritable_thread_target(spark)(lambda c: _fit(spark, path, schema, c, s))
        done = dict(zip([c["fold"] for c in usable], pool.map(fit, usable), strict=True))
    lacking = (None,) * (1 + len(_METRICS.split(", ")))
    lines = [(*c, *(done[c["fold"]][0] if c["fold"] in done else (_state(c), *lacking))) for c in counts]
    metrics = spark.createDataFrame(lines, f"{_FOLD}, {_METRICS}")
    scales = spark.createDataFrame([x for _, more in done.values() for x in more], _SCALES)
    out = ", ".join(["role string", "label int", *kept, "probability double", "confidence double", "fold long"])
    scored = spark.read.schema(out).parquet(f"{path}-scored") if done else spark.createDataFrame([], out)
    tested = scored.where("role = 'test'").drop("role")
    thresholds = metrics.select(F.col("fold").alias("_fold"), "threshold")
    tested = tested.join(thresholds, F.col("fold") == F.col("_fold")).drop("_fold")
    return FoldRun(metrics, tested.withColumn("prediction", (F.col("probability") >= F.col("threshold")).cast("int")), scales)
