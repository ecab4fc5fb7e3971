"""Model steps on Spark ML: scaling, weights, boosted trees, scoring, importance, saved artifacts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.regime import DEFAULT_RULES, RegimeRules, should_trade
from barspark.functions.sizing import confidence, levels
from barspark.operators.bars import latest_bars, rollup_bars
from barspark.operators.features import FeatureFlags, m5_features
from barspark.operators.sequences import sequence, sequence_names
from barspark.plans.select import vector_quantiles

# Parameter profiles of the boosted trees.
PROFILES: dict[str, dict[str, float]] = {
    "legacy": {
        "learning_rate": 0.03, "max_depth": 6, "min_child_weight": 1.0, "subsample": 0.7,
        "colsample_bytree": 0.6, "colsample_bynode": 1.0, "n_estimators": 600,
    },
    "regularized": {
        "learning_rate": 0.018, "max_depth": 4, "min_child_weight": 8.0, "subsample": 0.55,
        "colsample_bytree": 0.45, "colsample_bynode": 0.8, "n_estimators": 850,
    },
    "conservative": {
        "learning_rate": 0.015, "max_depth": 3, "min_child_weight": 10.0, "subsample": 0.5,
        "colsample_bytree": 0.4, "colsample_bynode": 0.75, "n_estimators": 900,
    },
}
DEFAULT_PROFILE = "regularized"


def tree_params(profile: str = DEFAULT_PROFILE, overrides: Mapping[str, float | None] | None = None) -> dict[str, float]:
    """A profile with overrides (None leaves a value alone)."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known: {', '.join(sorted(PROFILES))}")
    out = dict(PROFILES[profile])
    out.update({k: v for k, v in (overrides or {}).items() if v is not None})
    return out


@dataclass(frozen=True)
class RobustScale:
    """Median and inter-quartile range per vector position, held as one row of two arrays."""

    stats: DataFrame

    @staticmethod
    def fit(train: DataFrame, *, col: str = "features", accuracy: int | None = None) -> RobustScale:
        """Fit on training rows. A zero range scales by 1, so rare 0/1 columns keep their signal.

        ``accuracy`` switches to a sketch per position (rank error 1/accuracy) that is merged map-side;
        without it the quantiles are exact, from a few passes over ``train``, which should be a written table.
        """
        if not accuracy:
            a, b, c = vector_quantiles(train, col, [0.25, 0.5, 0.75]).T
            scale = np.where(c - a > 0, c - a, 1.0)
            # A position without a value stays null.
            center = [None if np.isnan(x) else float(x) for x in b]
            return RobustScale(train.sparkSession.createDataFrame([((center, scale.tolist()),)], "s struct<center: array<double>, scale: array<double>>"))
        long = train.select(F.posexplode(col).alias("pos", "value"))
        q = long.groupBy("pos").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).alias("q")).select(
            "pos", F.get("q", F.lit(0)).alias("a"), F.get("q", F.lit(1)).alias("b"), F.get("q", F.lit(2)).alias("c")
        )
        spread = F.col("c") - F.col("a")
        rows = q.select("pos", F.col("b").alias("center"), F.when(spread > 0, spread).otherwise(1.0).alias("scale"))
        # As many entries as the vector has positions.
        packed = rows.agg(F.array_sort(F.collect_list(F.struct("pos", "center", "scale"))).alias("s"))
        return RobustScale(packed.select(F.struct(F.col("s.center").alias("center"), F.col("s.scale").alias("scale")).alias("s")))

    def apply(self, rows: DataFrame, *, col: str = "features", out: str = "features") -> DataFrame:
        s = rows.withColumn("_s", self.stats.scalar())
        scaled = F.transform(col, lambda x, i: (x - F.get("_s.center", i)) / F.get("_s.scale", i))
        return s.withColumn(out, scaled).drop("_s")

    def save(self, path: str) -> None:
        self.stats.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RobustScale:
        return RobustScale(spark.read.parquet(path))


def with_weights(
    rows: DataFrame, *, label: str = "label", positive: float | None = None, negative: float = 1.0, train: Column | None = None, out: str = "weight"
) -> DataFrame:
    """Add ``weight``: given class weights, or negatives per positive (over ``train`` rows) for label 1."""
    if positive is not None:
        return rows.withColumn(out, F.when(F.col(label) == 1, float(positive)).otherwise(float(negative)))
    basis = rows.where(train) if train is not None else rows
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    ratio = basis.agg(F.when(pos > 0, neg / F.greatest(pos, F.lit(1))).otherwise(1.0).alias("r"))
    return rows.withColumn("_r", ratio.scalar()).withColumn(out, F.when(F.col(label) == 1, F.col("_r")).otherwise(1.0)).drop("_r")


def train_gbt(
    rows: DataFrame,
    *,
    features: str = "features",
    label: str = "label",
    weight: str | None = None,
    validation: str | None = None,
    profile: str = DEFAULT_PROFILE,
    overrides: Mapping[str, float | None] | None = None,
    seed: int = 42,
) -> GBTClassificationModel:
    """Boosted trees with a validation stop. ``validation`` is a boolean column of held-out rows.

    Trees are added until the loss on the held-out rows rises; with the small steps of the profiles, a stop at a least
    gain would end after the first trees.
    L1/L2 terms, gamma and the step bound of the profiles have no counterpart in Spark ML and are left out.
    """
    p = tree_params(profile, overrides)
    share = min(1.0, p["colsample_bytree"] * p["colsample_bynode"])
    gbt = GBTClassifier(
        featuresCol="_vec",
        labelCol=label,
        maxIter=int(p["n_estimators"]),
        maxDepth=int(p["max_depth"]),
        stepSize=float(p["learning_rate"]),
        subsamplingRate=float(p["subsample"]),
        featureSubsetStrategy=str(share) if share < 1 else "all",
        minInstancesPerNode=max(1, int(p["min_child_weight"])),
        seed=seed,
        validationTol=0.0,
    )
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    vec = rows.withColumn("_vec", array_to_vector(F.col(features))).withColumn(label, F.col(label).cast("double"))
    keep = ["_vec", label] + [c for c in (weight, validation) if c]
    return gbt.fit(vec.select(*keep))


def used_threshold(saved: float, floor: float | None = None) -> float:
    """The saved threshold, raised to a production floor where one is set."""
    return max(float(saved), float(floor)) if floor is not None else float(saved)


def score(
    rows: DataFrame, model: GBTClassificationModel, threshold: float = 0.5, floor: float | None = None, *, features: str = "features"
) -> DataFrame:
    """Add probability, prediction and confidence to every row in one pass."""
    t = used_threshold(threshold, floor)
    vec = rows.withColumn("_vec", array_to_vector(F.col(features)))
    drop = {model.getRawPredictionCol(), model.getPredictionCol(), "_vec", "_pv"}
    scored = model.setProbabilityCol("_pv").setFeaturesCol("_vec").transform(vec)
    p = F.get(vector_to_array("_pv"), F.lit(1))
    return (
        scored.withColumn("probability", p)
        .drop(*drop)
        .withColumn("prediction", (F.col("probability") >= t).cast("int"))
        .withColumn("threshold", F.lit(t))
        .withColumn("confidence", confidence(F.col("probability")))
    )


def importance_table(model: GBTClassificationModel, cols: Sequence[str], window: int, spark: SparkSession) -> DataFrame:
    """(name, lag, feature, importance) per vector position; as long as the vector."""
    values = model.featureImportances.toArray().tolist()
    names = sequence_names(cols, window)
    n = len(cols)
    data = [(name, window - 1 - i // n, cols[i % n], float(v)) for i, (name, v) in enumerate(zip(names, values, strict=True))]
    return spark.createDataFrame(data, "name string, lag int, feature string, importance double")


def importance_report(table: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Top-k positions and sums by feature and by lag."""
    def by(col: str) -> DataFrame:
        return table.groupBy(col).agg(F.sum("importance").alias("importance")).orderBy(F.col("importance").desc(), col)

    return {
        "top": table.orderBy(F.col("importance").desc(), "name").limit(k),
        "by_feature": by("feature"),
        "by_lag": by("lag"),
    }


def compare_importance(table: DataFrame, saved: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Saved against current importances by name."""
    both = table.select("name", "importance").join(saved.select("name", F.col("importance").alias("saved")), "name", "full_outer")
    gap = F.abs(F.coalesce("importance", F.lit(0.0)) - F.coalesce("saved", F.lit(0.0)))
    return both.withColumn("matches", gap <= tol)


def metadata(
    cols: Sequence[str], window: int, threshold: float, win_rate: float, analysis_days: int = 7, fine_per_bar: int = 5, **extra
) -> dict[str, object]:
    """Record kept beside a model; history recommendations follow from the window."""
    base = {
        "threshold": float(threshold),
        "win_rate": float(win_rate),
        "window_size": window,
        "analysis_window_days": analysis_days,
        "n_features_per_candle": len(cols),
        "total_features": len(cols) * window,
        "recommended_min_candles_m5": window + 200,
        "recommended_min_candles_m1": (window + 200) * fine_per_bar,
        "recommended_analysis_candles_m1": analysis_days * 24 * 60,
    }
    base.update({k: v for k, v in extra.items() if v is not None})
    return base


def write_metadata(spark: SparkSession, record: Mapping[str, object], cols: Sequence[str], folder: str) -> None:
    """Metadata and column order as one-line text files beside the model (any Hadoop file system)."""
    for name, value in (("metadata", dict(record)), ("columns", list(cols))):
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def read_metadata(spark: SparkSession, folder: str) -> tuple[dict[str, object], list[str]]:
    record = json.loads(spark.read.text(f"{folder}/metadata").first()[0])
    return record, json.loads(spark.read.text(f"{folder}/columns").first()[0])


def save_model(spark: SparkSession, model: GBTClassificationModel, scaler: RobustScale, record: Mapping[str, object], cols: Sequence[str], folder: str) -> None:
    model.write().overwrite().save(f"{folder}/model")
    scaler.save(f"{folder}/scaler")
    write_metadata(spark, record, cols, folder)


def load_model(spark: SparkSession, folder: str) -> tuple[GBTClassificationModel, RobustScale, dict[str, object], list[str]]:
    record, cols = read_metadata(spark, folder)
    return GBTClassificationModel.load(f"{folder}/model"), RobustScale.load(spark, f"{folder}/scaler"), record, cols


def score_latest(
    bars: DataFrame,
    model: GBTClassificationModel,
    scaler: RobustScale,
    record: Mapping[str, object],
    cols: Sequence[str],
    *,
    floor: float | None = None,
    sl: float = 1.0,
    tp: float = 2.0,
    gate: bool = False,
    rules: RegimeRules = DEFAULT_RULES,
    flags: FeatureFlags | None = None,
    fine: str = "5 minutes",
    mid: str = "15 minutes",
    slow: str = "1 hour",
) -> DataFrame:
    """One prediction row per symbol from its latest window: probability, levels and regime."""
    window = int(record["window_size"])
    recent = latest_bars(bars, days=int(record["analysis_window_days"]))
    feats = m5_features(rollup_bars(recent, fine), fine=fine, mid=mid, slow=slow, rolled=True, flags=flags)
    newest = latest_bars(sequence(feats, cols, window), n=1)
    scored = score(scaler.apply(newest), model, float(record["threshold"]), floor)
    judged = scored.withColumn(
        "_g", should_trade(F.col("atr_m5"), F.col("adx"), F.col("close"), F.col("sma_200"), rules)
    )
    allowed = F.col("_g.allowed") if gate else F.lit(True)
    stop, target, rr = levels(F.col("close"), F.col("atr_m5"), sl, tp)
    final = F.when(allowed, F.col("prediction")).otherwise(0)
    return judged.withColumn("prediction", final).select(
        "symbol",
        "ts",
        F.col("close").alias("entry_price"),
        "probability",
        "prediction",
        "threshold",
        "confidence",
        F.col("atr_m5").alias("atr"),
        F.when(F.col("prediction") == 1, stop).alias("sl_price"),
        F.when(F.col("prediction") == 1, target).alias("tp_price"),
        rr.alias("rr"),
        F.lit(float(record["win_rate"])).alias("expected_win_rate"),
        F.col("_g.regime").alias("regime"),
        allowed.alias("regime_allowed"),
        F.col("_g.reason").alias("regime_reason"),
    )
