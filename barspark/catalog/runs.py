"""Queries that run a stream to its end or fit a model before they return rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.catalog.base import H_SQL, hourly, query, table
from barspark.operators import model as MD
from barspark.operators.bars import next_bar_return, ticks_as_bars
from barspark.operators.fold_training import FoldRun, FoldSettings, train_over_folds
from barspark.operators.sequences import sequence
from barspark.operators.splits import fold_summary, split_by_fraction, ts_folds, walk_forward
from barspark.operators.threshold import ranking_quality
from barspark.operators.training import TrainSettings, train_and_evaluate
from barspark.session import cut_lineage, ensure_checkpoint_dir
from barspark.streaming import jobs as J


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a parquet table of the shared checkpoint folder."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_as_bars(_stream_table(spark, sf_dir, "events"), symbol="event_type", ts="ts", price="value", tie="event_id")


_NTZ = "timestamp_ntz"


@query(
    "stream_bars",
    f"""WITH {H_SQL} SELECT symbol, ts, ts + INTERVAL 1 HOUR AS bar_end, open, high, low, close, volume FROM h
    WHERE ts + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE""",
    "open high low close volume",
)
def _bars(spark, d):
    out = drain(J.stream_bars(_tick_stream(spark, d), "1 hour", "10 minutes", tie="tie"))
    return out.withColumns({c: F.col(c).cast(_NTZ) for c in ("ts", "bar_end")})


@query("stream_dedup", "SELECT DISTINCT event_type AS symbol, ts FROM events")
def _dedup(spark, d):
    twice = _tick_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = drain(J.stream_dedup(twice, "10 minutes").select("symbol", "ts"))
    return out.select("symbol", F.col("ts").cast(_NTZ).alias("ts"))


def _scored_stream(spark, d):
    e = _stream_table(spark, d, "events")
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")
    return e.select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        F.least(F.col("value") / 100, F.lit(1.0)).alias("probability"),
        (k / 2.0).alias("expected_minutes"),
    )


@query(
    "stream_gate",
    """SELECT event_id FROM (SELECT event_id, ts + INTERVAL 1 HOUR AS t, regexp_extract(props, '"k": ([0-9]+)', 1)::INTEGER / 2.0 AS m,
    least(value / 100, 1.0) AS p FROM events) WHERE p >= 0.7 AND m > 10
    AND m <= epoch(date_trunc('day', t) + INTERVAL 23 HOUR - t) / 60""",
)
def _gate(spark, d):
    return drain(J.stream_gate(_scored_stream(spark, d)).select("event_id"))


def _settings(**kw) -> TrainSettings:
    """Hourly bars in the places of the usual widths; all other values are the defaults, with all feature families."""
    return TrainSettings(window=6, horizon=24, session="all", fine="1 hour", mid="4 hours", slow="1 day", mode="f1", cap=20, **kw)


@query("train_evaluate")
def _train(spark, d):
    return train_and_evaluate(hourly(spark, d), _settings(), rolled=True).metrics


@query("gbt_scores")
def _scores(spark, d):
    """Ranking quality of a model on rows it did not see."""
    bars = hourly(spark, d).withColumn("label", (F.col("close") > F.col("open")).cast("int"))
    seqs = cut_lineage(split_by_fraction(sequence(bars, ["open", "high", "low", "close"], 4)))
    train = F.col("split") == "train"
    scaler = MD.RobustScale.fit(seqs.where(train))
    fit = MD.with_weights(scaler.apply(seqs), train=train).withColumn("_val", F.col("split") == "val")
    model = MD.train_gbt(
        cut_lineage(fit.where(F.col("split") != "test").select("features", "label", "weight", "_val")),
        weight="weight",
        validation="_val",
    )
    scored = MD.score(scaler.apply(seqs.where(F.col("split") == "test")), model, 0.5)
    return ranking_quality(scored).withColumn("n_features", F.lit(16))


# -- training over folds ---------------------------------------------------------------------------

_SERIES = ["open", "high", "low", "close", "volume"]


def _next_up(spark, d) -> DataFrame:
    """Hourly bars with whether the next one closes higher after costs; the last of a series has no label."""
    gain = next_bar_return(hourly(spark, d)).select("symbol", "ts", *_SERIES, "next_return")
    return gain.where(F.col("next_return").isNotNull()).withColumn("label", (F.col("next_return") > 0).cast("int"))


def _walked(spark, d) -> FoldRun:
    folded = walk_forward(_next_up(spark, d), 300, 120, 120, inner=0.7)
    return train_over_folds(folded, FoldSettings(scale_on=("train", "val")), cols=_SERIES)


_UP_SQL = f"""{H_SQL}, g AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) * ((1 - 0.00005::DOUBLE) * (1 - 0.0005::DOUBLE))
  / (close * ((1 + 0.00005::DOUBLE) * (1 + 0.0005::DOUBLE))) - 1 AS r FROM h),
  u AS (SELECT * EXCLUDE (r), (r > 0)::INTEGER AS label, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx,
  count(*) OVER (PARTITION BY symbol) AS n FROM g WHERE r IS NOT NULL),
  w AS (SELECT *, unnest(range((n - 420) // 120 + 1)) AS fold FROM u WHERE n >= 420),
  f AS (SELECT *, CASE WHEN idx - fold * 120 >= 300 THEN 'test' WHEN idx - fold * 120 >= 210 THEN 'val' ELSE 'train' END AS role
  FROM w WHERE idx >= fold * 120 AND idx < fold * 120 + 420)"""


@query(
    "walk_forward_folds",
    f"""WITH {_UP_SQL}, t AS (SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_val,
    count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'test' AND label = 1) AS up,
    count(*) FILTER (role = 'test' AND label = 0) AS down FROM f GROUP BY 1),
    v AS (SELECT fold, unnest([0, 1, 2, 3, 4]) AS pos, unnest([open, high, low, close, volume]) AS x FROM f WHERE role <> 'test'),
    q AS (SELECT fold, pos::INTEGER AS pos, quantile_cont(x, 0.5) AS center, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s
    FROM v GROUP BY 1, 2)
    SELECT t.*, pos, center, CASE WHEN s > 0 THEN s ELSE 1 END AS scale FROM t JOIN q USING (fold)""",
    "center scale",
)
def _fold_rows(spark, d):
    """Rows and scales of each trained fold; its test rows by label are sums over its confusion table."""
    run = _walked(spark, d)
    up, down = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return run.metrics.select("fold", "n_train", "n_val", "n_test", up.alias("up"), down.alias("down")).join(run.scales, "fold")


@query("ts_fold_metrics")
def _ts_fold_metrics(spark, d):
    """Mean, spread and range of test metrics over expanding folds whose held-out rows are halved into val and test."""
    run = train_over_folds(ts_folds(_next_up(spark, d), 3, gap=1, halves=True), cols=_SERIES)
    return fold_summary(run.metrics, ["win_rate", "precision", "recall", "f1", "roc_auc"], sample_std=True)
