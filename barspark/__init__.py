"""Bar-data analytics on Spark: bars, indicators, labels, splits, thresholds, trades, metrics, streams."""
