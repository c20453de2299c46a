"""Panel analytics on Spark: price panels, spread targets, window features, supervised data, metrics and streaming."""
