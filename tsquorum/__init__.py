"""Time-series anomaly ensembles as Spark DataFrame operators."""
