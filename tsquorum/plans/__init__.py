"""Whole plans: the pipeline, the report queries, and the queries over the driver's tables."""
