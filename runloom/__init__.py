"""Batch-run analytics on Spark: every operator is a ``DataFrame -> DataFrame`` function."""
