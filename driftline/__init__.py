"""Snapshot reconciliation on Spark: ingest event grids, diff, apply, keep state."""
