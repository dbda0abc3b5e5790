"""Settlement reconciliation on Spark."""
