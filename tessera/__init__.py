"""A point-cloud analytics engine on Spark."""
