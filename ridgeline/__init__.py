"""A Spark engine for daily price panels."""
