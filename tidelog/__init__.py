"""Versioned key-value analytics on Spark: the change-log is a DataFrame, and every read is a query over it."""
