"""Panel flow, regime and risk analytics composed from Spark DataFrame operations."""
