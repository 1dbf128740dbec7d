"""Token-usage and cost analytics over coding-agent logs, as Spark DataFrame operations."""
