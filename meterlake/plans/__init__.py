"""Jobs: incremental ingestion per agent, and the usage report."""
