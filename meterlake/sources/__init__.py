"""Log files, the SQLite store, and the Parquet warehouse."""
