"""Sources and sinks: parquet/CSV/text/binary scans, test-table bindings."""
