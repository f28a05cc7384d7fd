"""Sources and sinks: driver parquet tables and the headerless text formats."""
