"""Lead analytics: streaming."""
