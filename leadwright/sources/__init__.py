"""Lead analytics: sources."""
