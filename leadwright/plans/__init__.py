"""Lead analytics: plans."""
