"""Lead analytics: operators."""
