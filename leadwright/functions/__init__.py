"""Lead analytics: functions."""
