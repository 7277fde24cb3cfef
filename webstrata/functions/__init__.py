"""Part of webstrata: functions."""
