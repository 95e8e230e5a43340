"""Part of the tessera engine: functions."""
