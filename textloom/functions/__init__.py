"""Parts of the engine: functions."""
