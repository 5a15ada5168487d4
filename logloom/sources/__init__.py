"""Sources: the driver tables as logs, the log table, raw lines."""
