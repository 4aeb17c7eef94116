"""Writers: backup lists, sentinels, delete plans, volumes, log lines."""
