"""The edit log, triggers, queues, keyed once and cron times."""
