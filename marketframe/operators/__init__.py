"""DataFrame operators: functions from tables to tables."""
