"""Backup-archive analytics for fleets of databases, as Spark DataFrame operators."""
