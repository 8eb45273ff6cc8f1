"""Replication of tables by change logs, as Spark jobs."""
