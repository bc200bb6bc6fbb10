"""Broadcast-transcript analytics as PySpark DataFrame operators and streaming jobs."""
