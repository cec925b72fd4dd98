"""Monitors as streaming jobs."""
