"""Readers of logs and control tables."""
