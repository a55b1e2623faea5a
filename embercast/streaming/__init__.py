"""Structured Streaming jobs (scoring, alerts, bounded state, windows, dedup)."""
