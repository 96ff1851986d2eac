"""Scans, sinks, incremental ingest and adapters."""
