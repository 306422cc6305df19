"""Readers, writers, ingest checks and adapters."""
