"""Incremental runs over landed pulls."""
