"""Streaming ingestion of mutations."""
