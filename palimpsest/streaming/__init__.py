"""Structured Streaming forms of ledger ingest, volumes and threshold triggers."""
