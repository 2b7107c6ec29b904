"""Incremental ingestion of ledger files with Structured Streaming."""
