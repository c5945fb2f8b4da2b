"""Incremental forms: ingestion of arriving files, windows over events, job states."""
