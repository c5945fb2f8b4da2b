"""Training-data operators: scoring, tokenisation, scans, filters, deduplication and placement."""
