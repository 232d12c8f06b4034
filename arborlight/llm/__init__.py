"""Training-data operators: scans, deduplication, classification, search, tokenization and mixing."""
