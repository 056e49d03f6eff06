"""Training-data operators: scanning, packing, sharding, mixing, deduplication, search, language ID."""
