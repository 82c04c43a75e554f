"""Training-data operators: search, formatting, deduplication, filtering, mixing, sharding, output."""
