"""Training-data operators: scoring, deduplication, mixing, sharding, tokenising."""
