"""Training-data operators: filtering, deduplication, tokenising, packing and sharding."""
