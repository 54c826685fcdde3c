"""Training-data operators: deduplication, search, scoring, mixing, filtering, packing, sharding."""
