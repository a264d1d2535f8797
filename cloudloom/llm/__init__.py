"""Training-data operators: filtering, deduplication, decontamination, search, packing and sharding."""
