"""Training-data operators: packing, decontamination, filtering, deduplication, token files, archives, scoring, search and sharding."""
