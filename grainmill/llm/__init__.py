"""Training-data operators: near-duplicate joins, deduplication, filtering, search, packing, pseudonyms."""
