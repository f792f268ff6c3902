"""Training-data operators: packing, filtering, deduplication, scoring, archiving."""
