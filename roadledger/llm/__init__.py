"""Training-data operators: quality, safety, deduplication, decontamination and packing."""
