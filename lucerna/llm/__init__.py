"""Training-data operators: quality, deduplication, decontamination, privacy, scoring and packing of text corpora."""
