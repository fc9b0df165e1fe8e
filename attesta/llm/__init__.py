"""Training-data operators: quality, packing, near duplicates, decontamination, scoring."""
