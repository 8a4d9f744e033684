"""Training-data operators: near-duplicates, scoring, filtering, mixing, packing and output."""
