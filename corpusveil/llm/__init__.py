"""Training-data operators (extraction, cleaning, near-duplicates, packing and encodings)."""
