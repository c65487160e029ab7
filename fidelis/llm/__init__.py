"""Training-data operators: archives, mixing, fingerprints, quality, toxicity, dedup, packing."""
