"""Training-data operators: fingerprints, tokenising, scoring, dedup, filtering and mixing of documents."""
