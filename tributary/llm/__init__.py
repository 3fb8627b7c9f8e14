"""Training-data operators: filtering, extraction, language ID, dedup, search, tokenising and packing."""
