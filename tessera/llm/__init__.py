"""Training-data operators: filtering, mixing, tokenising and de-duplicating text at scale."""
