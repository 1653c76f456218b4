"""Training-data operators: quality, near-duplicates, mixing, toxicity, language, URLs, packing, HTML, secrets."""
