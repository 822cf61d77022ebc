"""Training-data operators (language, toxicity, dedup, mixing, extraction, WARC)."""
