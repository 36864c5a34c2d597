"""Training-data operators: URL filters, quality, packing, mixing, dedup, language, PII, fingerprints."""
