"""Training-data operators: quality, near-duplicates, sharding, language, tokens, secrets, licences, leaks."""
