"""Training-data operators: sampling, tokens, shards, language, duplicates, fingerprints."""
