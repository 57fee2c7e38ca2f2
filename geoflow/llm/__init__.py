"""Training-data operators: decontamination, quality, licences, deduplication, tokens, fingerprints, HTML text."""
