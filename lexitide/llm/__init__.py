"""Operators for preparing training data: deduplication, tokens, quality, secrets, personal data, mixing, scoring."""
