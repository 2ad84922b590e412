"""Operators of a training-data pipeline: quality, toxicity, deduplication, mixing, formats. Nothing else imports them."""
