"""Operators of a training-data pipeline: deduplication, tokenisation, personal
data, archives, quality, language and mixing. Nothing outside imports them."""
